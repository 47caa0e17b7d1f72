import corpus_pipeline
from pyspark.sql import functions as F

DATA, MORE = "/root/testdata/sf0.001", "/root/testdata/sf0.1"


def test_stages(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    before = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, before, DATA)
        assert after.columns == docs.columns, name
        after = after.cache()
        kept = {r.doc_id for r in after.select("doc_id").collect()}
        assert kept <= {r.doc_id for r in before.select("doc_id").collect()}
        if name == "toxicity":
            assert len(kept) > 0.8 * docs.count()  # eleven toxic labels teach little; see below
        before = after
    out = corpus_pipeline.run(spark, DATA).cache()
    assert out.count() == before.count()
    texts = {r.doc_id: r for r in before.collect()}
    import public_tokenizers
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    for r in out.collect():
        assert r.ids == library.encode(texts[r.doc_id].text, add_eos=True) and r.n_tokens == len(r.ids)
        assert r.document.lang == texts[r.doc_id].lang and "text" not in r.document


def test_empty(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, DATA)
    assert docs.count() == 0


def test_awkward_rows(spark):
    """Nulls, empty and very long texts, repeated rows, and columns whose names the operators use themselves."""
    prose = " ".join(f"word{i} stands here among {i * 7} others" for i in range(40))
    long = " ".join(f"number{i}" for i in range(200_000))
    rows = [(1, None), (2, ""), (3, prose), (3, prose), (None, prose), (4, long), (5, "api_key = abcdef123456 and more"), (None, "a text of its own without an id"), (None, None)]
    names = {"score": F.lit(99.0), "predicted": F.lit("keep me"), "ids": F.lit(1), "n_tokens": F.lit("x"), "id": F.lit("i"), "root": F.lit(0), "class_id": F.lit(7), "document": F.lit(b"d"), "keys": F.array(F.lit(1)), "n": F.lit(None).cast("int")}
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns(names)
    stages = dict(corpus_pipeline.STAGES)
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, MORE)
        assert docs.columns == ["doc_id", "text", *names], name
        got = docs.cache().collect()
        assert all(r.score == 99.0 and r.predicted == "keep me" and r.root == 0 and bytes(r.document) == b"d" and r.n is None for r in got), name
        kept[name] = sorted((r.doc_id is None, r.doc_id or 0, r.text or "") for r in got)
    assert len(kept["toxicity"]) == len(rows)
    # the class of the prose keeps one row, the class of texts without words another
    assert [k[:2] for k in kept["near_duplicates"]] in ([(False, 1), (False, 3), (False, 4), (False, 5), (True, 0)], [(False, 3), (False, 4), (False, 5), (True, 0), (True, 0)])
    assert kept["decontamination"] == kept["near_duplicates"]
    assert not any("abcdef123456" in t for _, _, t in kept["secrets"])
    out = stages["sentencepiece"](spark, docs, MORE).collect()
    assert len(out) == 5 and all(r.document.ids == 1 and r.document.document == b"d" for r in out)


def test_toxic_documents_go(spark):
    docs = spark.read.parquet(f"{MORE}/documents.parquet")
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{MORE}/labels.parquet").collect()}
    kept = {r.doc_id for r in corpus_pipeline.drop_toxic(spark, docs, MORE).select("doc_id").collect()}
    wrong = sum((d in kept) == bool(t) for d, t in labels.items())
    assert wrong <= 0.01 * len(labels)
