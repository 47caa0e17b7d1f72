"""Small cases with known answers."""

import math
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.functions import vectors as V
from quern.operators import exact, graph
from quern.operators.tables import last_of, numbered, required, running, upserted
from quern.plans import catalogue, serving
from quern.sources import store
from quern.streaming.ingest import ingest, ingested

DATA = "/root/testdata/sf0.01"


def unit(n, d, seed):
    x = np.random.default_rng(seed).normal(size=(n, d))
    return x / np.linalg.norm(x, axis=1, keepdims=True)


# ---- exact search

GOLDEN = [(0, 10, [1.0, 0.0]), (1, 10, [1.0, 0.0]), (3, 20, [-1.0, 0.0]), (4, 20, [1.0, 0.0]), (6, 30, [0.8, 0.6]), (7, 30, [0.8, 0.6]), (8, 40, [-1.0, 0.0])]
SEGMENT = "row_id long, track_id long, vector array<double>"


def test_distinct_tracks_with_best_passage(spark):
    segs = spark.createDataFrame(GOLDEN, SEGMENT)
    got = exact.topk(segs.filter("row_id = 0"), segs, 10, "max", "track").orderBy("rank").collect()
    assert [(r.track_id, r.row_id, r.score) for r in got] == [(20, 4, 1.0), (30, 6, 0.8), (40, 8, -1.0)]


@pytest.mark.parametrize("vector", [[0.0, 0.0], [float("nan"), 0.0], [1.0, 0.0, 0.0], [float("inf"), 1.0]])
def test_search_refuses_bad_queries(spark, vector):
    segs = spark.createDataFrame(GOLDEN, SEGMENT)
    with pytest.raises(Exception, match="vectors must|differ in length"):
        exact.topk(spark.createDataFrame([(99, 99, vector)], SEGMENT), segs, 10).collect()


def test_pooling_of_uneven_tracks(spark):
    r = np.random.default_rng(5)
    owner = np.repeat(np.arange(12), r.integers(1, 8, 12))
    x, q = unit(len(owner), 6, 6), unit(3, 6, 7)
    segs = spark.createDataFrame([(i, int(t), v.tolist()) for i, (t, v) in enumerate(zip(owner, x, strict=True))], SEGMENT)
    asked = spark.createDataFrame([(1000 + i, 1000 + i, v.tolist()) for i, v in enumerate(q)], SEGMENT)
    got = {(g.query_row - 1000, g.track_id): g.score for g in exact.topk(asked, segs, 100, "topk", "none").collect()}
    assert len(got) == 36
    for (i, t), score in got.items():
        own = np.sort(np.round(x[owner == t] @ q[i], 9))[::-1][:3]
        assert score == pytest.approx(own.mean(), abs=2e-9)


# ---- numbering, upserts


@pytest.fixture(scope="module")
def many(spark, tmp_path_factory):
    """400,000 rows in eight files, more than what a range partitioning samples."""
    path = str(tmp_path_factory.mktemp("many") / "t")
    spark.range(400_000, numPartitions=8).selectExpr("id * 77773 % 400000 as id", "cast(id * 77773 % 400000 % 7 as int) as amount").write.parquet(path)
    return spark.read.parquet(path)


@pytest.mark.parametrize("parts", ["4", "64"])
@pytest.mark.parametrize("adaptive", ["true", "false"])
def test_numbers_are_dense_in_large_tables(spark, many, parts, adaptive):
    held = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
        wrong = numbered(many, "n", "id").select("id", "n").filter("id <> n").count()
        sums = running(many, "before", F.col("amount"), "id")
        off = sums.filter(F.expr("before <> 21 * (id div 7) + (id % 7) * (id % 7 - 1) div 2")).count()
        assert (wrong, off, sums.count()) == (0, 0, 400_000)
    finally:
        for k, v in held.items():
            spark.conf.set(k, v)


def test_numbers_of_no_rows_and_of_ties(spark):
    assert numbered(spark.range(0), "n", "id").count() == 0
    same = spark.range(1000).selectExpr("id % 3 as k")
    got = sorted((r.n, r.k) for r in numbered(same, "n", "k").collect())
    assert [n for n, _ in got] == list(range(1000)) and [k for _, k in got] == sorted(k for _, k in got)


def test_manifest_of_many_files(spark, many):
    rows = numbered(many.select("id"), "n", "id").selectExpr("id", "n * 21 as row_start")
    found = rows.agg(F.count_distinct("row_start").alias("n"), F.max("row_start").alias("last")).first()
    assert tuple(found) == (400_000, 399_999 * 21)


def test_last_row_of_a_key_wins(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k long, v string")
    new = spark.createDataFrame([(2, 10, "x"), (2, 11, "y"), (3, 5, None), (3, 4, "z")], "k long, at long, v string")
    assert sorted(map(tuple, upserted(old, new, "k", "at").collect())) == [(1, "a"), (2, "y"), (3, None)]
    assert last_of(new, "k", "at").count() == 2


def test_quantiles_of_small_groups(spark):
    from quern.operators.tables import quantiles

    rows = spark.createDataFrame([("a", 1.0, 0), ("b", 1.0, 1), ("b", 2.0, 2), ("b", None, 3), ("c", 5.0, 4), ("c", 5.0, 5), ("c", 9.0, 6)], "g string, v double, i long")
    got = {r.g: (r.mid, r.top) for r in quantiles(rows, ["g"], "v", {"mid": 0.5, "top": 1.0}, "i").collect()}
    assert got == {"a": (1.0, 1.0), "b": (1.5, 2.0), "c": (5.0, 9.0)}


def test_recall(spark):
    lists = [(q, r + 1, q * 10 + r) for q in range(50) for r in range(10)]
    truth = spark.createDataFrame(lists, "query_row long, rank int, row_id long")
    mean = lambda rows, k=10: catalogue.recall(truth, spark.createDataFrame(rows, truth.schema), k).agg(F.avg("recall")).first()[0]
    assert mean(lists) == 1.0
    assert mean([(q, 11 - r, i) for q, r, i in lists]) == 1.0
    assert mean([(q, r, i if r <= 5 else 10_000 + i) for q, r, i in lists]) == 0.5
    assert mean([(q, r, 10_000 + i) for q, r, i in lists]) == 0.0
    with pytest.raises(Exception, match="fewer than 11"):
        mean(lists, 11)


# ---- graphs


def test_diversified_links():
    at = np.radians([5.0, 6.0, -20.0])
    x = np.stack([np.cos(at), np.sin(at)], 1)
    d = 1 - x @ np.array([1.0, 0.0])
    take = graph.diverse(d[None], lambda rows: (1 - x @ x.T)[None][rows], 2)
    assert np.flatnonzero(take[0]).tolist() == [0, 2]
    assert graph.diverse(d[None], None, 3).all()


def test_tiny_graph():
    x = np.array([[1.0, 0.0], [0.9, 0.1], [0.0, 1.0]])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    g = graph.Shard(x, np.array([20, 30, 40]), 4)
    assert (g.nearest(x[:1], 2, 5)[0] == -1).all()
    g.insert(np.array([0]))
    g.insert(np.array([1]))
    g.order, g.done = np.array([0, 1, 2]), 2
    assert g.layers[0][0, 0] == 1 and g.layers[0][1, 0] == 0
    node, dist, _ = g.nearest(x[:1], 3, 5)
    assert sorted(g.ids[node[0][node[0] >= 0]].tolist()) == [20, 30] and dist[0, 2] == np.inf
    with pytest.raises(ValueError, match="twice"):
        g.insert(np.array([1]))


def test_full_beam_is_exact():
    x = unit(250, 16, 14)
    g = graph.Shard(x, np.arange(250)).build()
    assert g.top >= 1 and 5 <= (g.level > 0).sum() <= 65
    q = unit(12, 16, 15)
    node, dist, spent = g.nearest(q, 10, 250)
    assert (spent >= 250).all()
    for i in range(12):
        d = 1 - x @ q[i]
        assert node[i].tolist() == np.lexsort((np.arange(250), d))[:10].tolist()
        assert np.allclose(dist[i], np.sort(d)[:10], atol=1e-6)


def test_full_beam_does_not_go_step_by_step(monkeypatch):
    """A beam as wide as the shard sorted a row as long as the shard for each node that it expanded."""
    x = np.concatenate([unit(900, 16, 40), np.repeat(unit(3, 16, 41), 40, 0)])
    ids = np.random.default_rng(42).permutation(len(x)) * 7
    g = graph.Shard(x, ids, 4, 40).build()
    q = np.concatenate([unit(20, 16, 43), x[900::40]])
    stepwise, _ = g.beam(q, np.full(len(q), g.entry), len(x), 0, np.zeros(len(q), np.int64))
    monkeypatch.setattr(graph.Shard, "beam", None)
    monkeypatch.setattr(graph, "HELD", 3_000)  # a few queries at a time
    node, dist, spent = g.nearest(q, 12, len(x))
    for i in range(len(q)):
        score = np.round(x @ q[i], 9)
        assert node[i].tolist() == np.lexsort((ids, -score))[:12].tolist()  # copies too: by id
        assert set(node[i].tolist()) <= set(stepwise[i].tolist()) and np.allclose(1 - dist[i], score[node[i]], atol=1e-9)
    assert (spent >= len(x)).all()


def test_full_beam_keeps_to_what_its_start_leads_to():
    x = unit(30, 8, 44)
    g = graph.Shard(x, np.arange(30), 2, 20).build()
    table = g.layers[0]
    for v in table:  # from 0-19 nothing leads to 20-29
        v[:] = np.r_[v[v < 20], np.full(4, -1)][:4]
    g._joined = 0
    lead = g.leads(np.array([g.entry]), np.zeros(30, bool))
    g.top = 0
    node, _, spent = g.nearest(x[:5], 30, 30)
    assert all(set(n[n >= 0].tolist()) == set(np.flatnonzero(lead).tolist()) for n in node) and (spent >= lead.sum()).all()


@pytest.mark.parametrize("copies", [25, 400])
def test_every_node_can_be_reached(copies):
    """Copies filled each other's links, and nothing led to them."""
    x = np.concatenate([unit(500, 16, 45), np.repeat(unit(800 // copies, 16, 46), copies, 0)])
    g = graph.Shard(x, np.arange(len(x))).build()
    for f in (g.leads, g.led):
        assert f(np.array([g.entry]), np.zeros(len(x), bool)).all()
    near = g.layers[0]
    assert all(len(set(v[v >= 0].tolist())) == (v >= 0).sum() and (v[: (v >= 0).sum()] >= 0).all() and i not in v for i, v in enumerate(near))
    node, _, _ = g.nearest(x[500::copies], 20, len(x))
    assert [n.tolist() for n in node] == [list(range(at, at + 20)) for at in range(500, 1300, copies)]


def test_links_to_and_from_what_is_cut_off():
    x = unit(40, 8, 47)
    g = graph.Shard(x, np.arange(40), 2, 20).build()
    ring = np.arange(40)
    g.layers[0][:] = -1
    half = ring // 20 * 20
    for k in range(4):  # two parts, each in itself, all places taken
        g.layers[0][:, k] = half + (ring - half + k + 1) % 20
    g.connect()
    for f in (g.leads, g.led):
        assert f(np.array([g.entry]), np.zeros(40, bool)).all()
    before = g.layers[0].copy()
    g.connect()
    assert (g.layers[0] == before).all()


def clustered():
    r = np.random.default_rng(9)
    centers = unit(20, 32, 9)
    x, q = (centers[r.integers(0, 20, n)] + 0.1 * r.normal(size=(n, 32)) for n in (1000, 60))
    return (v / np.linalg.norm(v, axis=1, keepdims=True) for v in (x, q))


def test_recall_on_clusters():
    x, q = clustered()
    node, _, spent = graph.Shard(x, np.arange(1000), 12, 80).build().nearest(q, 10, 80)
    truth = np.argsort(-(q @ x.T), 1, kind="stable")[:, :10]
    assert np.mean([len(set(a) & set(b)) / 10 for a, b in zip(node.tolist(), truth.tolist(), strict=True)]) >= 0.95
    assert spent.mean() < 600


def test_duplicates_and_nothing():
    g = graph.Shard(np.tile([1.0, 0.0], (30, 1)), np.arange(30), 4).build()
    node, dist, _ = g.nearest(np.array([[1.0, 0.0]]), 10, 30)
    assert len(set(node[0].tolist())) == 10 and (dist[0] == 0).all()
    empty = graph.Shard(np.zeros((0, 2)), np.zeros(0, np.int64)).build()
    assert empty.rows(0).num_rows == 0 and (empty.nearest(np.array([[1.0, 0.0]]), 3, 5)[0] == -1).all()


def test_graph_refuses_bad_input():
    x = unit(4, 3, 1)
    g = graph.Shard(x, np.arange(4)).build()
    bad = (
        lambda: graph.Shard(x * 2, np.arange(4)),
        lambda: graph.Shard(x * 0, np.arange(4)),
        lambda: graph.Shard(x, np.array([1, 1, 2, 3])),
        lambda: graph.Shard(x, np.arange(4), 16, 8),
        lambda: g.nearest(x, 10, 5),
        lambda: g.nearest(x[:, :2], 1, 5),
        lambda: g.nearest(x * 0, 1, 5),
        lambda: g.nearest(np.full((1, 3), np.nan), 1, 5),
    )
    for f in bad:
        with pytest.raises(ValueError):
            f()


@pytest.mark.parametrize("cuts", [(137, 713), (1,), (1000, 1106)])
def test_a_build_goes_on_as_if_it_had_not_stopped(cuts):
    x, ids = unit(1107, 16, 6), np.random.default_rng(2).permutation(1107) * 21
    whole = graph.Shard(x, ids, 8, 60).build().rows(3)
    part = None
    for cut in cuts:
        g = graph.Shard(x, ids, 8, 60)
        g = (g if part is None else g.restore(part)).extend(cut)
        assert g.done <= cut
        part = g.rows(3)
    assert graph.Shard(x, ids, 8, 60).restore(part).extend().rows(3).equals(whole)
    with pytest.raises(ValueError, match="first nodes"):
        graph.Shard(x, ids, 8, 60).restore(whole.slice(5, 100))


def sound(spark, x, ids, m=4):
    rows = graph.Shard(x, ids, m, 40).build().rows(0)
    vectors = {int(i): v.tolist() for i, v in zip(ids, x, strict=True)}
    return spark.createDataFrame([(r["shard"], r["row_id"], r["level"], r["entry"], r["counts"], r["links"], vectors[r["row_id"]]) for r in rows.to_pylist()], graph.LINKED + ", vector array<double>")


@pytest.fixture(scope="module")
def small(spark):
    return sound(spark, unit(150, 12, 3), np.arange(150) * 21).cache()


def test_validation(spark, small):
    links = graph.edges(small)
    assert graph.problems(small, links, 4).count() == 0 and graph.misshapen(small).count() == 0
    say = lambda nodes, rows: {r.problem for r in graph.problems(nodes, spark.createDataFrame(rows, "shard int, layer int, src long, pos int, dst long"), 4).collect()}
    nodes = lambda *rows: spark.createDataFrame(rows, "shard int, row_id long, level int, entry boolean")
    two = nodes((0, 0, 0, True), (0, 1, 0, False))
    assert say(two, [(0, 0, 0, 0, 1), (0, 0, 1, 0, 0)]) == set()
    assert say(nodes((0, 0, 0, True)), [(0, 0, 0, 0, 2)]) == {"link of an unknown node"}
    assert say(two, [(0, 0, 0, 0, 0)]) == {"link to itself"}
    assert say(two, [(0, 0, 0, 0, 1), (0, 0, 0, 1, 1)]) == {"link twice"}
    assert say(two, [(0, 1, 0, 0, 1)]) == {"link above a node's level"}
    assert say(nodes((0, 0, 0, False)), []) == {"entry not one node of the highest level"}
    assert say(nodes((0, 0, 0, True), (0, 1, 1, False)), []) == {"entry not one node of the highest level"}
    assert say(nodes((0, 0, 0, True), (0, 0, 0, False)), []) == {"node twice"}
    star = nodes(*((0, i, 0, i == 0) for i in range(12)))
    assert say(star, [(0, 0, 0, i, i) for i in range(1, 12)]) == {"too many links"}
    assert graph.misshapen(small.withColumn("counts", F.slice("counts", 1, 0))).count() == 150
    assert graph.misshapen(small.withColumn("links", F.slice("links", 1, 1))).count() > 100


def test_breadth_first_order_and_relabelling(spark, small):
    rows = small.collect()
    near = {r.row_id: r.links[: r.counts[0]] for r in rows}
    (entry,) = (r.row_id for r in rows if r.entry)
    # two nodes that nothing leads to
    more = small.select("shard", "row_id", "level", "entry").unionByName(spark.createDataFrame([(0, 999_999, 0, False), (0, 5, 0, False)], "shard int, row_id long, level int, entry boolean"))
    order, at = [entry], 0
    while at < len(order):
        order += [x for x in dict.fromkeys(near[order[at]]) if x not in order]
        at += 1
    order += sorted(set(near) - set(order) | {5, 999_999})
    links = graph.edges(small).cache()
    got = graph.bfs(more, links, lambda df: store.written(df, "test")).cache()
    assert [r.node for r in got.orderBy("rank").collect()] == order
    assert {r.rank for r in got.collect()} == set(range(152))
    new = {n: i for i, n in enumerate(order)}
    nodes, moved = graph.permuted(more, links, got)
    assert {tuple(r) for r in moved.collect()} == {(r.shard, r.layer, new[r.src], r.pos, new[r.dst]) for r in links.collect()}
    assert [r.row_id for r in nodes.filter("entry").collect()] == [0]
    pages = [len({new[x] * 48 // 4096 for x in near[n]}) for n in near]
    assert graph.locality(links, got, 48).first().mean_pages == pytest.approx(np.mean(pages), abs=1e-6)


def test_links_of_one_a_row_are_packed(spark, small):
    nodes = small.select("shard", "row_id", "level", "entry", "vector")
    got = graph.packed(nodes, graph.edges(small)).select(small.columns)
    assert got.exceptAll(small).count() == 0 == small.exceptAll(got).count()


def test_search_counts_distances_of_all_shards(spark):
    x = unit(300, 8, 21)
    segs = spark.createDataFrame([(i, i % 3, v.tolist()) for i, v in enumerate(x)], "row_id long, shard int, vector array<double>")
    built = graph.build(segs, 4, 40).cache()
    asked = segs.filter("row_id < 20")
    got = graph.search(built, asked, 5, 300, 4).collect()
    own = {}
    for s in range(3):
        ids = np.arange(s, 300, 3)
        g = graph.Shard(x[ids], ids, 4, 40).build()
        _, _, spent = g.nearest(x[:20], 6, 300)
        for i, n in enumerate(spent.tolist()):
            own[i] = own.get(i, 0) + n
    for i in range(20):
        score = np.round(x @ x[i], 9)
        score[i] = -9
        mine = sorted((r for r in got if r.query_row == i), key=lambda r: r.rank)
        assert [r.row_id for r in mine] == np.lexsort((np.arange(300), -score))[:5].tolist()
        assert {r.evaluations for r in mine} == {own[i]}


def test_stored_graph(spark, tmp_path):
    x = unit(160, 8, 22)
    segs = spark.createDataFrame([(i, i % 4, v.tolist()) for i, v in enumerate(x)], "row_id long, shard int, vector array<double>")
    path = str(tmp_path / "g")
    assert not graph.build_stored(spark, segs, path, 4, 40, at_once=2, stop_after=1)
    with pytest.raises(ValueError, match="not complete"):
        graph.load_stored(spark, segs, path, 4, 40, at_once=2)
    graph.build(segs, 4, 40).write.parquet(f"{path}/wave=1/data")  # a run that was lost before its manifest
    assert graph.build_stored(spark, segs, path, 4, 40, at_once=2)
    kept = graph.load_stored(spark, segs, path, 4, 40, at_once=2)
    fresh = graph.build(segs, 4, 40)
    assert kept.exceptAll(fresh.select(kept.columns)).count() == 0 == fresh.select(kept.columns).exceptAll(kept).count()
    with pytest.raises(ValueError, match="stale: m"):
        graph.load_stored(spark, segs, path, 5, 40, at_once=2)
    other = segs.withColumn("vector", F.reverse("vector"))
    with pytest.raises(ValueError, match="stale: vectors"):
        graph.load_stored(spark, other, path, 4, 40, at_once=2)
    with pytest.raises(ValueError, match="stale"):
        graph.build_stored(spark, other, path, 4, 40, at_once=2)


def test_fetching_more_until_there_are_enough_tracks(spark):
    base = unit(1, 8, 30)[0]
    r = np.random.default_rng(31)
    x = np.concatenate([base + 0.01 * r.normal(size=(400, 8)), r.normal(size=(100, 8))])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    segs = spark.createDataFrame([(i, 0, v.tolist()) for i, v in enumerate(x)], "row_id long, shard int, vector array<double>")
    built = graph.build(segs, 4, 40).cache()
    asked = segs.filter("row_id in (0, 450)").select("row_id", "vector")
    got = catalogue.overfetched(built, asked, 95).collect()
    for q in (0, 450):
        score = np.round(x @ x[q], 9)
        best = {}
        for i in np.lexsort((np.arange(500), -score)):
            if i // 5 != q // 5:
                best.setdefault(i // 5, i)
        mine = sorted((g for g in got if g.query_row == q), key=lambda g: g.rank)
        assert [(g.track_id, g.row_id) for g in mine] == list(best.items())[:95]


# ---- sources and sinks


def test_commit_and_load(spark, tmp_path):
    df, path = spark.range(10), str(tmp_path / "t")
    with pytest.raises(ValueError, match="not complete"):
        store.load(spark, path)
    store.commit(df, path, {"model": "a"})
    assert store.load(spark, path, expect={"model": "a"}).count() == 10
    for about in ({"model": "b"}, {}, {"model": "a", "genre": "x"}):
        with pytest.raises(ValueError, match="stale"):
            store.load(spark, path, expect=about)
    with pytest.raises(Exception):  # noqa: B017
        store.commit(df, path)
    with pytest.raises(ValueError, match="complete"):
        store.discard(spark, path)
    spark.range(1).write.mode("append").parquet(f"{path}/data")
    with pytest.raises(ValueError, match="differs"):
        store.load(spark, path)
    spark.range(10).selectExpr("id as other").write.mode("overwrite").parquet(f"{path}/data")
    with pytest.raises(ValueError, match="schema"):
        store.load(spark, path)


def test_files_are_whole_or_absent(spark, tmp_path):
    path = tmp_path / "report.json"
    for text in ('{"a": 1}', '{"b": "é"}'):
        store.write_file(spark, f"file://{path}", text)
        assert path.read_text() == text
    assert [p.name for p in tmp_path.iterdir() if not p.name.endswith(".crc")] == ["report.json"]


def test_models_see_a_track_at_a_time(spark):
    from quern.operators.embed import embedded_texts, embedded_tracks

    rows = [(t, w, [float(t), float(w)]) for t in range(5) for w in (2, 0, 1)]
    windows = spark.createDataFrame(rows, "track_id long, window int, samples array<double>")
    model = lambda batch: np.array([[len(batch), *x] for x in batch])
    got = sorted((r.track_id, r.window, r.vector) for r in embedded_tracks(windows, model, 2).collect())
    assert got == [(t, w, [3.0, float(t), float(w)]) for t in range(5) for w in range(3)]
    with pytest.raises(Exception, match="3 samples"):
        embedded_tracks(windows, model, 3).collect()
    with pytest.raises(Exception, match="a vector for each"):
        embedded_tracks(windows, lambda batch: np.zeros((1, 2)), 2).collect()
    texts = spark.createDataFrame([(1, "ab"), (2, "  "), (3, None), (4, "c")], "id long, text string")
    assert sorted((r.id, r.vector) for r in embedded_texts(texts, lambda batch: np.array([[len(x)] for x in batch])).collect()) == [(1, [2.0]), (4, [1.0])]


def test_held_out_lists_are_kept_and_refused(spark, tmp_path):
    path = str(tmp_path / "h")
    first = serving.held_out(spark, DATA, path).collect()
    stamp = os.stat(f"{path}/data").st_mtime
    assert sorted(first) == sorted(serving.held_out(spark, DATA, path).collect()) and os.stat(f"{path}/data").st_mtime == stamp
    asked = {r.query_row for r in first}
    assert len(asked) == 8 and not asked & {r.row_id for r in first}
    for more in ({"n": 9}, {"model": "other"}):
        with pytest.raises(ValueError, match="stale"):
            serving.held_out(spark, DATA, path, **more)
    with pytest.raises(ValueError, match="stale"):
        serving.held_out(spark, "/root/testdata/sf0.1", path)


def test_grouped_csv(spark, tmp_path):
    path = tmp_path / "tracks.csv"
    path.write_text(",artist,track,track,track\n,name,title,genre_top,duration\ntrack_id,,,,\n" + '7,"Smith, J", A song ,Jazz,30\n8,,B,,\nx,n,n,n,n\n,n,n,n,n\n')
    wanted = {("track", "title"): "title", ("artist", "name"): "artist", ("track", "genre_top"): "genre"}
    got = store.grouped_csv(spark, str(path), wanted)
    assert sorted(map(tuple, got.collect())) == [(7, "A song", "Smith, J", "Jazz"), (8, "B", None, None)]
    with pytest.raises(KeyError):
        store.grouped_csv(spark, str(path), {("track", "bpm"): "bpm"})


def test_scan_files(spark, tmp_path):
    for name in ("000/5.mp3", "001/12.mp3", "001/note.txt"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(b"abc")
    assert sorted((r.track_id, r.length) for r in store.scan_files(spark, str(tmp_path)).collect()) == [(5, 3), (12, 3)]


def test_ingest_goes_on_after_a_crash(spark, tmp_path):
    src, out = tmp_path / "in", str(tmp_path / "out")
    schema = "track_id long, status string"
    rows = lambda a, b: spark.range(a, b).selectExpr("id as track_id", "'done' as status")
    rows(0, 50).coalesce(1).write.mode("append").parquet(str(src))
    run = lambda: ingest(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(src)), out)
    run()
    rows(50, 80).coalesce(1).write.mode("append").parquet(str(src))
    run()
    # the last batch's data is there but not its marker, and the stream has not noted it as done: as if killed in between
    import shutil

    shutil.rmtree(f"{out}/done/batch=1")
    for name in ("1", ".1.crc"):
        if os.path.exists(f"{out}/checkpoint/commits/{name}"):
            os.remove(f"{out}/checkpoint/commits/{name}")
    assert ingested(spark, out).count() == 50
    run()
    assert sorted(r.track_id for r in ingested(spark, out).collect()) == list(range(80))


def test_no_shared_folder_on_a_cluster():
    class Conf:
        get = staticmethod(lambda name: None)

    class Context:
        master = "spark://host:7077"
        getConf = staticmethod(lambda: Conf)

        class _jsc:
            class sc:
                class getCheckpointDir:
                    isDefined = staticmethod(lambda: False)

    class Session:
        sparkContext = Context

    with pytest.raises(RuntimeError, match="checkpoint"):
        store.shared_dir(Session)


# ---- expressions


def test_vector_expressions(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    lit = lambda *x: F.array(*map(F.lit, x))
    assert one(V.normalized(lit(3.0, 4.0))) == [0.6, 0.8]
    assert one(V.distance(lit(1.0, 0.0), lit(0.0, 1.0))) == 1.0
    for bad in (lit(0.0, 0.0), lit(float("nan"), 1.0), lit(float("inf"), 1.0)):
        with pytest.raises(Exception, match="finite"):
            one(V.normalized(bad))
    assert [one(V.clock(F.lit(s))) for s in (0, 9, 65, 600)] == ["0:00", "0:09", "1:05", "10:00"]
    assert one(V.quoted(F.lit("a b*c~d/é"))) == "a+b%2Ac~d%2F%C3%A9"
    assert [one(F.size(V.windows(F.sequence(F.lit(1), F.lit(n)), 10, 1))) for n in (30, 12, 9)] == [21, 3, 0]
    with pytest.raises(Exception, match="no"):
        required(spark.range(3), F.col("id") < 2, "no").count()
    with pytest.raises(Exception, match="no"):
        required(spark.range(3), F.lit(None).cast("boolean"), "no").count()


def test_collapse(spark):
    same = spark.createDataFrame([([1.0, 0.0],)] * 4, "vector array<double>")
    assert tuple(serving.collapse(same).first()) == (1.0, True)
    assert not serving.collapse(spark.createDataFrame([(v.tolist(),) for v in unit(4, 8, 2)], "vector array<double>")).first().collapsed


def test_reuse_refuses_other_configurations(spark):
    rows = lambda *x: spark.createDataFrame(x, "doc_id long, sha string")
    about = lambda *x: spark.createDataFrame(x, "name string, value string")
    source, target = rows((10, "same"), (30, "old")), rows((2, "new"), (10, "same"), (20, "new"), (30, "changed"))
    mine = about(("model", "a"), ("windows", "20"))
    got = {r.doc_id: (r.status, r.outcome) for r in serving.reused(source, target, mine, mine).collect()}
    assert got == {2: ("pending", "new"), 10: ("done", "copied"), 20: ("pending", "new"), 30: ("pending", "mismatched")}
    for other in (about(("model", "b"), ("windows", "20")), about(("model", "a"))):
        with pytest.raises(Exception, match="another configuration"):
            serving.reused(source, target, mine, other).collect()


def test_binomial_tail_of_many_trials(spark):
    n = 3000
    start = -n * math.log(2)
    exact_half = 0.5 + 0.5 * math.exp(math.lgamma(n + 1) - 2 * math.lgamma(n // 2 + 1) + start)
    from pyspark.sql import Row

    orders = spark.createDataFrame([Row(g="x", n=n, k=n // 2)])
    assert orders.select(catalogue.tail(F.col("n"), F.col("k")).alias("p")).first().p == pytest.approx(exact_half, abs=1e-9)


def test_a_stored_graph_of_copies_is_searched_whole(spark, tmp_path):
    x = np.concatenate([unit(120, 8, 48), np.repeat(unit(4, 8, 49), 60, 0)])
    segs = spark.createDataFrame([(i, i % 3, v.tolist()) for i, v in enumerate(x)], "row_id long, shard int, vector array<double>")
    path = str(tmp_path / "g")
    graph.build_stored(spark, segs, path, 2, 20, at_once=2, stop_after=1)
    assert graph.build_stored(spark, segs, path, 2, 20, at_once=2)
    kept = graph.load_stored(spark, segs, path, 2, 20, at_once=2)
    got = graph.search(kept, segs.filter("row_id % 60 = 0"), 10, 120, 2).collect()
    for i in range(0, 360, 60):
        score = np.round(x @ x[i], 9)
        score[i] = -9
        mine = sorted((r for r in got if r.query_row == i), key=lambda r: r.rank)
        assert [r.row_id for r in mine] == np.lexsort((np.arange(360), -score))[:10].tolist()


def test_new_nodes_meet_a_small_shard_in_a_matrix_product(monkeypatch):
    x = unit(700, 8, 50)

    def beam(*_):
        raise AssertionError("a beam")

    with monkeypatch.context() as m:
        m.setattr(graph.Shard, "beam", beam)
        g = graph.Shard(x, np.arange(700), 4, 20).extend(400)
    inserted = g.order[: g.done]
    assert 100 < g.done <= 400
    node, dist = g.met(x[:50], 0)
    best = np.argsort(1 - x[:50] @ x[inserted].T, 1)[:, :20]
    assert (node == inserted[best]).all() and (np.diff(dist, axis=1) >= 0).all()
    monkeypatch.setattr(graph, "MET", g.done)  # the rest goes by beams
    g.build()
    assert g.joined() and g.done == 700
    found = g.nearest(x[:50], 5, 700)[0]
    assert (found == np.argsort(1 - x[:50] @ x.T, 1)[:, :5]).all()


def test_links_are_chosen_as_one_by_one():
    x = unit(40 * 30, 6, 51).reshape(40, 30, 6)
    own = np.sort(np.random.default_rng(52).random((40, 30)), 1)
    own[:20, 25:] = np.inf
    apart = 1 - x @ x.transpose(0, 2, 1)
    take = graph.diverse(own, lambda rows: apart[rows], 7)
    for i in range(40):
        chosen = []
        for k in np.flatnonzero(np.isfinite(own[i])):
            if len(chosen) < 7 and not any(apart[i, j, k] < own[i, k] for j in chosen):
                chosen.append(k)
        assert np.flatnonzero(take[i]).tolist() == chosen
