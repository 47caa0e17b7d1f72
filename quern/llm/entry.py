"""Queries of the training-data operators, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm import ann, decontam, html, lm, neardup, secrets, sentpiece, suffix, tokenbin, toxicity
from quern.llm.common import table


def remainder(modulus: int):
    return F.crc32(F.col("doc_id").cast("string")) % modulus


def op1_cross_polytope(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("vector"))
    return ann.nearest(vectors, F.col("vec_id") % 20 == 0, k=20)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = toxicity.fit(docs, labels, remainder(4) != 2)
    rows = docs.select("doc_id", F.coalesce(remainder(4) == 2, F.lit(False)).alias("held_out"), "text")
    return toxicity.score(rows, model).drop("text")


def op3_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return lm.score(docs, F.coalesce(remainder(7) == 2, F.lit(False)))


def op4_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.classes(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "class_size")


def op5_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.without_repeats(table(spark, sf_dir, "documents"))


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenbin.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentpiece.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.find(table(spark, sf_dir, "documents"))


def op9_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(table(spark, sf_dir, "pages"))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    ours = (op1_cross_polytope, op2_toxicity, op3_language_model, op4_order_minhash, op5_repeated_passages, op6_token_files, op7_sentencepiece, op8_secrets, op9_main_text, op10_decontamination)
    return {f.__name__: f for f in ours}


def oracle_sql() -> dict[str, str]:
    """None of the ten can be said in SQL over whole tables; tests/llm compares them with brute force."""
    return {}
