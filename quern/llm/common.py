"""Pieces that the training-data operators share: tables, shared storage, Arrow helpers."""

from __future__ import annotations

import gc
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.sources.store import fresh_path, removed


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(df: DataFrame) -> DataFrame:
    """doc_id and text (null: empty); other columns, whatever their names, are left behind."""
    return df.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))


_PATHS: dict[int, tuple[DataFrame, str]] = {}


def dropped(*tables: DataFrame) -> None:
    """Remove tables of saved() that nothing will read again."""
    for df in tables:
        if found := _PATHS.pop(id(df), None):
            removed(df.sparkSession, found[1])


def released(spark: SparkSession) -> None:
    """Shuffle files of plans that nothing refers to any more go when the JVM notices: have it look now."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def saved(df: DataFrame, tag: str) -> DataFrame:
    """The frame as a table in the shared folder: lineage ends here, and a lost executor costs no recomputation."""
    spark = df.sparkSession
    released(spark)
    path = fresh_path(spark, tag)
    df.write.parquet(path)
    released(spark)
    out = spark.read.schema(df.schema).parquet(path)
    _PATHS[id(out)] = (out, path)
    return out


def strings(column: pa.Array) -> list[str]:
    return [x or "" for x in column.to_pylist()]


def batch(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def sliced(batches: Iterator[pa.RecordBatch], column: str, most_bytes: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of bounded text, so that a run of long documents does not fill a worker's memory."""
    for b in batches:
        n = b.num_rows
        if not n:
            continue
        each = max(1, int(most_bytes * n / max(1, b.column(column).nbytes)))
        for i in range(0, n, each):
            yield b.slice(i, each)
