"""Resumable ingest: a stream over new files, exactly once by idempotent data and a marker written after it."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.sources.store import shared_dir


def ingest(stream: DataFrame, out: str, key: str = "track_id") -> None:
    """Run all that is available. Each batch writes its data in a folder of its own, then its markers; a batch that is run again
    after a crash overwrites both, so what has a marker has whole data, once."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/data/batch={number}")
        done = batch.sparkSession.read.parquet(f"{out}/data/batch={number}")
        done.select(key, "status").write.mode("overwrite").parquet(f"{out}/done/batch={number}")

    stream.writeStream.foreachBatch(write).option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).start().awaitTermination()


def ingested(spark: SparkSession, out: str) -> DataFrame:
    """Rows whose marker is there."""
    data = spark.read.parquet(f"{out}/data")
    done = spark.read.parquet(f"{out}/done").select("batch").distinct()
    return data.join(done, "batch", "left_semi").drop("batch")


def ingest_documents(spark: SparkSession, sf_dir: str, out: str | None = None) -> DataFrame:
    out = out or f"{shared_dir(spark)}/quern-ingest-{uuid.uuid4().hex}"
    docs = f"{sf_dir}/documents.parquet"
    stream = spark.readStream.schema(spark.read.parquet(docs).schema).parquet(docs[:-1] + "[t]")  # a pattern may match a file too
    ingest(stream.select(F.col("doc_id").alias("track_id"), F.lit("done").alias("status"), F.sha2("text", 256).alias("sha")), out)
    return ingested(spark, out)
