"""Tables of the model, from the driver's, and small relational helpers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.sources.store import written

WINDOWS = 5  #: windows of a track in the driver's embeddings
QUERY_EVERY = 100


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """row_id, track_id, window, genre and vector of every window."""
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias("row_id"), F.expr(f"vec_id div {WINDOWS}").alias("track_id"), (F.col("vec_id") % WINDOWS).cast("int").alias("window"), F.col("label").alias("genre"), F.col("embedding").cast("array<double>").alias("vector"))


def queries_of(segs: DataFrame) -> DataFrame:
    """The stated query set of searches: rows whose id is divisible by QUERY_EVERY."""
    return segs.filter(F.col("row_id") % QUERY_EVERY == 0)


def running(df: DataFrame, name: str, amount: Column, *order: Column | str) -> DataFrame:
    """df with the sum of `amount` over all rows before, in a total order, without moving all rows to one task.

    Range partitions are sorted and written once, each row with its partition and the sum before it there; how much each
    partition holds is then counted in what was written, so both come from one execution, whatever the sampled range bounds
    and however adaptive execution merges partitions. A row a partition is broadcast.
    """
    part = Window.partitionBy("_part").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    placed = df.withColumn("_amount", amount.cast("long")).repartitionByRange(*order).sortWithinPartitions(*order)
    placed = written(placed.withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id()), "placed")
    held = placed.groupBy("_part").agg(F.sum("_amount").alias("held"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row a partition
    base = held.select("_part", F.coalesce(F.sum("held").over(before), F.lit(0)).alias("_base"))
    inner = placed.withColumn("_inner", F.coalesce(F.sum("_amount").over(part), F.lit(0)))
    return inner.join(F.broadcast(base), "_part").withColumn(name, F.col("_inner") + F.col("_base")).drop("_part", "_at", "_amount", "_inner", "_base")


def numbered(df: DataFrame, name: str, *order: Column | str) -> DataFrame:
    """Dense numbers from 0 in a total order; see running(), of which only the place within a partition is simpler."""
    placed = df.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = written(placed.withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id() % (1 << 33)), "numbered")
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row a partition
    base = placed.groupBy("_part").agg(F.count("*").alias("held")).select("_part", F.coalesce(F.sum("held").over(before), F.lit(0)).alias("_base"))
    return placed.join(F.broadcast(base), "_part").withColumn(name, (F.col("_at") + F.col("_base")).cast("long")).drop("_part", "_at", "_base")


def quantiles(df: DataFrame, keys: list[str], value: str, at: dict[str, float], tie: str) -> DataFrame:
    """keys and, for each name of `at`, that quantile of the values by linear interpolation, null values aside.

    Rows are numbered in the order of keys and values, so no task sees a whole group; the two rows on either side of each wanted
    place are picked by number, for which a row a group and name is broadcast.
    """
    rows = written(numbered(df.filter(F.col(value).isNotNull()).select(*keys, value, tie), "_n", *keys, value, tie), "ordered")
    sizes = rows.groupBy(*keys).agg(F.min("_n").alias("_first"), F.count("*").alias("_count"))
    names = F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.lit(float(p)).alias("p")) for n, p in at.items()]))
    spots = sizes.withColumn("_q", names).withColumn("_spot", F.col("_q.p") * (F.col("_count") - 1)).withColumn("_low", F.floor("_spot"))
    both = F.explode(F.array_distinct(F.array(F.col("_low"), F.ceil("_spot"))))
    wanted = spots.select(*[F.col(k).alias(f"_k_{k}") for k in keys], F.col("_q.name").alias("_name"), (F.col("_spot") - F.col("_low")).alias("_part"), F.col("_low"), "_first", both.alias("_at")).withColumn("_n", F.col("_first") + F.col("_at"))
    met = rows.join(F.broadcast(wanted), "_n")
    ends = met.groupBy(*keys, "_name", "_part").agg(F.min_by(value, "_n").alias("lo"), F.max_by(value, "_n").alias("hi"))
    return ends.groupBy(*keys).pivot("_name", list(at)).agg(F.first(F.col("lo") * (1 - F.col("_part")) + F.col("hi") * F.col("_part")))


def best_of(df: DataFrame, keys: list[str], order: list[Column], k: int, rank: str = "rank") -> DataFrame:
    """The first k rows of each key in a total order."""
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col(rank) <= k)


def last_of(df: DataFrame, key: str, version: str) -> DataFrame:
    """Of rows that repeat a key, the one with the largest version."""
    rest = [c for c in df.columns if c not in (key, version)]
    last = F.max_by(F.struct(*rest), version).alias("_row")
    return df.groupBy(key).agg(F.max(version).alias(version), last).select(key, version, "_row.*")


def upserted(old: DataFrame, new: DataFrame, key: str, version: str) -> DataFrame:
    """Rows of new replace those of old with the same key; of new rows that repeat a key, that with the largest version counts."""
    last = last_of(new, key, version).drop(version)
    return old.join(last.select(key), key, "left_anti").unionByName(last)


def required(df: DataFrame, ok: Column, message: str) -> DataFrame:
    """df, failing where `ok` does not hold; null counts as not holding."""
    return df.filter(F.when(ok, F.lit(True)).otherwise(F.raise_error(F.lit(message)).cast("boolean")))
