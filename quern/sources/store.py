"""Sources and sinks: written tables, committed directories with a manifest, grouped CSV headers, files."""

from __future__ import annotations

import atexit
import contextlib
import csv
import json
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where none is set, a local master gets a folder of its
    own; on a cluster that would be another disk for each machine, so it raises there."""
    sc = spark.sparkContext
    if path := sc.getConf().get("spark.checkpoint.dir"):
        return path.rstrip("/")
    have = sc._jsc.sc().getCheckpointDir()
    if have.isDefined():
        return have.get().rstrip("/")
    if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    path = "file://" + tempfile.mkdtemp(prefix="quern-")
    sc.setCheckpointDir(path)
    return path


def removed(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def fresh_path(spark: SparkSession, tag: str) -> str:
    """A new place below the shared folder; it is removed when the driver ends."""
    path = f"{shared_dir(spark)}/quern-{tag}-{uuid.uuid4().hex}"

    def drop() -> None:
        with contextlib.suppress(Exception):
            removed(spark, path)

    atexit.register(drop)
    return path


def written(df: DataFrame, tag: str) -> DataFrame:
    """The frame as a table in the shared folder, removed when the driver ends."""
    path = fresh_path(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fingerprint(df: DataFrame) -> DataFrame:
    """n and digest of a table's rows, whatever their order."""
    row = F.xxhash64(F.to_json(F.struct(*[F.col(f"`{c}`") for c in sorted(df.columns)])))
    return df.agg(F.count("*").alias("n"), F.coalesce(F.sum(row.cast("decimal(38,0)")), F.lit(0)).cast("string").alias("digest"))


def exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def complete(spark: SparkSession, path: str) -> bool:
    """Whether a manifest was written, the last step of a commit."""
    return exists(spark, f"{path}/manifest/_SUCCESS")


def discard(spark: SparkSession, path: str) -> None:
    """Remove what a commit that did not finish has left; a complete directory is refused."""
    if complete(spark, path):
        raise ValueError(f"{path} is complete")
    removed(spark, path)


def commit(df: DataFrame, path: str, about: dict[str, str] | None = None) -> None:
    """Write data, then a manifest of count, digest, schema and what it is `about` (parameters, sources): a directory without
    a manifest is not complete. An existing one is refused."""
    df.write.mode("errorifexists").parquet(f"{path}/data")
    spark = df.sparkSession
    stored = spark.read.parquet(f"{path}/data")
    own = F.to_json(F.create_map(*[F.lit(x) for kv in sorted((about or {"": ""}).items()) for x in kv]))
    fingerprint(stored).withColumn("schema", F.lit(stored.schema.json())).withColumn("about", own).write.mode("errorifexists").json(f"{path}/manifest")


def load(spark: SparkSession, path: str, verify: bool = True, expect: dict[str, str] | None = None) -> DataFrame:
    """A committed table. A missing manifest, another schema, changed contents, or an `about` that differs from what is
    expected in any name raise: what was made from other sources or with other parameters is stale."""
    if not complete(spark, path):
        raise ValueError(f"{path} is not complete")
    manifest = spark.read.schema("n long, digest string, schema string, about string").json(f"{path}/manifest").collect()
    if len(manifest) != 1:
        raise ValueError(f"{path} is not complete")
    if expect is not None:
        have = json.loads(manifest[0].about or "{}")
        if stale := sorted(k for k in {*expect, *have} - {""} if have.get(k) != expect.get(k)):
            raise ValueError(f"{path} is stale: {', '.join(stale)}")
    df = spark.read.parquet(f"{path}/data")
    if df.schema.json() != manifest[0].schema:
        raise ValueError(f"{path} has another schema than its manifest")
    if verify and tuple(fingerprint(df).first()) != (manifest[0].n, manifest[0].digest):
        raise ValueError(f"{path} differs from its manifest")
    return df


def write_file(spark: SparkSession, path: str, text: str) -> None:
    """One small file, whole or not at all: it is written under another name and then takes the place of what was there."""
    sc = spark.sparkContext
    conf, jvm = sc._jsc.hadoopConfiguration(), sc._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), conf)
    draft = jvm.org.apache.hadoop.fs.Path(target.getParent(), f".{target.getName()}.{uuid.uuid4().hex}")
    out = target.getFileSystem(conf).create(draft, False)
    try:
        out.write(bytearray(text.encode("utf-8")))
        out.hsync()
    finally:
        out.close()
    overwrite = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    kinds = sc._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    kinds[0] = overwrite
    files.rename(draft, target, kinds)


def grouped_csv(spark: SparkSession, path: str, columns: dict[tuple[str, str], str], key: str = "track_id") -> DataFrame:
    """A CSV file under three header rows; columns are named by (group, field), the first is the key. Blank fields are null,
    rows without a key are skipped, a missing column raises. A record is a line, so the file is read in splits."""
    top = spark.read.text(path).limit(2).collect()  # the first two lines of the first split
    head = list(csv.reader([r.value for r in top]))
    place = {(g.strip(), f.strip()): k for k, (g, f) in enumerate(zip(*head, strict=True))} if len(head) == 2 else {}
    if missing := [k for k in columns if k not in place]:
        raise KeyError(f"columns missing: {missing}")
    names = [f"c{k}" for k in range(len(head[0]))]
    raw = spark.read.option("header", False).option("escape", '"').schema(", ".join(f"{n} string" for n in names)).csv(path)
    blank = lambda c: F.nullif(F.trim(F.col(c)), F.lit(""))
    out = raw.select(F.expr("try_cast(trim(c0) as long)").alias(key), *[blank(names[place[k]]).alias(n) for k, n in columns.items()])
    return out.filter(F.col(key).isNotNull())


def scan_files(spark: SparkSession, root: str, suffix: str = ".mp3") -> DataFrame:
    """track_id (the number that names the file), path and length of every file below root."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", f"*{suffix}").load(root)
    return files.select(F.regexp_extract("path", r"([0-9]+)\.[^./]+$", 1).cast("long").alias("track_id"), "path", "length")
