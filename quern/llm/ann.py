"""Operator 1: approximate nearest neighbours by cross-polytope hashing.

A rotation's hash of a unit vector is the signed axis nearest to it after a pseudo-random rotation: three rounds of random signs
and a fast Hadamard transform. A table hashes by several rotations one after the other, as many axes as make one or two cells
for each vector (the last rotation takes part of the axes), so that cells stay small however many vectors there are. A query
probes, in each table, the cells of the largest sums of its components on their axes, PROBES of them for each cell that a table has
for a vector; vectors in those cells are scored exactly and the k best of all tables kept. For the largest inner product among vectors of any length, a candidate x gets one
component more, sqrt(1 - |x|^2 / m^2) with m the largest length, and is divided by m; if all are of one length there is none.

Cells that share their leading axes make a group of about BLOCK vectors. A query is sent once to each group that holds a cell
it probes; the group's task finds the cells again from the vector. A group over twice BLOCK vectors,
or sought by over ASKED_AT_ONCE queries, is dealt out in parts that meet each other once, and each meeting hands on k rows a query. Of
equal vectors, the k + 1 smallest ids alone are kept: no other can be among the k best, as ties go to the smaller id, so a
group of copies of any size is a few rows. Queries that have found fewer than k go through all vectors, in blocks, so a small
table is searched whole.

Vectors that are null, empty or zero, or hold a null, NaN or infinite component, take no part, neither do null ids; shorter
vectors count as padded with zeros. A query's own row is whatever has its id; equal vectors under other ids are candidates, ties
go to the smaller id. Ids that repeat are one candidate each time but fill one rank. Other columns are left behind.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.llm.common import saved

TABLES, PROBES, SEED = 20, 180, 20
#: Vectors of a group, queries that meet a group at once, and both sides of a block where queries go through all vectors.
BLOCK, ASKED_AT_ONCE, WHOLE = 65_536, 16_384, 16_384
FEWEST = 256  #: cells that a table has
KEYS = ("tab", "grp", "c", "q")
FOUND = "query_id long, vec_id long, score double, scored long"
_FOUND = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64()), ("scored", pa.int64())])


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of each row, scaled to keep lengths."""
    n, d = x.shape
    x = x.copy()
    half = 1
    while half < d:
        y = x.reshape(n, d // (2 * half), 2, half)
        a, b = y[:, :, 0].copy(), y[:, :, 1].copy()
        y[:, :, 0], y[:, :, 1] = a + b, a - b
        half *= 2
    return x / np.sqrt(d)


@dataclass(frozen=True)
class Shape:
    """How tables hash: the width of rotations (a power of two), the bits of each rotation's axes, and of a group's number, and
    how many cells a query probes."""

    width: int
    bits: tuple[int, ...]
    group: int
    probes: int

    @property
    def total(self) -> int:
        return sum(self.bits)


def shape_of(n: int, width: int) -> Shape:
    whole = (2 * width).bit_length() - 1
    want = max(FEWEST.bit_length() - 1, (max(n, 2) - 1).bit_length())
    bits = [whole] * (want // whole) + ([want % whole] if want % whole else [])
    return Shape(width, tuple(bits), min(sum(bits), max(0, (-(-n // BLOCK) - 1).bit_length())), min(1 << want, -(-PROBES * (1 << want) // max(n, 1))))


@lru_cache(maxsize=8)
def signs(width: int, tables: int, rotations: int, seed: int = SEED) -> np.ndarray:
    return np.random.default_rng(seed).choice([-1.0, 1.0], (tables, rotations, 3, width))


def components(x: np.ndarray, shape: Shape, table: int) -> list[np.ndarray]:
    """For each rotation of a table, each row's components on its axes: the first ones, then their opposites."""
    out = []
    for rounds, b in zip(signs(shape.width, TABLES, len(shape.bits))[table], shape.bits, strict=True):
        y = x
        for s in rounds:
            y = hadamard(y * s)
        y = y[:, : 1 << (b - 1)]
        out.append(np.concatenate([y, -y], 1))
    return out


def cells(x: np.ndarray, shape: Shape, table: int) -> np.ndarray:
    code = np.zeros(len(x), np.int64)
    for y, b in zip(components(x, shape, table), shape.bits, strict=True):
        code = code << b | y.argmax(1)
    return code


@lru_cache(maxsize=64)
def leading(n: int, m: int, count: int) -> tuple[np.ndarray, np.ndarray]:
    """Places in two falling lists of n and m numbers whose sums can be among the `count` largest: those before them, at the same
    place or earlier in both lists, are no smaller."""
    i, j = np.nonzero(np.arange(1, n + 1)[:, None] * np.arange(1, m + 1) <= count)
    return i, j


def probed(parts: list[np.ndarray], shape: Shape) -> np.ndarray:
    """The cells of the largest sums of each row's components, one axis from each rotation: rows x probes."""
    total, code = np.zeros((len(parts[0]), 1)), np.zeros((len(parts[0]), 1), np.int64)
    for y, b in zip(parts, shape.bits, strict=True):
        order = np.argsort(-y, 1, kind="stable")
        i, j = leading(total.shape[1], y.shape[1], shape.probes)
        sums = total[:, i] + np.take_along_axis(y, order, 1)[:, j]
        if sums.shape[1] > shape.probes:
            best = np.argpartition(-sums, shape.probes - 1, axis=1)[:, : shape.probes]
        else:
            best = np.tile(np.arange(sums.shape[1]), (len(sums), 1))
        best = np.take_along_axis(best, np.argsort(-np.take_along_axis(sums, best, 1), 1, kind="stable"), 1)
        total = np.take_along_axis(sums, best, 1)
        code = np.take_along_axis(code[:, i] << b | order[:, j], best, 1)
    return code


def matrix(column: pa.Array, width: int) -> np.ndarray:
    flat, sizes = column.flatten().to_numpy(zero_copy_only=False).astype(float), column.value_lengths().to_numpy(zero_copy_only=False)
    out = np.zeros((len(sizes), width))
    out[np.arange(width) < sizes[:, None]] = flat
    return out


def unit(x: np.ndarray, width: int, longest: float | None) -> np.ndarray:
    """Queries (no `longest`) and candidates as unit vectors; the component at `width` makes up a candidate's length, where the
    shape has room for it."""
    if longest is None:
        return x / np.linalg.norm(x, axis=1)[:, None]
    x = x / longest
    if x.shape[1] > width:
        x[:, width] = np.sqrt(np.maximum(0.0, 1.0 - (x**2).sum(1)))
    return x


PLACED = "tab int, grp int, cell long, vec_id long, vector {0}"
ASKED = "tab int, grp int, vec_id long, vector {0}"


def _rows(batch: pa.RecordBatch, row: np.ndarray, tab: int, grp: np.ndarray, cell: np.ndarray | None = None) -> pa.RecordBatch:
    take = pa.array(row)
    columns = {"tab": pa.array(np.full(len(row), tab), pa.int32()), "grp": pa.array(grp, pa.int32()), "cell": None if cell is None else pa.array(cell), "vec_id": batch.column("vec_id").take(take), "vector": batch.column("vector").take(take)}
    return pa.RecordBatch.from_pydict({k: v for k, v in columns.items() if v is not None})


def placed(vectors: DataFrame, shape: Shape, width: int, longest: float) -> DataFrame:
    """Each vector once for every table, with its cell and group there."""

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, 2048):
                part = b.slice(at, 2048)
                x = unit(matrix(part.column("vector"), shape.width), width, longest)
                for t in range(TABLES):
                    code = cells(x, shape, t)
                    yield _rows(part, np.arange(len(x)), t, code >> (shape.total - shape.group), code)

    return vectors.mapInArrow(run, PLACED.format(vectors.schema["vector"].dataType.simpleString()))


def asking(vectors: DataFrame, shape: Shape) -> DataFrame:
    """Each query once for every group that holds a cell which it probes."""

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                x = unit(matrix(part.column("vector"), shape.width), 0, None)
                for t in range(TABLES):
                    groups = np.sort(probed(components(x, shape, t), shape) >> (shape.total - shape.group), 1)
                    row, c = np.nonzero(np.diff(groups, axis=1, prepend=-1))
                    yield _rows(part, row, t, groups[row, c])

    return vectors.mapInArrow(run, ASKED.format(vectors.schema["vector"].dataType.simpleString()))


def firsts(query: int, ids: np.ndarray, q: np.ndarray, c: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """ids and scores of the k best of a query's candidates. Products are summed left to right in double precision."""
    s = c @ q
    near = ids != query
    if near.sum() > k:
        level = np.partition(s[near], near.sum() - k)[near.sum() - k]
        near &= s >= level - 1e-9 * (1 + abs(level))
    at = np.flatnonzero(near)
    score = np.zeros(len(at))
    for d in range(len(q)):
        score += q[d] * c[at, d]
    order = np.lexsort((ids[at], -score))[:k]
    return ids[at[order]], score[order]


def probe(queries: DataFrame, candidates: DataFrame, shape: Shape, width: int, k: int) -> DataFrame:
    """The k best of what each query finds in each group, and a row without an id for how many it scored there."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return _FOUND.empty_table()
        right = right.sort_by("cell")
        cell, ids = right.column("cell").to_numpy(), right.column("vec_id").to_numpy()
        c, q = (matrix(t.column("vector").combine_chunks(), width) for t in (right, left))
        asked, table, group = left.column("vec_id").to_numpy(), left.column("tab")[0].as_py(), left.column("grp")[0].as_py()
        out: list[tuple] = []
        for i in range(len(q)):
            if i % 256 == 0:
                some = unit(np.pad(q[i : i + 256], ((0, 0), (0, shape.width - width))), 0, None)
                all_ = probed(components(some, shape, table), shape)
            wanted = all_[i % 256]
            wanted = np.sort(wanted[wanted >> (shape.total - shape.group) == group])
            lo, hi = np.searchsorted(cell, wanted, "left"), np.searchsorted(cell, wanted, "right")
            n = hi - lo
            at = np.repeat(lo - np.cumsum(n) + n, n) + np.arange(n.sum())
            found, score = firsts(asked[i], ids[at], q[i], c[at], k)
            out.append((np.full(len(found) + 1, asked[i]), np.append(found.astype(object), None), np.append(score.astype(object), None), np.append(np.zeros(len(found), np.int64), len(at))))
        return pa.Table.from_arrays([pa.array(np.concatenate(x), f.type) for x, f in zip(zip(*out, strict=True), _FOUND, strict=True)], schema=_FOUND)

    return queries.groupBy(*KEYS).cogroup(candidates.groupBy(*KEYS)).applyInArrow(run, FOUND)


def best(query_ids: np.ndarray, q: np.ndarray, ids: np.ndarray, c: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    """The k best of the candidates for each query: query, candidate, score. Products are summed left to right in double precision."""
    parts = []
    for at in range(0, len(q), 256):
        s = q[at : at + 256] @ c.T
        own = query_ids[at : at + 256, None] == ids[None, :]
        s[own] = -np.inf
        if s.shape[1] > k:
            level = np.partition(s, s.shape[1] - k, axis=1)[:, s.shape[1] - k]
            near = s >= (level - 1e-9 * (1 + np.abs(level)))[:, None]
        else:
            near = np.ones(s.shape, bool)
        i, j = np.nonzero(near & ~own)
        score = np.zeros(len(i))
        for d in range(q.shape[1]):
            score += q[at + i, d] * c[j, d]
        order = np.lexsort((ids[j], -score, i))
        i, j, score = i[order], j[order], score[order]
        start = np.searchsorted(i, np.arange(len(s)))
        keep = np.arange(len(i)) - start[i] < k
        parts.append((query_ids[at + i[keep]], ids[j[keep]], score[keep]))
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def meet(queries: DataFrame, candidates: DataFrame, keys: tuple[str, ...], width: int, k: int) -> DataFrame:
    """Exact scores within each key; both sides have the keys, vec_id and vector, and at most WHOLE rows or so a key."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if left.num_rows and right.num_rows:
            q, c = (matrix(t.column("vector").combine_chunks(), width) for t in (left, right))
            found = best(left.column("vec_id").to_numpy(), q, right.column("vec_id").to_numpy(), c, k)
        else:
            found = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        scored = np.zeros(len(found[0]), np.int64)
        if left.num_rows and right.num_rows:
            own = left.column("vec_id").to_numpy()
            none = pa.nulls(len(own), pa.int64())
            marks = pa.Table.from_arrays([pa.array(own), none, pa.nulls(len(own), pa.float64()), pa.array(np.full(len(own), right.num_rows))], schema=_FOUND)
        else:
            marks = _FOUND.empty_table()
        return pa.concat_tables([pa.Table.from_arrays([pa.array(x) for x in (*found, scored)], schema=_FOUND), marks])

    return queries.groupBy(*keys).cogroup(candidates.groupBy(*keys)).applyInArrow(run, FOUND)


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id and vector (of 32-bit floats, if it is so) of the rows that take part, repeated rows once."""
    kind = "array<float>" if vectors.schema["vector"].dataType.simpleString() == "array<float>" else "array<double>"
    plain = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("vector").cast(kind).alias("vector"))
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return plain.filter(F.col("vec_id").isNotNull() & F.col("vector").isNotNull() & finite & F.exists("vector", lambda x: x != 0)).distinct()


def ranked(found: DataFrame, k: int) -> DataFrame:
    """The k best of each query, and how many candidates were scored for it, in all tables."""
    once = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"), F.sum("scored").alias("scored"))
    own = Window.partitionBy("query_id")
    once = once.withColumn("scored", F.sum("scored").over(own)).filter("vec_id is not null")
    return once.withColumn("rank", F.row_number().over(own.orderBy(F.desc("score"), "vec_id"))).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score", "scored")


def spread(df: DataFrame, rows: int, each: int) -> DataFrame:
    """The rows over enough tasks for `each` in one, but no more tasks than a shuffle has."""
    want = min(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows // each))
    return df if df.rdd.getNumPartitions() >= want else df.repartition(want, "vec_id")


def salt(parts: Column) -> Column:
    return F.pmod(F.xxhash64("vec_id"), parts).cast("int")


def nearest(vectors: DataFrame, is_query: Column, k: int) -> DataFrame:
    """query_id, rank, vec_id, score and scored (candidates that the query was compared with, one in several tables each time).
    vectors: vec_id and vector; is_query: over vec_id."""
    every = saved(usable(vectors), "vectors")
    length = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    size = every.agg(F.count("*").alias("n"), F.max(F.size("vector")).alias("width"), F.max(length).alias("longest"), F.min(length).alias("shortest")).first()
    if not size.n:
        return every.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double, scored long")
    # of equal vectors, those that can be among the k best of any query; partial limits come before the shuffle
    rows = saved(every.withColumn("_r", F.row_number().over(Window.partitionBy("vector").orderBy("vec_id"))).filter(F.col("_r") <= k + 1).drop("_r"), "candidates")
    asked = every.filter(is_query)
    n_asked = asked.count()
    even = size.shortest >= size.longest * (1 - 1e-6)
    shape = shape_of(size.n, 1 << (size.width - 1 if even else size.width).bit_length())
    own, probing = placed(spread(rows, size.n, 4_096), shape, size.width, size.longest), asking(spread(asked, n_asked, 256), shape)
    # a row for each group of each table
    held = own.groupBy("tab", "grp").agg(F.greatest(F.lit(1), F.round(F.count("*") / BLOCK)).cast("int").alias("c_parts"))
    sought = probing.groupBy("tab", "grp").agg(F.ceil(F.count("*") / ASKED_AT_ONCE).cast("int").alias("q_parts"))
    parts = saved(held.join(sought, ["tab", "grp"]), "groups")
    left = probing.join(parts, ["tab", "grp"]).withColumn("q", salt(F.col("q_parts"))).withColumn("c", F.explode(F.sequence(F.lit(0), F.col("c_parts") - 1)))
    right = own.join(parts, ["tab", "grp"]).withColumn("c", salt(F.col("c_parts"))).withColumn("q", F.explode(F.sequence(F.lit(0), F.col("q_parts") - 1)))
    found = saved(ranked(probe(left.select(*KEYS, "vec_id", "vector"), right.select(*KEYS, "cell", "vec_id", "vector"), shape, size.width, k), k), "found")
    few = saved(asked.join(found.groupBy(F.col("query_id").alias("vec_id")).count().filter(F.col("count") >= min(k, size.n - 1)), "vec_id", "left_anti"), "few")
    n = few.count()
    if not n:
        return found
    c_parts, q_parts = -(-size.n // WHOLE), -(-n // WHOLE)
    left = few.withColumn("q", salt(F.lit(q_parts))).withColumn("c", F.explode(F.sequence(F.lit(0), F.lit(c_parts - 1))))
    right = rows.withColumn("c", salt(F.lit(c_parts))).withColumn("q", F.explode(F.sequence(F.lit(0), F.lit(q_parts - 1))))
    whole = meet(left, right, ("c", "q"), size.width, k)
    return found.join(few.select(F.col("vec_id").alias("query_id")).distinct(), "query_id", "left_anti").unionByName(ranked(whole, k))
