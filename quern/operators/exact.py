"""Exact nearest windows and tracks, in blocks.

Queries and candidates are dealt out in blocks that meet each other once, so nothing that grows with the data is broadcast and
no pair of rows becomes a row: a meeting multiplies two matrices and hands on k rows a query. Candidates are dealt by track,
which lets a block finish a track's pooling. Scores are rounded to DIGITS before they are ranked; ties go to the smaller id.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.operators.tables import best_of

BLOCK_ROWS, BLOCK_QUERIES, DIGITS = 16_384, 4_096, 9
FOUND = pa.schema([("query_row", pa.int64()), ("track_id", pa.int64()), ("row_id", pa.int64()), ("score", pa.float64()), ("best", pa.float64())])


def matrix(column: pa.ChunkedArray) -> np.ndarray:
    """The vectors as rows; null ones, and such as differ in length, raise."""
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = flat.value_lengths().to_numpy(zero_copy_only=False)
    if len(sizes) and not (sizes == sizes[0]).all():
        raise ValueError("vectors must not be null, and all of one length")
    return flat.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(flat), -1)


def valid(q: np.ndarray, c: np.ndarray) -> None:
    """Queries must be finite, not zero and as long as the candidates, which must be finite."""
    if q.shape[1] != c.shape[1]:
        raise ValueError("queries and candidates differ in length")
    if not np.isfinite(q).all() or not q.any(1).all() or not np.isfinite(c).all():
        raise ValueError("vectors must be finite, and queries not zero")


def by_query(q: np.ndarray, keep: np.ndarray, *order: np.ndarray, k: int) -> np.ndarray:
    """Indices of the first k of each query, in the order given (last key first, as lexsort has it)."""
    at = np.lexsort((*order, q))
    start = np.flatnonzero(np.r_[True, q[at][1:] != q[at][:-1]]) if len(at) else np.zeros(0, np.int64)
    place = np.arange(len(at)) - np.repeat(start, np.diff(np.r_[start, len(at)]))
    return at[place < k]


def block(left: pa.Table, right: pa.Table, k: int, rule: str, exclude: str, threshold: float, top: int) -> pa.Table:
    """The k best rows (rule 'row') or tracks of a block for each query."""
    q_row, q_track = left.column("row_id").to_numpy(), left.column("track_id").to_numpy()
    order = np.lexsort((right.column("c_row_id").to_numpy(), right.column("c_track_id").to_numpy()))
    c_row, c_track = right.column("c_row_id").to_numpy()[order], right.column("c_track_id").to_numpy()[order]
    c, q = matrix(right.column("c_vector"))[order], matrix(left.column("vector"))
    valid(q, c)
    first = np.flatnonzero(np.r_[True, c_track[1:] != c_track[:-1]])
    parts = []
    for at in range(0, len(q), 512):
        s = np.round(q[at : at + 512] @ c.T, DIGITS)
        own_row, own_track = q_row[at : at + 512], q_track[at : at + 512]
        out = own_row[:, None] == c_row if exclude == "self" else own_track[:, None] == c_track if exclude == "track" else np.zeros(s.shape, bool)
        if rule == "row":
            s[out] = -np.inf
            if s.shape[1] > k:
                level = np.partition(s, s.shape[1] - k, axis=1)[:, s.shape[1] - k]
                i, j = np.nonzero((s >= level[:, None]) & ~out)
            else:
                i, j = np.nonzero(~out)
            score = best = s[i, j]
            pick = by_query(i, i, c_row[j], -score, k=k)
            i, j, score, best = i[pick], j[pick], score[pick], best[pick]
            track, row = c_track[j], c_row[j]
        else:
            sizes = np.diff(np.r_[first, len(c_track)])
            peak = np.maximum.reduceat(s, first, axis=1)
            # the first window that reaches the peak: the smallest row
            place = np.where(s == np.repeat(peak, sizes, axis=1), np.arange(len(c_row)), len(c_row))
            lead = np.minimum.reduceat(place, first, axis=1)
            if rule == "max":
                pooled = peak
            elif rule == "mean":
                pooled = np.round(np.add.reduceat(s, first, axis=1) / sizes, DIGITS)
            elif rule == "count":
                pooled = np.add.reduceat((s >= threshold).astype(float), first, axis=1)
            else:  # the mean of the best `top` windows, or of all when there are fewer
                group = np.broadcast_to(np.repeat(np.arange(len(first)), sizes), s.shape)
                falling = np.take_along_axis(s, np.lexsort((-s, group), axis=1), 1)
                early = np.arange(len(c_row)) - np.repeat(first, sizes) < top
                pooled = np.round(np.add.reduceat(np.where(early, falling, 0.0), first, axis=1) / np.minimum(sizes, top), DIGITS)
            i, j = np.nonzero(~out[:, first])
            score, best = pooled[i, j], peak[i, j]
            tie = -np.maximum(best, 0) if rule == "count" else np.zeros(len(best))
            track = c_track[first[j]]
            row = c_row[lead[i, j]]
            by = row if rule == "max" else track
            pick = by_query(i, i, by, tie, -score, k=k)
            i, score, best, track, row = i[pick], score[pick], best[pick], track[pick], row[pick]
        parts.append((own_row[i], track, row, score, best))
    return pa.Table.from_arrays([pa.array(np.concatenate(x)) for x in zip(*parts, strict=True)], schema=FOUND)


def topk(queries: DataFrame, candidates: DataFrame, k: int, rule: str = "row", exclude: str = "self", threshold: float = 0.2, top: int = 3) -> DataFrame:
    """query_row, rank, track_id, row_id, score and best.

    Both sides: row_id, track_id, vector. rule: 'row' ranks windows; 'max', 'mean', 'topk' and 'count' rank tracks by their
    windows' scores. exclude: 'self' (the query's row), 'track' (its track) or 'none'. row_id of a track is its best window.
    """
    size = candidates.agg(F.count("*").alias("n")).first().n
    asked = queries.agg(F.count("*").alias("n")).first().n
    c_parts, q_parts = max(1, -(-size // BLOCK_ROWS)), max(1, -(-asked // BLOCK_QUERIES))
    columns = ["row_id", "track_id", "vector"]
    left = queries.select(columns).withColumn("qb", F.pmod(F.xxhash64("row_id"), F.lit(q_parts)).cast("int")).withColumn("cb", F.explode(F.sequence(F.lit(0), F.lit(c_parts - 1))))
    renamed = candidates.select([F.col(c).alias(f"c_{c}") for c in columns])  # both sides may come from the same rows
    right = renamed.withColumn("cb", F.pmod(F.xxhash64("c_track_id"), F.lit(c_parts)).cast("int")).withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(q_parts - 1))))

    def run(a: pa.Table, b: pa.Table) -> pa.Table:
        return block(a, b, k, rule, exclude, threshold, top) if a.num_rows and b.num_rows else FOUND.empty_table()

    met = left.groupBy("qb", "cb").cogroup(right.groupBy("qb", "cb")).applyInArrow(run, "query_row long, track_id long, row_id long, score double, best double")
    tie = [F.desc(F.greatest("best", F.lit(0.0)))] if rule == "count" else []
    return best_of(met, ["query_row"], [F.desc("score"), *tie, F.col("row_id" if rule in ("row", "max") else "track_id")], k)
