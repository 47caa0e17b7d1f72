"""Operator 5: passages of LENGTH bytes that an earlier document has too, by column-wise construction of a collection's
Burrows-Wheeler order.

Inserting one symbol of every document a round takes as many rounds as the longest document has bytes, and every round reads
the whole transform. So the documents are cut first, without losing a match: each window of LENGTH bytes belongs to its
minimizer, the first of its GRAM-byte strings with the smallest hash. Windows that match have the same minimizer at the same
offset; windows in a row with the same minimizer make one segment, aligned at it. Only minimizers that different texts share
matter, and each of them is a collection of its own: its segments, of 2 * LENGTH - GRAM bytes at most.

A collection is built right to left. Every round reads the next column of symbols, one of each segment, from a file written in
column order, sorts it stably into the order so far (equal symbols keep the order of what follows them) and renews the common
prefixes of neighbours: one more than the smallest between them in the round before where the symbols agree, else none. The
round's part of the transform (the symbols that stand before the sorted strings) and its common prefixes are appended to a second file. As segments are
aligned, strings can only match within a column, so the order of the current column is all that a round needs of the one before.
Neighbours with a common prefix of LENGTH are the same window; the smallest doc_id among them keeps it. Both files lie in the
shared folder, are read and written from one end to the other, and go when their collections are done; a task that is run again
uses names of its own.

Null and empty texts have no bytes; texts under LENGTH bytes lose nothing. Equal texts are taken once, for their smallest
doc_id; the others go entirely, if long enough. Rows that repeat a doc_id never remove anything from each other. Null doc_ids
count as smaller than all others.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import dropped, fresh_path, released, saved, sliced, strings, texts
from quern.llm.neardup import mix
from quern.llm.tokenbin import opened

LENGTH, GRAM = 50, 16
#: Segments that one construction takes together; a minimizer's segments are never parted.
TOGETHER = 100_000
_ODD = np.uint64(0x9E3779B97F4A7C15)
NO_ID = -(2**63)


def minimizers(docs: list[bytes], length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """Segments of the documents: document, hash of the minimizer, its place, first and last start of a window of it."""
    empty = (np.zeros(0, np.int64), np.zeros(0, np.uint64), *(np.zeros(0, np.int64) for _ in range(3)))
    sizes = np.array([len(d) for d in docs], np.int64)
    text = np.frombuffer(b"".join(docs) + bytes(16), np.uint8)
    n = len(text) - 16
    if n < length:
        return empty
    words = np.lib.stride_tricks.as_strided(text.view(np.uint8), (n + 8, 8), (1, 1)).copy().view("<u8").ravel()
    if gram != 16:  # fewer bytes: the second word begins earlier
        grams = mix(words[:n] * _ODD) + words[gram - 8 : gram - 8 + n]
    else:
        grams = mix(words[:n] * _ODD) + words[8 : 8 + n]
    value = mix(grams)[: n - gram + 1]
    place = np.arange(len(value))
    span = length - gram + 1
    reach = 1
    while reach * 2 <= span:
        ahead = value[reach:] < value[:-reach]
        value, place = np.where(ahead, value[reach:], value[:-reach]), np.where(ahead, place[reach:], place[:-reach])
        reach *= 2
    if rest := span - reach:
        ahead = value[rest:] < value[:-rest]
        value, place = np.where(ahead, value[rest:], value[:-rest]), np.where(ahead, place[rest:], place[:-rest])
    ends = np.cumsum(sizes)
    owner = np.repeat(np.arange(len(docs)), sizes)[: len(value)]
    start = np.flatnonzero(np.arange(len(value)) + length <= ends[owner])
    if not len(start):
        return empty
    place, value, owner = place[start], value[start], owner[start]
    first = np.flatnonzero(np.r_[True, (place[1:] != place[:-1]) | (owner[1:] != owner[:-1])])
    last = np.r_[first[1:], len(start)] - 1
    base = (ends - sizes)[owner[first]]
    return owner[first], value[first], place[first] - base, start[first] - base, start[last] - base


def earliest(group: np.ndarray, doc: np.ndarray, column, low: np.ndarray, high: np.ndarray, width: int, length: int = LENGTH, keep=None) -> Iterator[tuple[int, np.ndarray]]:
    """For each column, from the right, the strings whose window from there an earlier document has as well.

    group: ascending numbers of the collections; column(j): symbols of column j, by string; low, high: columns in which a
    string's windows begin. A string's symbols outside of its windows count as different from all others. keep(symbols, prefixes)
    takes up the transform: the symbols in the order of what follows them, and the common prefixes of the new order.
    """
    m = len(group)
    order, prefix = np.arange(m), np.zeros(m + 1, np.int64)
    for j in range(width - 1, -1, -1):
        inside = (low <= j) & (j < high + length)
        symbol = np.where(inside, column(j).astype(np.int64), 256)
        key = group[order] * 257 + symbol[order]
        before = symbol[order]
        move = np.argsort(key, kind="stable")
        key, order = key[move], order[move]
        same = np.r_[False, (key[1:] == key[:-1]) & (symbol[order[1:]] < 256)]
        renewed = np.zeros(m + 1, np.int64)
        at = np.flatnonzero(same)
        if len(at):
            bounds = np.stack([move[at - 1] + 1, move[at] + 1], 1).ravel()
            renewed[at] = 1 + np.minimum.reduceat(prefix, bounds)[::2]
        prefix = np.minimum(renewed, length)
        if keep is not None:
            keep(before, prefix[:-1])
        begins = (low <= j) & (j <= high)
        if begins.any():
            run = np.cumsum(prefix[:-1] < length) - 1
            least = np.full(run[-1] + 1, np.iinfo(np.int64).max)
            on = begins[order]
            np.minimum.at(least, run[on], doc[order[on]])
            late = on & (doc[order] > least[run])
            yield j, order[late]


SEGMENTS = "h long, doc long, id long, at int, low int, high int, bytes binary"


def shared_anchors(rows: DataFrame) -> DataFrame:
    """(doc, id, at, h) of the minimizers that different texts share; of equal texts, the smallest doc alone."""

    def find(batches):
        for b in sliced(batches, "text", 1 << 20):
            owner, h, at, _, _ = minimizers([t.encode("utf-8", "surrogatepass") for t in strings(b.column("text"))])
            take = pa.array(owner)
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), b.column("doc").take(take), b.column("id").take(take), pa.array(at, pa.int32())], names=["h", "doc", "id", "at"])

    def share(batches):
        """Runs of a minimizer in a stream sorted by it; a run that a batch cuts is held together."""
        held: list[np.ndarray] = []

        def flush(rows: np.ndarray):
            new = np.flatnonzero(np.r_[True, rows[1:, 0] != rows[:-1, 0]])
            run = np.repeat(np.arange(len(new)), np.diff(np.r_[new, len(rows)]))
            lead = np.r_[True, (rows[1:, 0] != rows[:-1, 0]) | (rows[1:, 1] != rows[:-1, 1])]
            texts_in = np.bincount(run, lead)
            # within a run, rows of equal texts stand together, the smallest doc first; it may have several places
            first = np.maximum.accumulate(np.where(lead, np.arange(len(rows)), 0))
            keep = (texts_in[run] > 1) & (rows[:, 2] == rows[first, 2])
            r = rows[keep]
            return pa.RecordBatch.from_arrays([pa.array(r[:, 2]), pa.array(r[:, 1]), pa.array(r[:, 3].astype(np.int32)), pa.array(r[:, 0])], names=["doc", "id", "at", "h"])

        for b in batches:
            if not b.num_rows:
                continue
            rows = np.stack([b.column(c).to_numpy() for c in ("h", "id", "doc", "at")], 1).astype(np.int64)
            cut = int(np.searchsorted(rows[:, 0], rows[-1, 0]))  # the last run may go on
            if cut:
                yield flush(np.concatenate([*held, rows[:cut]]))
                held = []
            held.append(rows[cut:])
        if held:
            yield flush(np.concatenate(held))

    anchors = rows.select("doc", "id", "text").mapInArrow(find, "h long, doc long, id long, at int")
    sorted_ = anchors.repartition("h").sortWithinPartitions("h", "id", "doc")
    return sorted_.mapInArrow(share, "doc long, id long, at int, h long")


def segments(rows: DataFrame, anchors: DataFrame) -> DataFrame:
    """The segments of the shared minimizers: of each text, by its first doc."""
    wanted = anchors.groupBy("doc", "id").agg(F.collect_list("at").alias("places"))  # as many as a text has at most

    def cut(batches):
        for b in sliced(batches, "text", 1 << 20):
            docs = [t.encode("utf-8", "surrogatepass") for t in strings(b.column("text"))]
            owner, h, at, low, high = minimizers(docs)
            places = b.column("places")
            flat, sizes = places.flatten().to_numpy().astype(np.int64), places.value_lengths().to_numpy()
            asked = np.repeat(np.arange(len(docs)), sizes) * (1 << 40) + flat
            k = np.flatnonzero(np.isin(owner * (1 << 40) + at, asked))
            raw = [docs[o][x : y + LENGTH] for o, x, y in zip(owner[k].tolist(), low[k].tolist(), high[k].tolist(), strict=True)]
            take = pa.array(owner[k])
            yield pa.RecordBatch.from_arrays([pa.array(h[k].view(np.int64)), b.column("doc").take(take), b.column("id").take(take), *(pa.array(x[k], pa.int32()) for x in (at, low, high)), pa.array(raw, pa.binary())], names=["h", "doc", "id", "at", "low", "high", "bytes"])

    return rows.join(wanted, ["doc", "id"]).select("doc", "id", "text", "places").mapInArrow(cut, SEGMENTS)


def construct(h: np.ndarray, doc: np.ndarray, at: np.ndarray, low: np.ndarray, high: np.ndarray, raw: list[bytes], path: str) -> np.ndarray:
    """Which windows of each segment (row: segment, column: place before the minimizer) an earlier document has. Files go below
    `path`."""
    ahead, width = LENGTH - GRAM, 2 * LENGTH - GRAM
    first, last = low - at + ahead, high - at + ahead
    late = np.zeros((len(h), ahead + 1), bool)
    # equal segments of a minimizer are inserted once, for the smallest doc
    padded = np.zeros((len(h), width), np.uint8)
    sizes = np.array([len(r) for r in raw], np.int64)
    cells = np.repeat(np.arange(len(h)) * width + first, sizes) + np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    padded.ravel()[cells] = np.frombuffer(b"".join(raw), np.uint8)
    whole = np.concatenate([h.astype(">i8").view(np.uint8).reshape(-1, 8), np.stack([first, last], 1).astype(np.uint8), padded], 1)
    whole = np.ascontiguousarray(whole).view(f"V{width + 10}").ravel()
    _, one, which = np.unique(whole, return_index=True, return_inverse=True)
    which = which.ravel()
    smallest = np.full(len(one), np.iinfo(np.int64).max)
    np.minimum.at(smallest, which, doc)
    kept, low1, high1 = h[one], first[one], last[one]
    order = np.argsort(kept, kind="stable")
    kept, low1, high1, docs1 = kept[order], low1[order], high1[order], smallest[order]
    group = np.cumsum(np.r_[0, kept[1:] != kept[:-1]])
    late1 = np.zeros((len(one), ahead + 1), bool)
    where, base = opened(path)
    where.create_dir(base, recursive=True)
    name = f"{base}/{uuid.uuid4().hex}"
    with where.open_output_stream(f"{name}.columns") as file:  # in the order in which the rounds read them
        file.write(np.ascontiguousarray(padded[one][order].T[::-1]).tobytes())
    try:
        with where.open_input_stream(f"{name}.columns") as file, where.open_output_stream(f"{name}.transform") as transform:
            column = lambda j: np.frombuffer(file.read(len(one)), np.uint8)  # noqa: E731, ARG005

            def keep(symbols: np.ndarray, prefixes: np.ndarray) -> None:
                transform.write(symbols.astype("<u2").tobytes())
                transform.write(prefixes.astype(np.uint8).tobytes())

            for j, strings_late in earliest(group, docs1, column, low1, high1, width, keep=keep):
                late1[strings_late, j] = True
    finally:
        for kind in ("columns", "transform"):
            where.delete_file(f"{name}.{kind}")
    back = np.empty(len(one), np.int64)
    back[order] = np.arange(len(one))
    at1 = back[which]
    late[:] = late1[at1]
    # a segment that a smaller doc has entirely
    late |= (doc > smallest[which])[:, None] & (np.arange(ahead + 1) >= first[:, None]) & (np.arange(ahead + 1) <= last[:, None])
    return late


def repeats(parts: DataFrame) -> DataFrame:
    """(doc, id, start, end) of bytes to remove, from segments."""
    path = fresh_path(parts.sparkSession, "collections")

    def build(batches):
        held: list[pa.RecordBatch] = []

        def flush():
            t = pa.Table.from_batches(held)
            num = {c: t.column(c).to_numpy().astype(np.int64) for c in ("h", "doc", "id", "at", "low", "high")}
            late = construct(num["h"], num["doc"], num["at"], num["low"], num["high"], t.column("bytes").to_pylist(), path)
            edge = np.diff(np.pad(late.astype(np.int8), ((0, 0), (1, 1))), axis=1)
            row, start = np.nonzero(edge == 1)
            _, end = np.nonzero(edge == -1)
            base = num["at"][row] - (LENGTH - GRAM)
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(num["doc"][row]), pa.array(num["id"][row]), pa.array(base + start, pa.int32()), pa.array(base + end - 1 + LENGTH, pa.int32())], names=["doc", "id", "start", "end"])

        n = 0
        for b in batches:
            if not b.num_rows:
                continue
            h = b.column("h").to_numpy()
            cut = int(np.searchsorted(h, h[-1]))
            if held and cut == 0:
                held.append(b)
                n += b.num_rows
                continue
            if n + cut >= TOGETHER:
                held.append(b.slice(0, cut))
                yield flush()
                held.append(b.slice(cut))
                n = b.num_rows - cut
            else:
                held.append(b)
                n += b.num_rows
        if held:
            yield flush()

    return parts.repartition("h").sortWithinPartitions("h").mapInArrow(build, "doc long, id long, start int, end int")


def without_repeats(df: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of every row."""
    rows = texts(df).select("doc_id", F.coalesce("doc_id", F.lit(NO_ID)).alias("doc"), F.xxhash64("text").alias("id"), F.md5("text").alias("md5"), "text")
    anchors = saved(shared_anchors(rows), "anchors")
    parts = segments(rows.dropDuplicates(["doc", "md5"]) if _repeats(rows) else rows, anchors)
    spans = saved(repeats(parts), "repeats")
    dropped(anchors)
    firsts = rows.groupBy("md5").agg(F.min("doc").alias("first"), F.min("id").alias("first_id"))
    gathered = spans.groupBy(F.col("doc").alias("first"), F.col("id").alias("first_id")).agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("spans"))
    plan = saved(firsts.join(gathered, ["first", "first_id"], "left").select("md5", "first", "spans"), "plan")
    dropped(spans)
    released(df.sparkSession)

    def apply(batches):
        for b in sliced(batches, "text"):
            out = []
            for t, doc, first, spans_ in zip(strings(b.column("text")), b.column("doc").to_pylist(), b.column("first").to_pylist(), b.column("spans").to_pylist(), strict=True):
                raw = t.encode("utf-8", "surrogatepass")
                if doc > first:
                    cut = [(0, len(raw))] if len(raw) >= LENGTH else []
                else:
                    cut = merged([(s["start"], s["end"]) for s in spans_ or ()])
                digest, at = hashlib.sha256(), 0
                for x, y in cut:
                    digest.update(raw[at:x])
                    at = y
                digest.update(raw[at:])
                out.append((len(raw), sum(y - x for x, y in cut), len(cut), digest.hexdigest()))
            n, removed, spans_n, kept = zip(*out, strict=True)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans_n, pa.int64()), pa.array(kept, pa.string())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return rows.join(plan, "md5").select("doc_id", "doc", "text", "first", "spans").mapInArrow(apply, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def _repeats(rows: DataFrame) -> bool:
    """Whether a doc_id occurs twice."""
    return not rows.groupBy("doc").count().filter("count > 1").isEmpty()


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Sorted spans, those that touch or overlap made one."""
    out: list[tuple[int, int]] = []
    for x, y in spans:
        if out and x <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], y))
        else:
            out.append((x, y))
    return out
