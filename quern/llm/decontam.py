"""Operator 10: benchmark decontamination by seeds and local alignment.

Words are runs of letters and digits in lower case. Every run of GRAM words of a test item is a seed, common or not, for an edited
copy need hold none of an item's rare ones. Documents that hold a seed are aligned with its item around that place (Smith-Waterman:
match 2, mismatch -1, gap -1) if enough of the item's words are there, in any order, to reach the least score; the best score over
the score of a whole copy is the similarity. Edited copies with 8 in 10 words left reach about 0.7, with 7 in 10 about 0.55;
unrelated texts stay near 0.2. A copy without any GRAM words in a row left (every third one replaced) has no seed.

Items go to the workers in blocks of AT_ONCE words at most, each block with a pass of its own over the documents, so what is
broadcast is bounded whatever the benchmark's size. Null and empty texts and items match nothing; an item without an id is
searched for like the others and reported with a null item_id; an item shorter than GRAM words is its own seed; items or
documents that repeat are reported each time; an empty benchmark gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import sliced, strings, texts

WORD = re.compile(r"[^\W_]+")
GRAM = 3
SIMILARITY = 0.45
AT_ONCE = 2_000_000
MATCH, MISMATCH, GAP = 2, -1, -1
COLUMNS = "doc_id long, item_id long, score double, first_word long, last_word long"


class Items:
    """A block of items: their words as numbers, and their runs of words as keys."""

    def __init__(self, rows: list[tuple[int | None, list[str]]]):
        self.ids = [i for i, _ in rows]
        self.number = {w: k for k, w in enumerate(sorted({w for _, words in rows for w in words}))}
        self.words = [np.array([self.number[w] for w in words], np.int64) for _, words in rows]
        self.bags = [np.unique(w, return_counts=True) for w in self.words]
        self.base = len(self.number) + 1
        if self.base**GRAM >= 2**62:
            raise ValueError("too many words in a block of items")
        where = [(key, k, j) for k, w in enumerate(self.words) for j, key in enumerate(self.keys(w, min(GRAM, len(w))).tolist() if len(w) else [])]
        table = np.array(sorted(where), np.int64).reshape(-1, 3)
        self.key, self.first = np.unique(table[:, 0], return_index=True)
        self.first = np.append(self.first, len(table))
        self.item, self.at = table[:, 1], table[:, 2]
        #: Lengths of runs that occur: GRAM, and less for short items.
        self.sizes = sorted({min(GRAM, len(w)) for w in self.words if len(w)})

    def keys(self, words: np.ndarray, size: int) -> np.ndarray:
        """A number for each run of `size` words; words that no item has are -1 and make it negative."""
        n = len(words) - size + 1
        if n <= 0:
            return np.zeros(0, np.int64)
        key = words[:n] + 1
        bad = words[:n] < 0
        for k in range(1, size):
            key = key * self.base + words[k : k + n] + 1
            bad |= words[k : k + n] < 0
        return np.where(bad, -1, key)

    def document(self, text: str) -> np.ndarray:
        get = self.number.get
        return np.array([get(w, -1) for w in WORD.findall(text.lower())], np.int64)

    def hits(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The item, the place in it and the place in the document of each run of words that both hold."""
        items, ats, places = [], [], []
        for size in self.sizes:
            key = self.keys(words, size)
            near = np.flatnonzero(key >= 0)
            k = np.minimum(np.searchsorted(self.key, key[near]), len(self.key) - 1)
            same = self.key[k] == key[near]
            k, near = k[same], near[same]
            n = self.first[k + 1] - self.first[k]
            e = np.repeat(self.first[k] - np.cumsum(n) + n, n) + np.arange(n.sum())
            items.append(self.item[e])
            ats.append(self.at[e])
            places.append(np.repeat(near, n))
        return (np.concatenate(items), np.concatenate(ats), np.concatenate(places)) if items else (np.zeros(0, np.int64),) * 3

    def most(self, words: np.ndarray, item: int) -> float:
        """An upper bound of the similarity: the share of the item's words that are there, in any order."""
        own, n = self.bags[item]
        at = np.minimum(np.searchsorted(own, words), len(own) - 1)
        there = np.bincount(at[own[at] == words], minlength=len(own))
        return float(np.minimum(there, n).sum() / n.sum())


def align(words: np.ndarray, item: np.ndarray) -> tuple[int, int, int]:
    """Best local alignment: score, first and last word of the document in it."""
    n = len(words)
    drop = np.arange(n) * -GAP
    above, begun = np.zeros(n + 1, np.int64), np.arange(n + 1)
    best = (0, 0, -1)
    for w in item.tolist():
        diagonal = above[:-1] + np.where(words == w, MATCH, MISMATCH)
        up = above[1:] + GAP
        own = np.maximum(np.maximum(diagonal, up), 0)
        start = np.where(own == 0, np.arange(1, n + 1), np.where(diagonal >= up, begun[:-1], begun[1:]))
        run = np.maximum.accumulate(own + drop)  # a gap in the item: the best cell to the left, less its distance
        source = np.maximum.accumulate(np.where(own + drop == run, np.arange(n), 0))
        own, start = run - drop, start[source]
        above = np.concatenate([[0], np.maximum(own, 0)])
        begun = np.concatenate([[0], start])
        j = int(above.argmax())
        if above[j] > best[0]:
            best = (int(above[j]), int(begun[j]), j - 1)
    return best


def matches(items: Items, text: str, least: float) -> Iterator[tuple[int, float, int, int]]:
    """(number of the item, similarity, first word, last word) for each item that the text holds a copy of: its best place."""
    words = items.document(text)
    windows: dict[int, set[tuple[int, int]]] = {}
    for i, q, p in zip(*(x.tolist() for x in items.hits(words)), strict=True):
        n = len(items.words[i])
        slack = n // 2 + 5
        windows.setdefault(i, set()).add((max(0, p - q - slack), min(len(words), p - q + n + slack)))
    for i, spans in sorted(windows.items()):
        item, best, joined = items.words[i], (0.0, 0, -1), []
        for a, b in sorted(spans):
            if joined and a <= joined[-1][1]:
                joined[-1][1] = max(joined[-1][1], b)
            else:
                joined.append([a, b])
        for a, b in joined:
            if items.most(words[a:b], i) < least:
                continue
            s, first, last = align(words[a:b], item)
            if s / (MATCH * len(item)) > best[0]:
                best = (s / (MATCH * len(item)), a + first, a + last)
        if best[0] >= least:
            yield i, *best


def item_blocks(items: DataFrame, at_once: int = AT_ONCE) -> Iterator[Items]:
    """The benchmark in blocks of bounded words; one block is on the driver at a time."""
    block, held = [], 0
    rows = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text")).filter("text is not null")
    for r in rows.orderBy("item_id", "text").toLocalIterator():
        words = WORD.findall(r.text.lower())
        if words:
            block.append((r.item_id, words))
            held += len(words)
        if held >= at_once:
            yield Items(block)
            block, held = [], 0
    if block:
        yield Items(block)


def find(docs: DataFrame, items: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """doc_id, item_id, score, first_word and last_word of every document that holds a copy of an item."""
    spark = docs.sparkSession
    source = texts(docs)
    found = [_find_block(source, block, least) for block in item_blocks(items)]
    return reduce(DataFrame.unionAll, found) if found else spark.createDataFrame([], COLUMNS)


def _find_block(source: DataFrame, items: Items, least: float) -> DataFrame:
    held = source.sparkSession.sparkContext.broadcast(items)  # AT_ONCE words at most

    def search(batches):
        own = held.value
        for b in sliced(batches, "text"):
            rows = [(d, own.ids[i], s, f, z) for d, t in zip(b.column("doc_id").to_pylist(), strings(b.column("text")), strict=True) for i, s, f, z in matches(own, t, least)]
            if rows:
                kinds = (pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["doc_id", "item_id", "score", "first_word", "last_word"])

    return source.mapInArrow(search, COLUMNS)


def without(docs: DataFrame, items: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """The rows and columns of docs that hold no copy of an item. Rows with a null doc_id or text stay or go by their text too:
    the decision is made row by row, where the document is read."""
    out = docs
    for block in item_blocks(items):
        held = docs.sparkSession.sparkContext.broadcast(block)  # AT_ONCE words at most

        def run(batches, held=held):
            own = held.value
            for b in sliced(batches, "text"):
                keep = [next(matches(own, t, least), None) is None for t in strings(b.column("text"))]
                yield b.filter(pa.array(keep, pa.bool_()))

        out = out.mapInArrow(run, out.schema)
    return out
