"""Operator 7: encoding and decoding with a merge-type SentencePiece model.

The encoder is our own: a score-ordered agenda of adjacent symbol pairs. A text is cut where no piece of the vocabulary
can reach across (before a run of spaces that follows another character), and each distinct chunk goes through the agenda
once per worker; the library encodes the new chunks of every Arrow batch too and a difference ends the job. Decoding is the
library's.

Null and empty texts encode to the end id alone and decode to the empty text. Repeated rows give repeated rows.
"""

from __future__ import annotations

import hashlib
import heapq
import re
import struct
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

from quern.llm.common import sliced, strings, texts

NORMAL, UNKNOWN, BYTE = 1, 2, 6
SPACE = "▁"
#: Chunks that a worker remembers; beyond that it forgets those that the current batch lacks, which costs time only.
REMEMBERED = 200_000
#: Bytes of text that are cut, encoded and decoded together.
SLICE = 1 << 20
#: Lengths up to which chunks share a matrix of agendas.
WIDTHS = (6, 10, 14, 20, 32)
NONE = np.iinfo(np.int32).max


def proto_fields(data: bytes) -> Iterator[tuple[int, object]]:
    """(field number, value) of a protocol-buffer message."""
    at, end = 0, len(data)

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < end:
        key = varint()
        kind = key & 7
        if kind == 0:
            value: object = varint()
        elif kind == 2:
            size = varint()
            value, at = data[at : at + size], at + size
        elif kind == 5:
            value, at = struct.unpack("<f", data[at : at + 4])[0], at + 4
        else:
            value, at = data[at : at + 8], at + 8
        yield key >> 3, value


class MergeModel:
    """Vocabulary and agenda of a merge-type model file."""

    def __init__(self, path: str):
        self.score: dict[str, float] = {}
        self.id: dict[str, int] = {}
        self.byte_ids: dict[int, int] = {}
        self.unk, self.end, n = 0, 2, 0
        trainer: dict = {}
        normalizer: dict = {}
        with open(path, "rb") as f:
            data = f.read()
        for field, value in proto_fields(data):
            if field == 1:
                piece = dict(proto_fields(value))
                text, kind = piece[1].decode(), piece.get(3, NORMAL)
                if kind == NORMAL:
                    self.id[text], self.score[text] = n, piece.get(2, 0.0)
                elif kind == BYTE:
                    self.byte_ids[int(text[1:-1], 16)] = n
                elif kind == UNKNOWN:
                    self.unk = n
                n += 1
            elif field == 2:
                trainer = dict(proto_fields(value))
            elif field == 3:
                normalizer = dict(proto_fields(value))
        self.end = trainer.get(42, 2)
        if trainer.get(3) != 2 or normalizer.get(1) != b"identity" or normalizer.get(4, 1) or not normalizer.get(3, 1):
            raise ValueError("only merge-type models with identity normalisation and a leading space are supported")
        if any(SPACE in p.lstrip(SPACE) for p in self.id):
            raise ValueError("a piece holds a space after another character: texts can't be cut at spaces")

    def agenda(self, text: str) -> list[int]:
        """Ids of one chunk: the pair of adjacent symbols with the best score merges first, ties to the left."""
        score = self.score
        symbol: list[str] = list(text)
        n = len(symbol)
        left, right = list(range(-1, n - 1)), [*range(1, n), -1]
        heap = [(-score[p], i, p) for i in range(n - 1) if (p := symbol[i] + symbol[i + 1]) in score]
        heapq.heapify(heap)
        while heap:
            _, i, piece = heapq.heappop(heap)
            j = right[i]
            if j < 0 or not symbol[i] or symbol[i] + symbol[j] != piece:
                continue  # one of the two has merged with another meanwhile
            symbol[i], symbol[j] = piece, ""
            right[i] = k = right[j]
            if k >= 0:
                left[k] = i
                if (p := piece + symbol[k]) in score:
                    heapq.heappush(heap, (-score[p], i, p))
            if (h := left[i]) >= 0 and (p := symbol[h] + piece) in score:
                heapq.heappush(heap, (-score[p], h, p))
        ids = []
        for s in symbol:
            if s:
                if (found := self.id.get(s)) is not None:
                    ids.append(found)
                elif self.byte_ids:
                    ids += [self.byte_ids[b] for b in s.encode()]
                else:
                    ids.append(self.unk)
        return ids

    def tables(self) -> None:
        """Pairs of symbols that merge, for agendas(): a symbol is a piece's id, or a number of its own for another character."""
        self.size = max(self.id.values()) + 1
        chars = sorted({c for p in self.id for c in p})
        number = dict(self.id)
        for c in chars:
            number.setdefault(c, self.size + len(number))
        self.stranger = max(number.values()) + 1
        self.symbol_of = np.full(0x110000, self.stranger, np.int32)
        for c in chars:
            self.symbol_of[ord(c)] = number[c]
        for c, i in self.byte_ids.items():
            if c < 128 and chr(c) not in number:
                self.symbol_of[c] = i  # it merges with nothing and ends as its byte
        better = {s: k for k, s in enumerate(sorted(set(self.score.values()), reverse=True))}
        pairs = [(number[p[:i]] * (self.stranger + 1) + number[p[i:]], better[self.score[p]], self.id[p]) for p in self.id for i in range(1, len(p)) if p[:i] in number and p[i:] in number]
        found = np.array(sorted(pairs), np.int64).reshape(-1, 3)
        self.pair_key, self.pair_rank, self.pair_id = found[:, 0].copy(), found[:, 1].astype(np.int32), found[:, 2].astype(np.int32)

    def look_up(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Index of each pair of symbols among those that merge, or -1."""
        key = a.astype(np.int64) * (self.stranger + 1) + b
        at = np.minimum(np.searchsorted(self.pair_key, key), len(self.pair_key) - 1)
        return np.where(self.pair_key[at] == key, at, -1)

    def agendas(self, parts: list[str]) -> list[list[int]]:
        """agenda() of many chunks at once: each row of a matrix is one chunk's agenda, the best pair of every row merges per
        round. Chunks longer than WIDE, or left with characters outside the vocabulary, go through agenda()."""
        if not hasattr(self, "pair_key"):
            self.tables()
        out: list[list[int] | None] = [None] * len(parts)
        lengths = np.fromiter(map(len, parts), np.int64, len(parts))
        for low, high in zip((0, *WIDTHS), WIDTHS):  # noqa: B905
            rows = np.flatnonzero((lengths > low) & (lengths <= high))
            if not len(rows):
                continue
            n = lengths[rows]
            symbols = np.full((len(rows), high), self.stranger, np.int32)
            codes = np.frombuffer("".join([parts[i] for i in rows]).encode("utf-32-le", "surrogatepass"), np.uint32)
            symbols[np.arange(high) < n[:, None]] = self.symbol_of[codes]
            n = n.copy()
            rank = np.full((len(rows), high), NONE, np.int32)
            at = self.look_up(symbols[:, :-1], symbols[:, 1:])
            rank[:, :-1] = np.where(at >= 0, self.pair_rank[at], NONE)
            live, column = np.arange(len(rows)), np.arange(high)
            s, r = symbols, rank
            while len(live):
                j = r.argmin(1)
                go = r[np.arange(len(live)), j] < NONE
                if not go.all():
                    symbols[live[~go]] = s[~go]
                    live, s, r, j = live[go], s[go], r[go], j[go]
                    if not len(live):
                        break
                k = np.arange(len(live))
                merged = self.pair_id[self.look_up(s[k, j], s[k, j + 1])]
                later = column[:-1] > j[:, None]
                s[:, :-1] = np.where(later, s[:, 1:], s[:, :-1])
                r[:, :-1] = np.where(later, r[:, 1:], r[:, :-1])
                s[:, -1], r[:, -1] = self.stranger, NONE
                s[k, j] = merged
                n[live] -= 1
                for here in (j, j - 1):
                    inside = (here >= 0) & (here < high - 1)
                    k2, h = k[inside], here[inside]
                    at = self.look_up(s[k2, h], s[k2, h + 1])
                    r[k2, h] = np.where(at >= 0, self.pair_rank[at], NONE)
            odd = ((symbols >= self.size) & (column < n[:, None])).any(1)
            for i, ids, m, o in zip(rows.tolist(), symbols.tolist(), n.tolist(), odd.tolist(), strict=True):
                out[i] = self.agenda(parts[i]) if o else ids[:m]
        return [self.agenda(p) if o is None else o for p, o in zip(parts, out, strict=True)]


def chunks(text: str) -> list[str]:
    """The normalised text, cut before each run of spaces that follows another character; spaces are kept as such."""
    if not text:
        return []
    spaced = " " + text.replace(SPACE, " ")
    if "  " in spaced:
        return re.findall(" +[^ ]*", spaced)
    return [" " + w for w in spaced[1:].split(" ")]


class Encoder:
    """Agenda and library side by side, with a memory of chunks."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = MergeModel(path)
        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        #: Ids of each chunk as four bytes each: a list and its numbers would take several times as much.
        self.known: dict[str, bytes] = {}
        self.end = array("i", [self.model.end]).tobytes()
        self.said = [str(i) for i in range(self.library.get_piece_size())]

    def learn(self, new: list[str]) -> None:
        theirs = self.library.encode([c[1:] or " " for c in new], num_threads=1)
        ours = self.model.agendas([c.replace(" ", SPACE) for c in new])
        for chunk, ids, check in zip(new, ours, theirs, strict=True):
            if ids != check and chunk != " ":
                raise AssertionError(f"agenda and library differ on {chunk!r}: {ids} and {check}")
            self.known[chunk] = array("i", ids).tobytes()

    def cut(self, docs: list[str]) -> list[list[str]]:
        cuts = [chunks(t) for t in docs]
        here = set().union(*cuts)
        new = here.difference(self.known)
        if len(self.known) + len(new) > REMEMBERED:
            self.known = {c: self.known[c] for c in here.difference(new)}
        if new:
            self.learn(list(new))
        return cuts

    def ids(self, cut: list[str]) -> np.ndarray:
        known = self.known
        return np.frombuffer(b"".join([*[known[c] for c in cut], self.end]), np.int32)

    def encode(self, docs: list[str]) -> list[list[int]]:
        return [self.ids(one).tolist() for one in self.cut(docs)]

    def digests(self, docs: list[str], keep: list[np.ndarray] | None = None) -> tuple[list[int], list[str], list[str]]:
        """Number of ids, SHA-256 of the ids and of the decoded text of each document; the ids themselves go to `keep`."""
        said = self.said
        n, a, b = [], [], []
        for one in self.cut(docs):
            own = self.ids(one)
            ids = own.tolist()
            n.append(len(ids))
            if keep is not None:
                keep.append(own)
            a.append(hashlib.sha256(" ".join([said[i] for i in ids]).encode()).hexdigest())
            b.append(hashlib.sha256(self.library.decode(ids).encode()).hexdigest())
        return n, a, b


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def encode(df: DataFrame, model: str) -> DataFrame:
    """doc_id and ids (array of int, the end id last) of every row."""

    def run(batches):
        e = encoder(model)
        for b in sliced(batches, "text", SLICE):
            ids = pa.array(e.encode(strings(b.column("text"))), pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), ids], names=["doc_id", "ids"])

    return texts(df).mapInArrow(run, "doc_id long, ids array<int>")


def decode(df: DataFrame, model: str) -> DataFrame:
    """doc_id and text of every row of encode(); null ids decode to the empty text."""

    def run(batches):
        library = encoder(model).library
        for b in batches:
            out = [library.decode(x) if x else "" for x in b.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(out, pa.string())], names=["doc_id", "text"])

    return df.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def round_trip(df: DataFrame, model: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: each text encoded and decoded in one pass over its Arrow batches."""

    def run(batches):
        e = encoder(model)
        for b in sliced(batches, "text", SLICE):
            n, a, c = e.digests(strings(b.column("text")))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(c, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return texts(df).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def encoded(df: DataFrame, model: str) -> DataFrame:
    """doc_id, ids, n_tokens, ids_sha256 and decoded_sha256 of every row, and `document`: a struct of all columns of df but the
    text, in which no name can clash with ours."""
    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns if c != "text"]).alias("document"), F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    schema = StructType([StructField("doc_id", LongType()), StructField("ids", ArrayType(IntegerType())), StructField("n_tokens", LongType()), StructField("ids_sha256", StringType()), StructField("decoded_sha256", StringType()), rows.schema["document"]])

    def run(batches):
        e = encoder(model)
        for b in sliced(batches, "text", SLICE):
            found: list[np.ndarray] = []
            n, a, c = e.digests(strings(b.column("text")), found)
            ids = pa.array(found, pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), ids, pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(c, pa.string()), b.column("document")], names=schema.names)

    return rows.mapInArrow(run, schema)
