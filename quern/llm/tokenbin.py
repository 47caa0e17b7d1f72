"""Operator 6: token ids in files of independent zstandard frames.

A shard file is a run of zstandard frames, one for each group of documents of about FRAME_BYTES, followed by a skippable
frame with a seek table:

    skippable magic 0x184D2A5E | payload size | payload
    payload: per frame (offset u64, compressed size u32, ids size u32, documents u32, xxh64 of the ids u64, first doc_id i64),
             then number of frames u32, version u32, magic 0x51554E54

all little-endian. A frame holds, decompressed, a header (doc_id i64, ids u32, 1 or 0 for a null doc_id u32) per document and
then the ids of its documents as u32. A reader takes the table from the end of the file, fetches the frames it needs and checks their sums; the rest of the
file stays unread.

Documents go to shards by ranges of doc_id, in ascending order, null ones first; rows that repeat a doc_id stand side by side, by
the hash of their texts, and may go to several shards. Null and empty texts have the end id alone. An empty table makes no file.
"""

from __future__ import annotations

import os
import struct
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import fresh_path, sliced, strings, texts

END_ID = 2
FRAME_BYTES = 1 << 20
SKIPPABLE, TABLE_MAGIC, VERSION = 0x184D2A5E, 0x51554E54, 2
ENTRY, TAIL, HEAD = struct.Struct("<QIIIQq"), struct.Struct("<III"), struct.Struct("<II")
DOCUMENT = np.dtype([("doc_id", "<i8"), ("n", "<u4"), ("known", "<u4")])
LOWEST = -(2**63)  #: stands for a null doc_id in a seek table
#: Chunks that a worker remembers, and how many new ones the library sees at once.
REMEMBERED, TOGETHER = 600_000, 512


class ByteEncoder:
    """The tokenizers library behind a memory of chunks.

    The library's pattern starts a token at every single space between two characters that are not white space. A text is
    cut there, each distinct chunk (kept without its space) is encoded once per worker, and new chunks go to the library side
    by side as one text: only the first id of a chunk begins with a space, which tells the chunks apart again. A text with a
    space beside other white space or at an end is not cut: it has a chunk that is empty or has white space at an end.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = True
        words = self.library.get_vocab()
        self.opens = np.zeros(max(words.values()) + 1, bool)
        self.opens[[i for w, i in words.items() if w.startswith("Ġ")]] = True
        self.known: dict[str, int] = {}  #: number of a chunk, or -1 for one whose text is not cut
        self.ids, self.first, self.size = np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def plain(self, docs: list[str]) -> list[np.ndarray]:
        """Ids from the library, as it is."""
        return [np.array(x.ids, np.uint32) for x in self.library.encode_batch_fast(docs, add_special_tokens=False)] if docs else []

    def learn(self, new: list[str]) -> None:
        ids, sizes, good = [], [], []
        for c in new:
            if not c or c[0].isspace() or c[-1].isspace():
                self.known[c] = -1
            else:
                good.append(c)
        groups = [good[i : i + TOGETHER] for i in range(0, len(good), TOGETHER)]
        for group, got in zip(groups, self.plain([" " + " ".join(g) for g in groups]), strict=True):
            starts = np.flatnonzero(self.opens[got])
            if len(starts) != len(group):  # not the pattern we know: one by one
                each = self.plain([" " + c for c in group])
                ids += each
                sizes.append(np.array([len(x) for x in each]))
            else:
                ids.append(got)
                sizes.append(np.diff(starts, append=len(got)))
        self.known.update(zip(good, range(len(self.size), len(self.size) + len(good)), strict=True))
        if good:
            self.renew(np.concatenate([self.ids, *ids]), np.concatenate([self.size, *sizes]))

    def renew(self, ids: np.ndarray, size: np.ndarray) -> None:
        self.ids, self.size, self.first = ids, size, np.cumsum(size) - size

    def gather(self, at: np.ndarray) -> np.ndarray:
        """Ids of the chunks of these numbers, one chunk after the other."""
        size = self.size[at]
        ends = np.cumsum(size)
        return self.ids[np.repeat(self.first[at] - ends + size, size) + np.arange(ends[-1] if len(ends) else 0)]

    def remember(self, here: list[str]) -> np.ndarray:
        """Numbers of these distinct chunks. Where memory runs out, all others are forgotten."""
        new = [c for c in here if c not in self.known]
        if len(self.known) + len(new) > REMEMBERED:
            kept = {c: k for c in here if (k := self.known.get(c, -1)) >= 0}
            new = [c for c in here if c not in kept]
            at = np.fromiter(kept.values(), np.int64, len(kept))
            self.renew(self.gather(at), self.size[at])
            self.known = dict(zip(kept, range(len(kept)), strict=True))
        if new:
            self.learn(new)
        return np.fromiter(map(self.known.__getitem__, here), np.int64, len(here))

    def encode(self, docs: list[str]) -> list[np.ndarray]:
        parts = pc.split_pattern(pa.array(docs, pa.large_string()), " ", max_splits=None)
        sizes = parts.value_lengths().to_numpy().astype(np.int64)
        begins = np.cumsum(sizes) - sizes
        flat = parts.flatten()
        later = np.ones(len(flat), bool)
        later[begins] = False  # a text's head has no space before it
        coded = flat.filter(pa.array(later)).dictionary_encode()
        at = self.remember(coded.dictionary.to_pylist())[coded.indices.to_numpy()]
        ends = np.cumsum(sizes - 1)
        heads = flat.take(pa.array(begins)).to_pylist()
        odd = np.add.reduceat(np.r_[at < 0, False], np.minimum(ends - sizes + 1, len(at))) > 0 if len(docs) else np.zeros(0, bool)
        cut = [n > 1 and not o and h != "" and not h[-1].isspace() for n, o, h in zip(sizes.tolist(), (odd & (sizes > 1)).tolist(), heads, strict=True)]
        others = self.plain([h if c else t for t, h, c in zip(docs, heads, cut, strict=True)])
        return [np.concatenate([x, self.gather(at[y - n + 1 : y])]) if c else x for x, c, y, n in zip(others, cut, ends.tolist(), sizes.tolist(), strict=True)]


@lru_cache(maxsize=2)
def byte_encoder(path: str) -> ByteEncoder:
    return ByteEncoder(path)


def frame(ids: np.ndarray, documents: list[tuple[int, int, int]]) -> tuple[bytes, int]:
    """A compressed frame and the sum of its contents."""
    plain = np.array(documents, DOCUMENT).tobytes() + ids.astype("<u4").tobytes()
    return zstandard.ZstdCompressor(level=1, write_checksum=True, write_content_size=True).compress(plain), xxhash.xxh64_intdigest(plain)


class ShardWriter:
    def __init__(self, out):
        self.out, self.at, self.table = out, 0, []
        self.ids: list[np.ndarray] = []
        self.documents: list[tuple[int, int, int]] = []
        self.held = self.total = 0

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.ids.append(ids)
        self.documents.append((LOWEST if doc_id is None else doc_id, len(ids), doc_id is not None))
        self.held += 4 * len(ids)
        self.total += len(ids)
        if self.held >= FRAME_BYTES:
            self.flush()

    def flush(self) -> None:
        if not self.documents:
            return
        ids = np.concatenate(self.ids)
        data, check = frame(ids, self.documents)
        self.table.append((self.at, len(data), 4 * len(ids), len(self.documents), check, self.documents[0][0]))
        self.out.write(data)
        self.at += len(data)
        self.ids, self.documents, self.held = [], [], 0

    def close(self) -> None:
        self.flush()
        payload = b"".join(ENTRY.pack(*x) for x in self.table) + TAIL.pack(len(self.table), VERSION, TABLE_MAGIC)
        self.out.write(HEAD.pack(SKIPPABLE, len(payload)) + payload)


def seek_table(f) -> list[tuple]:
    """The entries of a shard's frames, from the end of the file."""
    size = f.size()
    f.seek(size - TAIL.size)
    n, version, magic = TAIL.unpack(f.read(TAIL.size))
    if magic != TABLE_MAGIC or version != VERSION:
        raise ValueError("not a shard of token ids, or cut short")
    f.seek(size - TAIL.size - n * ENTRY.size)
    return list(ENTRY.iter_unpack(f.read(n * ENTRY.size)))


def read_frame(f, entry: tuple) -> tuple[list[int | None], list[np.ndarray]]:
    """doc_ids and ids of a frame's documents; a wrong sum raises."""
    at, size, ids_bytes, documents, check, _ = entry
    f.seek(at)
    plain = zstandard.ZstdDecompressor().decompress(f.read(size), max_output_size=ids_bytes + documents * DOCUMENT.itemsize)
    if xxhash.xxh64_intdigest(plain) != check:
        raise ValueError("a frame's checksum is wrong")
    head = np.frombuffer(plain, DOCUMENT, documents)
    ids = np.frombuffer(plain, "<u4", offset=documents * DOCUMENT.itemsize)
    return [d if known else None for d, known in zip(head["doc_id"].tolist(), head["known"].tolist(), strict=True)], np.split(ids, np.cumsum(head["n"])[:-1])


def opened(path: str):
    where, inside = fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")
    return where, inside


def read_documents(path: str, wanted: set[int] | None = None) -> Iterator[tuple[int | None, np.ndarray]]:
    """doc_id and ids of the shard's documents, or of the wanted ones alone: other frames are not decompressed."""
    where, inside = opened(path)
    with where.open_input_file(inside) as f:
        table = seek_table(f)
        for k, entry in enumerate(table):
            if wanted is not None:
                last = table[k + 1][5] if k + 1 < len(table) else max(wanted, default=entry[5])
                if not any(entry[5] <= d <= last for d in wanted):
                    continue
            for d, ids in zip(*read_frame(f, entry), strict=True):
                if wanted is None or d in wanted:
                    yield d, ids


def write_shards(df: DataFrame, tokenizer: str, path: str, end_id: int = END_ID, shards: int | None = None) -> DataFrame:
    """Write every row's ids below path; returns shard, file, first_doc, n_docs, n_ids, one row a shard, ascending.

    A task writes under a name of its own and then moves the file to its place, so a task that is lost or run twice leaves
    one whole file.
    """
    spark = df.sparkSession
    shards = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))

    def run(batches):
        writer = file = None
        e, first, n_docs = byte_encoder(tokenizer), 0, 0
        for b in sliced(batches, "text", 4 << 20):
            if writer is None:
                from pyspark import TaskContext

                where, base = opened(path)
                where.create_dir(base, recursive=True)
                name = f"shard-{TaskContext.get().partitionId():06d}.zst"
                draft = f"{base}/.{name}.{uuid.uuid4().hex}"
                file = where.open_output_stream(draft)
                writer, first = ShardWriter(file), b.column("doc_id")[0].as_py()
            for d, ids in zip(b.column("doc_id").to_pylist(), e.encode(strings(b.column("text"))), strict=True):
                writer.add(d, np.append(ids, np.uint32(end_id)))
                n_docs += 1
        if writer is not None:
            writer.close()
            file.close()
            where.move(draft, f"{base}/{name}")
            yield pa.RecordBatch.from_pydict({"shard": pa.array([int(name[6:12])], pa.int32()), "file": [f"{path}/{name}"], "first_doc": pa.array([first], pa.int64()), "n_docs": pa.array([n_docs], pa.int64()), "n_ids": pa.array([writer.total], pa.int64())})

    keyed = texts(df).withColumn("h", F.xxhash64("text"))  # the texts of a doc_id that very many rows have are parted, too
    placed = keyed.repartitionByRange(shards, "doc_id", "h").sortWithinPartitions("doc_id", "h")
    return placed.drop("h").mapInArrow(run, "shard int, file string, first_doc long, n_docs long, n_ids long")


def read_shards(index: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, read back from the files of an index of write_shards().

    index: file and base, the number of ids in the shards before.
    """

    def run(batches):
        for b in batches:
            for file, start in zip(b.column("file").to_pylist(), b.column("base").to_pylist(), strict=True):
                where, inside = opened(file)
                with where.open_input_file(inside) as f:
                    for entry in seek_table(f):
                        docs, ids = read_frame(f, entry)
                        sizes = np.array([len(x) for x in ids], np.int64)
                        starts = start + np.cumsum(sizes) - sizes
                        start += int(sizes.sum())
                        yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(starts), pa.array(sizes), pa.array([zlib.crc32(x.tobytes()) for x in ids], pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return index.select("file", "base").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def round_trip(df: DataFrame, tokenizer: str, path: str | None = None) -> DataFrame:
    """Write the table's ids as shards (below the shared folder, where no path is given) and read them back."""
    spark = df.sparkSession
    index = sorted(write_shards(df, tokenizer, path or fresh_path(spark, "ids")).collect())  # a row a shard
    base, rows = 0, []
    for x in index:
        rows.append((x.file, base))
        base += x.n_ids
    table = spark.createDataFrame(rows, "file string, base long")
    return read_shards(table.repartition(max(1, len(rows)), "file") if rows else table)
