"""Operator 4: near-duplicate documents by order MinHash.

Words are runs of letters and digits in lower case; a document is the sequence of its shingles of WORDS words, each labelled with
how often it occurred before. Every table of the sketch takes the MINIMA smallest labelled shingles under a hash of its own and
keeps them in text order, so that two texts agree where they share those shingles in the same order. Texts that agree in a table
are candidates; a candidate pair is a link if the banded alignment of both shingle sequences matches M of a and b shingles with
M / (a + b - M) >= SIMILARITY. Classes are the connected components of the links.

Equal texts are one text from the start. A text of fewer than WORDS words is a single shingle; texts without words are alike
only if equal. Null texts count as empty. Repeated rows and ids get a row each.

Members of a candidate group are compared without writing out their pairs: a histogram of shingles bounds the similarity from
above, so what fails it is no link. In small groups all pairs that pass are aligned. In groups over SMALL texts, each member is
first aligned with the leaders and the nearest earlier member that pass (a member without either is a leader); groups over SALTED
texts are dealt out by a salt for that, and the leaders of the parts then meet. What these links leave apart is aligned next:
members of such a group that are not joined yet meet in blocks, by lengths that a link allows, with their texts, and each pair
that passes the histogram, and then the number of shingles that both hold, is aligned unless links have joined it meanwhile. The
largest component of a group meets the other members only. So the classes do not depend on the sizes of groups.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm.common import dropped, saved, sliced, strings, texts

WORD = re.compile(r"[^\W_]+")
WORDS, SIMILARITY = 5, 0.8
TABLES, MINIMA = 8, 2
BINS, SMALL, SALTED = 64, 24, 512
#: Shingles of the members of a block that meets with its texts.
HELD = 2_000_000
#: Most words whose hashes a worker remembers.
REMEMBERED = 500_000
_ODD = np.uint64(0x9E3779B97F4A7C15)


class Hashes(dict):
    def __missing__(self, word: str) -> int:
        if len(self) > REMEMBERED:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: str, memory: Hashes, words: int = WORDS) -> np.ndarray:
    found = WORD.findall(text.lower())
    if not found:
        return np.zeros(0, np.uint64)
    h = np.array([memory[w] for w in found], np.uint64)
    n = max(1, len(h) - words + 1)
    out = np.full(n, np.uint64(min(words, len(h))))
    for k in range(min(words, len(h))):
        out = mix(out * _ODD + h[k : k + n])
    return out


def labelled(s: np.ndarray) -> np.ndarray:
    """Each shingle mixed with the number of its earlier occurrences."""
    order = np.argsort(s, kind="stable")
    run = s[order]
    start = np.flatnonzero(np.r_[True, run[1:] != run[:-1]])
    before = np.empty(len(s), np.uint64)
    before[order] = np.arange(len(s)) - np.repeat(start, np.diff(np.r_[start, len(s)]))
    return mix(s + before * _ODD)


def sketch(s: np.ndarray, tables: int = TABLES, minima: int = MINIMA) -> list[int]:
    """A key for each table: the smallest labelled shingles, in text order."""
    if not len(s):
        return []
    own = labelled(s)
    seeds = mix(np.arange(1, tables + 1, dtype=np.uint64) * _ODD)
    m = min(minima, len(own))
    out = []
    for t in range(tables):
        v = mix(own ^ seeds[t])
        at = np.sort(np.argpartition(v, m - 1)[:m]) if m < len(v) else np.arange(m)
        key = np.array([t], np.uint64)
        for x in own[at]:
            key = mix(key * _ODD + x)
        out.append(int(key.view(np.int64)[0]))
    return out


def histogram(s: np.ndarray) -> bytes:
    return np.minimum(np.bincount((s >> np.uint64(58)).astype(np.int64), minlength=BINS), 65535).astype("<u2").tobytes()


def matched(a: np.ndarray, b: np.ndarray, slack: int) -> int:
    """Length of the longest common subsequence whose matches stay within `slack` of the diagonal: one step of big-integer
    arithmetic for each shingle of a."""
    n = min(len(a), len(b))
    same = a[:n] == b[:n]
    head = n if same.all() else int(same.argmin())
    a, b = a[head:], b[head:]
    n = min(len(a), len(b))
    same = a[len(a) - n :] == b[len(b) - n :] if n else np.zeros(0, bool)
    tail = n if same.all() else n - 1 - int(np.flatnonzero(~same)[-1])
    a, b = a[: len(a) - tail].tolist(), b[: len(b) - tail].tolist()
    if not a or not b:
        return head + tail
    places: dict[int, int] = {}
    for j, x in enumerate(b):
        places[x] = places.get(x, 0) | (1 << j)
    full = (1 << len(b)) - 1
    band = (1 << (2 * slack + 1)) - 1
    v = full
    for i, x in enumerate(a):
        m = places.get(x, 0)
        if m:
            m &= band << (i - slack) if i >= slack else band >> (slack - i)
            u = v & m
            v = ((v + u) | (v - u)) & full
    return head + tail + len(b) - v.bit_count()


def similarity(a: np.ndarray, b: np.ndarray, least: float = SIMILARITY) -> float:
    """M / (a + b - M) by banded alignment; exact wherever it reaches `least`."""
    total = len(a) + len(b)
    if not total:
        return 1.0
    apart = int(total * (1 - least) / (1 + least)) + 1  # a link leaves no more than that unmatched
    m = matched(a, b, apart) if abs(len(a) - len(b)) <= apart else 0
    return m / (total - m)


PAIRS = "a binary, b binary, key long, n int, hist binary"
_PAIRS = pa.schema([("a", pa.binary()), ("b", pa.binary()), ("key", pa.int64()), ("n", pa.int32()), ("hist", pa.binary())])


def compare(ids: list[bytes], n: np.ndarray, hist: np.ndarray, least: float) -> tuple[list[tuple[int, int]], list[int]]:
    """Pairs of a group to align, and its leaders."""
    limit = (1 - least) / (1 + least)
    pairs, leaders, led = [], [], np.zeros(len(ids), bool)
    for i in range(len(ids)):
        apart = np.abs(hist[:i] - hist[i]).sum(1) if i else np.zeros(0, np.int64)
        near = np.flatnonzero(apart <= limit * (n[:i] + n[i]) + 1e-9)
        if len(ids) <= SMALL:
            pairs += [(int(j), i) for j in near]
        elif len(near):
            pairs += [(j, i) for j in {int(near[apart[near].argmin()]), *near[led[near]].tolist()}]
        if not len(near):
            leaders.append(i)
            led[i] = True
    return pairs, leaders


def groups(batches: Iterator[pa.RecordBatch], columns: tuple[str, ...]) -> Iterator[tuple[tuple, list[pa.RecordBatch]]]:
    """Runs of equal keys of a sorted stream."""
    held, last = [], None
    for b in batches:
        if not b.num_rows:
            continue
        keys = np.stack([b.column(c).to_numpy(zero_copy_only=False) for c in columns])
        cuts = [0, *(np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(0)) + 1).tolist(), b.num_rows]
        for x, y in zip(cuts, cuts[1:]):  # noqa: B905
            key = tuple(keys[:, x].tolist())
            if key != last and held:
                yield last, held
                held = []
            last = key
            held.append(b.slice(x, y - x))
    if held:
        yield last, held


def candidates(members: DataFrame, least: float, again: bool) -> DataFrame:
    """Pairs to align of members (key, salt, id, n, hist) dealt out by key and salt; `again`: leaders are handed on too."""

    def run(batches):
        a, b, keys, ns, hists = [], [], [], [], []
        for (key, _), held in groups(batches, ("key", "salt")):
            if sum(x.num_rows for x in held) > 1 or again:
                ids = [i for x in held for i in x.column("id").to_pylist()]
                n = np.concatenate([x.column("n").to_numpy() for x in held]).astype(np.int64)
                raw = [h for x in held for h in x.column("hist").to_pylist()]
                hist = np.frombuffer(b"".join(raw), "<u2").reshape(-1, BINS).astype(np.int32)
                salted = again and held[0].column("parts")[0].as_py() > 1
                pairs, leaders = compare(ids, n, hist, least)
                for i, j in pairs:
                    x, y = sorted((ids[i], ids[j]))
                    a.append(x), b.append(y), keys.append(None), ns.append(None), hists.append(None)
                for i in leaders if salted else ():
                    a.append(ids[i]), b.append(None), keys.append(key), ns.append(int(n[i])), hists.append(raw[i])
            if len(a) > 5000:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip((a, b, keys, ns, hists), _PAIRS, strict=True)], schema=_PAIRS)
                a, b, keys, ns, hists = [], [], [], [], []
        if a:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip((a, b, keys, ns, hists), _PAIRS, strict=True)], schema=_PAIRS)

    dealt = members.repartition("key", "salt").sortWithinPartitions("key", "salt", "id")
    return dealt.mapInArrow(run, PAIRS)


def in_blocks(members: DataFrame, least: float) -> DataFrame:
    """The members dealt out by salt: those of a key with SALTED or fewer meet at once. The others go by levels of length, of
    which a link joins the same or neighbouring ones (the shorter text has at least `least` of the longer's shingles), and by
    blocks of a level; each two blocks that a link can join share a salt. Every such pair of members meets somewhere, but for
    two that are both `joined` (if there is that column)."""
    columns = members.columns
    level = F.floor(F.log(F.greatest(F.col("n"), F.lit(1)).cast("double")) / (math.log(1 / least) * (1 + 1e-9))).cast("int")
    many = members.groupBy("key").agg(F.count("*").alias("count"), F.sum("n").alias("held")).filter((F.col("count") > SALTED) | (F.col("held") > HELD)).select("key")
    few = members.join(many, "key", "left_anti").select(columns)
    rest = members.join(many, "key", "left_semi").withColumn("level", level)
    rest = rest.withColumn("kind", F.col("joined").cast("int") if "joined" in columns else F.lit(0))
    # aggregated before the shuffle: a row for each level of a key, some tens at most
    size = F.greatest(F.ceil(F.count("*") / SALTED), F.ceil(F.sum("n") / HELD)).cast("int")
    blocks = rest.groupBy("key", "level", "kind").agg(size.alias("blocks"))
    rest = rest.join(blocks.groupBy("key").agg(F.collect_list(F.struct("level", "kind", "blocks")).alias("all")), "key")
    mine = F.filter("all", lambda x: (x["level"] == F.col("level")) & (x["kind"] == F.col("kind")))[0]["blocks"]
    place = F.struct(F.col("level").alias("level"), F.col("kind").alias("kind"), F.pmod(F.xxhash64("id"), mine).cast("int").alias("own"))
    rest = rest.withColumn("place", place)

    def cells(x: Column) -> Column:
        def cell(j: Column) -> Column:
            there = F.struct(x["level"].alias("level"), x["kind"].alias("kind"), j.alias("own"))
            return F.xxhash64(F.least(F.col("place"), there), F.greatest(F.col("place"), there))

        return F.transform(F.sequence(F.lit(0), x["blocks"] - 1), cell)

    near = F.filter("all", lambda x: (F.abs(x["level"] - F.col("level")) <= 1) & (x["kind"] + F.col("kind") < 2))
    every = F.flatten(F.transform(near, cells))
    dealt = rest.withColumn("salt", F.explode(every)).select(columns)
    return few.withColumn("salt", F.col("salt").cast("long")).unionByName(dealt)


def joining(rows: list[tuple[bytes, bytes, np.ndarray]], least: float) -> Iterator[tuple[bytes, bytes, float]]:
    """Links between texts (id, root, shingles) that have different roots: every pair that can be a link is aligned unless links,
    earlier ones or these, have joined it."""
    n = np.array([len(s) for _, _, s in rows])
    hist = np.stack([np.frombuffer(histogram(s), "<u2").astype(np.int32) for _, _, s in rows])
    number: dict[bytes, int] = {}
    root = np.array([number.setdefault(r, len(number)) for _, r, _ in rows])
    if len(number) < 2:
        return
    flat = np.concatenate([labelled(s) for _, _, s in rows])
    _, flat = np.unique(flat, return_inverse=True)
    holder = np.repeat(np.arange(len(rows)), n)
    start = np.r_[0, np.cumsum(n)]
    order = np.argsort(flat, kind="stable")
    holders = holder[order]  # of each shingle, in turn
    first = np.r_[0, np.cumsum(np.bincount(flat))]
    limit = (1 - least) / (1 + least)
    for i in range(1, len(rows)):
        apart = np.flatnonzero(root[:i] != root[i])
        near = apart[np.abs(hist[apart] - hist[i]).sum(1) <= limit * (n[apart] + n[i]) + 1e-9]
        if not len(near):
            continue
        own = flat[start[i] : start[i + 1]]
        shared = np.zeros(len(rows), np.int64)
        for at in range(0, len(own), 512):
            part = own[at : at + 512]
            c = first[part + 1] - first[part]
            shared += np.bincount(holders[np.repeat(first[part] - np.cumsum(c) + c, c) + np.arange(c.sum())], minlength=len(rows))
        total = n[near] + n[i]
        near = near[shared[near] * (1 + least) >= least * total - 1e-9]
        for j in near[np.argsort(-shared[near], kind="stable")].tolist():
            if root[i] != root[j] and (s := similarity(rows[i][2], rows[j][2], least)) >= least:
                root[root == root[j]] = root[i]
                a, b = sorted((rows[i][0], rows[j][0]))
                yield a, b, s


LINKS = "a binary, b binary, similarity double"


def remaining(members: DataFrame, found: DataFrame, docs: DataFrame, least: float) -> DataFrame:
    """Links between members (key, id, n) of large groups that those found so far do not join; found: node and root."""
    rooted = members.join(found.withColumnRenamed("node", "id"), "id", "left").withColumn("root", F.coalesce("root", "id"))
    parts = rooted.groupBy("key", "root").count()
    main = parts.groupBy("key").agg(F.count("*").alias("roots"), F.max(F.struct("count", "root"))["root"].alias("main")).filter("roots > 1")
    # main is not null, so a plain comparison
    open_ = saved(rooted.join(main, "key").withColumn("joined", F.col("root") == F.col("main")).withColumn("salt", F.lit(0)).select("key", "salt", "id", "n", "root", "joined"), "open")
    asked = saved(open_.select("id").distinct(), "asked")
    held = saved(maybe_among(identified(docs).select("id", "text"), asked).join(asked, "id").groupBy("id").agg(F.first("text").alias("text")), "texts")

    def run(batches):
        memory = Hashes()
        for _, group in groups(batches, ("key", "salt")):
            rows = [(i, r, shingles(t, memory)) for x in group for i, r, t in zip(x.column("id").to_pylist(), x.column("root").to_pylist(), strings(x.column("text")), strict=True)]
            if got := list(joining(rows, least)):
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*got, strict=True), (pa.binary(), pa.binary(), pa.float64()), strict=True)], names=["a", "b", "similarity"])

    dealt = in_blocks(open_, least).join(held, "id").select("key", "salt", "id", "root", "text")
    out = saved(dealt.repartition("key", "salt").sortWithinPartitions("key", "salt", "id").mapInArrow(run, LINKS), "more")
    dropped(open_, asked, held)
    return out


def sketches(df: DataFrame) -> DataFrame:
    """doc_id, id (MD5 of the text), n, hist and keys of every row."""

    def run(batches):
        memory = Hashes()
        for b in sliced(batches, "text"):
            n, hist, keys = [], [], []
            for t in strings(b.column("text")):
                s = shingles(t, memory)
                n.append(len(s))
                hist.append(histogram(s))
                keys.append(sketch(s))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("id"), pa.array(n, pa.int32()), pa.array(hist, pa.binary()), pa.array(keys, pa.list_(pa.int64()))], names=["doc_id", "id", "n", "hist", "keys"])

    return identified(df).mapInArrow(run, "doc_id long, id binary, n int, hist binary, keys array<long>")


def identified(df: DataFrame) -> DataFrame:
    return texts(df).withColumn("id", F.unhex(F.md5("text")))


def links(df: DataFrame, own: DataFrame, least: float = SIMILARITY) -> tuple[DataFrame, DataFrame]:
    """a < b and similarity of the links between different texts, and the members (key, id, n) of groups over SMALL texts, of
    which not all pairs were compared; own: the sketches of df."""
    distinct = own.groupBy("id").agg(F.first("n").alias("n"), F.first("hist").alias("hist"), F.first("keys").alias("keys"))
    bands = saved(distinct.select("id", F.explode("keys").alias("key")), "bands")
    shared = bands.groupBy("key").count().filter("count > 1").select("key", F.ceil(F.col("count") / SALTED).cast("int").alias("parts"))
    large = bands.groupBy("key").count().filter(F.col("count") > SMALL).select("key")
    large = saved(bands.join(large, "key", "left_semi").join(own.groupBy("id").agg(F.first("n").alias("n")), "id").select("key", "id", "n"), "large")
    met = bands.join(shared, "key")  # few rows are left, and only they take their histograms along
    salted = met.join(own.groupBy("id").agg(F.first("n").alias("n"), F.first("hist").alias("hist")), "id")
    salted = salted.withColumn("salt", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
    first = saved(candidates(salted, least, True), "candidates")
    leaders = first.filter("b is null").select("key", F.lit(0).alias("salt"), F.lit(1).alias("parts"), F.col("a").alias("id"), "n", "hist")
    pairs = first.filter("b is not null").select("a", "b")
    if not leaders.isEmpty():
        pairs = pairs.union(candidates(in_blocks(leaders, least), least, False).select("a", "b"))
    pairs = saved(pairs.distinct(), "pairs")
    dropped(bands, first)
    asked = saved(pairs.select(F.col("a").alias("id")).union(pairs.select(F.col("b").alias("id"))).distinct(), "asked")
    likely = maybe_among(identified(df).select("id", "text"), asked)
    # an inner join (asked is distinct): a semi join would be moved below the filter of likely ids, and all texts dealt out
    held = saved(likely.join(asked, "id").groupBy("id").agg(F.first("text").alias("text")), "texts")
    both = pairs.join(held.select(F.col("id").alias("a"), F.col("text").alias("text_a")), "a").join(held.select(F.col("id").alias("b"), F.col("text").alias("text_b")), "b")

    def run(batches):
        memory = Hashes()
        for b in sliced(batches, "text_a", 4 << 20):
            s = [similarity(shingles(x, memory), shingles(y, memory), least) for x, y in zip(strings(b.column("text_a")), strings(b.column("text_b")), strict=True)]
            keep = pa.array([x >= least for x in s])
            yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b"), pa.array(s, pa.float64())], names=["a", "b", "similarity"]).filter(keep)

    out = saved(both.select("a", "b", "text_a", "text_b").mapInArrow(run, LINKS), "links")
    dropped(pairs, asked, held)
    return out, large


def maybe_among(rows: DataFrame, asked: DataFrame) -> DataFrame:
    """The rows whose id may be among those asked for: a bit for each of 2^23 hashes of an id, in pieces that are 1 MB together,
    spares the others the way to a join."""
    place = F.pmod(F.xxhash64("id"), F.lit(1 << 23))
    bits = asked.select(place.alias("p")).selectExpr("bitmap_bucket_number(p) as piece", "bitmap_bit_position(p) as bit")
    pieces = bits.groupBy("piece").agg(F.expr("bitmap_construct_agg(bit)").alias("bits"))
    own = rows.withColumn("p", place).withColumn("piece", F.expr("bitmap_bucket_number(p)")).withColumn("bit", F.expr("bitmap_bit_position(p)"))
    own = own.join(F.broadcast(pieces), "piece")  # 256 pieces of 4 KB
    byte = F.conv(F.hex(F.substring("bits", F.expr("cast(bit div 8 as int)") + 1, F.lit(1))), 16, 10).cast("long")
    return own.filter(F.getbit(byte, (F.col("bit") % 8).cast("int")) == 1).select(rows.columns)


def components(edges: DataFrame) -> DataFrame:
    """node and root (the smallest node of its component) of every node of the edges a < b.

    Large star and small star in turn until nothing changes; each round is a table in the shared folder. Minima are
    aggregated before the shuffle and joined back, so a node with very many neighbours is no task's burden.
    """
    now = saved(edges.select(F.col("b").alias("u"), F.col("a").alias("v")).distinct(), "stars")
    seen = None
    while True:
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").union(low.select("u", F.col("m").alias("v"))).distinct()
        before, now = now, saved(small, "stars")
        dropped(before)
        sign = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        if sign == seen:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        seen = sign


def classes(df: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """doc_id, text id, root (a text id) of the class, class_id (smallest doc_id of the class) and class_size of every row."""
    own = saved(sketches(df), "sketches")
    edges, large = links(df, own, least)
    found = components(edges)
    if not large.isEmpty():
        more = remaining(large, found, df, least)
        if not more.isEmpty():
            found = components(found.select(F.col("root").alias("a"), F.col("node").alias("b")).union(more.select("a", "b")))
    dropped(large)
    rooted = own.select("doc_id", "id").join(found, own["id"] == found["node"], "left").select("doc_id", "id", F.coalesce("root", "id").alias("root"))
    size = rooted.groupBy("root").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("class_size"))
    return rooted.join(size, "root").select("doc_id", "id", "root", "class_id", "class_size")


def one_of_each(df: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """The rows and columns of df, of each class only the row with the smallest doc_id (of rows equal in it, one)."""
    kept = classes(df, least).filter(F.col("doc_id").eqNullSafe(F.col("class_id")))
    # of several texts of a class with that id, and of repeated rows, one stays; other classes may have the same id, or none
    kept = saved(kept.groupBy("root").agg(F.min("class_id").alias("_kept_id"), F.min("id").alias("_kept_text"), F.count("*").alias("_kept_rows")).drop("root"), "kept")
    same = F.col("doc_id").cast("long").eqNullSafe(F.col("_kept_id")) & (F.unhex(F.md5(F.coalesce("text", F.lit("")))) == F.col("_kept_text"))
    out = df.join(kept, same)
    if not kept.filter("_kept_rows > 1").isEmpty():
        out = out.filter("_kept_rows = 1").unionByName(out.filter("_kept_rows > 1").dropDuplicates(["_kept_id", "_kept_text"]))
    return out.select([F.col(f"`{c}`") for c in df.columns])
