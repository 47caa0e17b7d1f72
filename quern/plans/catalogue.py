"""Queries over the driver's tables, each beside SQL that computes the same rows.

embeddings are the windows of tracks (five a track, label the genre); documents stand for files to ingest, labels for their
metadata; events, part, orders and lineitem are measurements. Searches take every row whose id is divisible by 100.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.functions import vectors as V
from quern.operators import exact, graph
from quern.operators.tables import WINDOWS, best_of, last_of, numbered, quantiles, queries_of, required, running, segments, table, upserted
from quern.sources import store

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
K, M, SEED = 10, 8, graph.SEED

SEG = "seg AS (SELECT vec_id AS row_id, vec_id // 5 AS track_id, (vec_id % 5)::int AS win, label AS genre, embedding::DOUBLE[] AS v FROM embeddings)"
SIMS = SEG + """, sims AS (SELECT q.row_id AS query_row, q.track_id AS query_track, q.genre AS query_genre, c.row_id, c.track_id, c.genre,
 round(list_dot_product(q.v, c.v), 9) AS sim FROM seg q, seg c WHERE q.row_id % 100 = 0)"""
#: Best window of every other track, then the k best tracks.
TRACKS = SIMS + """, best AS (SELECT *, row_number() OVER (PARTITION BY query_row, track_id ORDER BY sim DESC, row_id) AS w FROM sims WHERE track_id <> query_track),
 hits AS (SELECT query_row, query_track, query_genre, track_id, row_id, genre, sim, row_number() OVER (PARTITION BY query_row ORDER BY sim DESC, row_id) AS rank FROM best WHERE w = 1),
 top AS (SELECT * FROM hits WHERE rank <= 10)"""


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


def hits(spark, d, rule="max", exclude="track", k=K, **more):
    segs = segments(spark, d)
    return exact.topk(queries_of(segs), segs, k, rule, exclude, **more)


# ---- exact search


@query(f"WITH {TRACKS} SELECT query_row, rank::int AS rank, track_id, row_id, sim AS score FROM top")
def track_topk(spark, d):
    return hits(spark, d).select("query_row", "rank", "track_id", "row_id", "score")


def _rows_sql(where: str) -> str:
    return f"WITH {SIMS}, r AS (SELECT *, row_number() OVER (PARTITION BY query_row ORDER BY sim DESC, row_id) AS rank FROM sims WHERE {where}) SELECT query_row, rank::int AS rank, row_id, sim AS score FROM r WHERE rank <= 10"


@query(_rows_sql("row_id <> query_row"))
def segment_topk_self_excl(spark, d):
    return hits(spark, d, "row", "self").select("query_row", "rank", "row_id", "score")


@query(_rows_sql("track_id <> query_track"))
def segment_topk_sibling_excl(spark, d):
    return hits(spark, d, "row", "track").select("query_row", "rank", "row_id", "score")


def _pool_sql(value: str, tie: str = "track_id") -> str:
    return f"""WITH {SIMS}, n AS (SELECT *, row_number() OVER (PARTITION BY query_row, track_id ORDER BY sim DESC, row_id) AS w FROM sims WHERE track_id <> query_track),
 p AS (SELECT query_row, track_id, {value} AS score, max(sim) AS best FROM n GROUP BY 1, 2),
 r AS (SELECT *, row_number() OVER (PARTITION BY query_row ORDER BY score DESC, {tie}) AS rank FROM p) SELECT query_row, rank::int AS rank, track_id, score FROM r WHERE rank <= 10"""


@query(_pool_sql("max(sim)"))
def pool_max(spark, d):
    found = hits(spark, d, "max", k=K)
    return found.select("query_row", "rank", "track_id", "score")


@query(_pool_sql("round(sum(sim) / count(*), 9)"))
def pool_mean(spark, d):
    return hits(spark, d, "mean").select("query_row", "rank", "track_id", "score")


@query(_pool_sql("round(avg(sim) FILTER (w <= 3), 9)"))
def pool_topk3(spark, d):
    return hits(spark, d, "topk").select("query_row", "rank", "track_id", "score")


@query(_pool_sql("(count(*) FILTER (sim >= 0.2))::double", "greatest(best, 0) DESC, track_id"))
def pool_count(spark, d):
    return hits(spark, d, "count", threshold=0.2).select("query_row", "rank", "track_id", "score")


@query(
    f"""WITH {TRACKS} SELECT t.query_row, t.rank::int AS rank, t.track_id, round(t.sim, 4) AS score, 'Untitled ' || t.track_id AS title, coalesce(nullif(CASE WHEN t.track_id % 7 = 0 THEN '' ELSE 'Artist ' || (t.track_id % 13) END, ''), 'Unknown artist') AS artist,
 (t.row_id % 5)::int AS offset_s, '0:0' || (t.row_id % 5) || ' - 0:' || (t.row_id % 5 + 10) AS passage FROM top t"""
)
def result_cards(spark, d):
    """Hits joined to the catalog: display defaults, offset and passage of the best window."""
    tracks = segments(spark, d).select("track_id").distinct()
    artist = F.when(F.col("track_id") % 7 == 0, F.lit("")).otherwise(F.concat(F.lit("Artist "), (F.col("track_id") % 13).cast("string")))
    tracks = tracks.select("track_id", F.concat(F.lit("Untitled "), F.col("track_id").cast("string")).alias("title"), F.coalesce(F.nullif(artist, F.lit("")), F.lit("Unknown artist")).alias("artist"))
    offset = (F.col("row_id") % 5).cast("int")
    cards = hits(spark, d).join(tracks, "track_id").withColumn("offset_s", offset)
    return cards.select("query_row", "rank", "track_id", F.round("score", 4).alias("score"), "title", "artist", "offset_s", F.concat(V.clock("offset_s"), F.lit(" - "), V.clock(F.col("offset_s") + 10)).alias("passage"))


@query(f"WITH {TRACKS} SELECT avg(CASE WHEN genre = query_genre THEN 1.0::double ELSE 0.0::double END) AS genre_at_10, count(*) AS n FROM top")
def genre_at_k(spark, d):
    segs = segments(spark, d)
    own = segs.select(F.col("row_id").alias("query_row"), F.col("genre").alias("query_genre"))
    theirs = segs.select("row_id", "genre")
    found = hits(spark, d).join(own, "query_row").join(theirs, "row_id")
    return found.agg(F.avg(F.when(F.col("genre") == F.col("query_genre"), 1.0).otherwise(0.0)).alias("genre_at_10"), F.count("*").alias("n"))


@query(
    f"""WITH {TRACKS}, q AS (SELECT query_row, avg(CASE WHEN genre = query_genre THEN 1.0::double ELSE 0.0::double END) AS g FROM top GROUP BY 1),
 c AS (SELECT genre, count(*)::double AS n FROM seg GROUP BY 1), ch AS (SELECT sum(pow(n / (SELECT sum(n) FROM c), 2)) AS chance FROM c)
 SELECT round(avg(g), 9) AS mean, round(stddev_samp(g) / sqrt(count(*)), 9) AS sem, round(avg(g) / (SELECT chance FROM ch), 6) AS lift FROM q"""
)
def genre_agreement(spark, d):
    segs = segments(spark, d)
    own = segs.select(F.col("row_id").alias("query_row"), F.col("genre").alias("query_genre"))
    each = hits(spark, d).join(own, "query_row").join(segs.select("row_id", "genre"), "row_id").groupBy("query_row").agg(F.avg((F.col("genre") == F.col("query_genre")).cast("double")).alias("g"))
    chance = chance_biased(spark, d).select("chance")
    return each.agg(F.avg("g").alias("m"), F.stddev_samp("g").alias("s"), F.count("*").alias("n")).join(chance).select(F.round("m", 9).alias("mean"), F.round(F.col("s") / F.sqrt("n"), 9).alias("sem"), F.round(F.col("m") / F.col("chance"), 6).alias("lift"))


_TRUTH = f"WITH {SIMS}, a AS (SELECT query_row, row_id, row_number() OVER (PARTITION BY query_row ORDER BY sim DESC, row_id) AS rank FROM sims WHERE row_id <> query_row), b AS (SELECT query_row, row_id, row_number() OVER (PARTITION BY query_row ORDER BY sim DESC, row_id) AS rank FROM sims WHERE track_id <> query_track)"


def recall(truth: DataFrame, found: DataFrame, k: int) -> DataFrame:
    """recall@k by query: distinct ids of both first k over k; queries without a match have 0. Lists of the truth that are
    shorter than k raise."""
    ranks = truth.groupBy("query_row").agg(F.max("rank").alias("most"))
    whole = required(ranks, F.col("most") >= k, f"the truth has fewer than {k} rows for a query").select("query_row")
    t = truth.filter(F.col("rank") <= k).select("query_row", "row_id").distinct()
    f = found.filter(F.col("rank") <= k).select("query_row", "row_id").distinct().withColumn("hit", F.lit(1))
    each = t.join(f, ["query_row", "row_id"], "left").groupBy("query_row").agg((F.count("hit") / F.lit(float(k))).alias("recall"))
    return each.join(whole, "query_row")


def both_lists(spark, d) -> tuple[DataFrame, DataFrame]:
    """The k best other windows, and those of other tracks, from one search: a track has WINDOWS windows at most, so the
    second list lies within the first K + WINDOWS - 1."""
    wide = store.written(hits(spark, d, "row", "self", K + WINDOWS - 1), "lists")
    rest = wide.filter(F.col("track_id") != F.expr(f"query_row div {WINDOWS}")).drop("rank")
    return wide.filter(F.col("rank") <= K), best_of(rest, ["query_row"], [F.desc("score"), F.col("row_id")], K)


@query(_TRUTH + " SELECT a.query_row, count(b.row_id) / 10.0::double AS recall FROM (SELECT * FROM a WHERE rank <= 10) a LEFT JOIN (SELECT * FROM b WHERE rank <= 10) b USING (query_row, row_id) GROUP BY 1")
def recall_at_k(spark, d):
    return recall(*both_lists(spark, d), K)


@query(_TRUTH + " SELECT a.query_row, count(*) AS shared FROM a JOIN b USING (query_row, row_id) WHERE a.rank <= 10 AND b.rank <= 10 GROUP BY 1")
def list_overlap(spark, d):
    a, b = both_lists(spark, d)
    return a.select("query_row", "row_id").join(b.select("query_row", "row_id"), ["query_row", "row_id"]).groupBy("query_row").agg(F.count("*").alias("shared"))


@query(f"WITH {TRACKS}, g AS (SELECT query_row, track_id, rank, round(first_value(sim) OVER (PARTITION BY query_row ORDER BY rank) - sim, 9) AS gap FROM top) SELECT query_row, track_id, rank::int AS rank, gap FROM g WHERE gap >= 0.01 AND gap < 0.05")
def gap_band_select(spark, d):
    first = F.first("score").over(Window.partitionBy("query_row").orderBy("rank"))
    return hits(spark, d).withColumn("gap", F.round(first - F.col("score"), 9)).filter("gap >= 0.01 and gap < 0.05").select("query_row", "track_id", "rank", "gap")


@query(f"WITH {SIMS}, r AS (SELECT *, row_number() OVER (PARTITION BY query_row ORDER BY sim DESC, row_id) AS rank FROM sims WHERE row_id % 100 <> 0) SELECT query_row, rank::int AS rank, row_id, sim AS score FROM r WHERE rank <= 10")
def holdout_topk(spark, d):
    """Oracle for an index that never saw the queries: candidates are all other rows (anti-join)."""
    segs = segments(spark, d)
    asked = queries_of(segs)
    rest = segs.join(asked.select("row_id"), "row_id", "left_anti")
    return exact.topk(asked, rest, K, "row", "none").select("query_row", "rank", "row_id", "score")


# ---- vectors


@query(f"WITH {SEG} SELECT row_id, round(sqrt(list_dot_product(v, v)), 9) AS norm, abs(sqrt(list_dot_product(v, v)) - 1) <= 1e-4 AS ok FROM seg")
def norm_check(spark, d):
    return segments(spark, d).select("row_id", F.round(V.norm("vector"), 9).alias("norm"), (F.abs(V.norm("vector") - 1) <= 1e-4).alias("ok"))


@query(f"WITH {SEG}, p AS (SELECT track_id, generate_subscripts(v, 1) AS pos, unnest(v) AS x FROM seg), m AS (SELECT track_id, pos, round(avg(x), 9) AS x FROM p GROUP BY 1, 2) SELECT track_id, (pos - 1)::int AS pos, x FROM m")
def track_mean_vector(spark, d):
    return _means(segments(spark, d)).select("track_id", "pos", F.round("x", 9).alias("x"))


def _means(segs: DataFrame) -> DataFrame:
    return segs.select("track_id", F.posexplode("vector").alias("pos", "x")).groupBy("track_id", "pos").agg(F.avg("x").alias("x"))


@query(
    f"""WITH {SEG}, p AS (SELECT row_id, generate_subscripts(v, 1) AS pos, unnest(v) AS x FROM seg), mu AS (SELECT pos, avg(x) AS m FROM p GROUP BY 1),
 c AS (SELECT row_id, pos, x - m AS x FROM p JOIN mu USING (pos)), n AS (SELECT row_id, sqrt(sum(x * x)) AS n FROM c GROUP BY 1) SELECT row_id, round(n, 6) AS length FROM n"""
)
def centered_length(spark, d):
    """Length of each vector less the mean of all; the mean is one row."""
    segs = segments(spark, d)
    mu = segs.select(F.posexplode("vector").alias("pos", "x")).groupBy("pos").agg(F.avg("x").alias("m")).agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "m"))), lambda s: s["m"]).alias("mu"))
    centered = segs.join(F.broadcast(mu)).withColumn("c", F.zip_with("vector", "mu", lambda a, b: a - b))
    return centered.select("row_id", F.round(V.norm("c"), 6).alias("length"))


@query(f"WITH {SEG}, p AS (SELECT list_dot_product(a.v, b.v) AS s FROM seg a, seg b WHERE a.row_id <> b.row_id), m AS (SELECT generate_subscripts(v, 1) AS pos, unnest(v) AS x FROM seg), mm AS (SELECT pos, avg(x) AS m FROM m GROUP BY 1) SELECT round(avg(s), 7) AS mean, round(stddev_pop(s), 7) AS std, (SELECT round(sqrt(sum(m * m)), 7) FROM mm) AS norm_of_mean FROM p")
def pairwise_spread(spark, d):
    """Mean and spread of all pairs' cosines from two moments: no pair is formed. Sums of products of components, one square
    matrix a task, add up to the Gram matrix G; the squared cosines of all pairs add up to |G|^2."""
    import numpy as np
    import pyarrow as pa

    def moments(batches):
        g = s = None
        n, own, own2 = 0, 0.0, 0.0
        for b in batches:
            if b.num_rows:
                x = exact.matrix(b.column("vector"))
                square = (x * x).sum(1)
                g = x.T @ x if g is None else g + x.T @ x
                s = x.sum(0) if s is None else s + x.sum(0)
                n, own, own2 = n + len(x), own + square.sum(), own2 + (square**2).sum()
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([own]), pa.array([own2]), pa.array([s.tolist()]), pa.array([g.ravel().tolist()])], names=["n", "own", "own2", "s", "g"])

    parts = segments(spark, d).select("vector").mapInArrow(moments, "n long, own double, own2 double, s array<double>, g array<double>")
    add = lambda c: F.transform(F.sort_array(F.collect_list(F.struct("pos", "x"))), lambda e: e["x"])  # noqa: E731, ARG005
    whole = lambda c: parts.select(F.posexplode(c).alias("pos", "x")).groupBy("pos").agg(F.sum("x").alias("x")).agg(F.sum(F.col("x") * F.col("x")).alias(c))
    one = parts.agg(F.sum("n").alias("n"), F.sum("own").alias("own"), F.sum("own2").alias("own2")).join(whole("s")).join(whole("g"))
    pairs = F.col("n") * (F.col("n") - 1)
    mean = (F.col("s") - F.col("own")) / pairs
    return one.select(F.round(mean, 7).alias("mean"), F.round(F.sqrt((F.col("g") - F.col("own2")) / pairs - mean * mean), 7).alias("std"), F.round(F.sqrt("s") / F.col("n"), 7).alias("norm_of_mean"))


# ---- catalog


@query("SELECT doc_id AS track_id, (row_number() OVER (ORDER BY doc_id) - 1) * 21 AS row_start FROM documents")
def manifest_rows(spark, d):
    return numbered(table(spark, d, "documents").select("doc_id"), "n", "doc_id").select(F.col("doc_id").alias("track_id"), (F.col("n") * 21).alias("row_start"))


_WORDS = "list_filter(string_split(regexp_replace(trim(text), '\\s+', ' ', 'g'), ' '), lambda x: x <> '')"


def words(df: DataFrame) -> DataFrame:
    return df.withColumn("words", F.filter(F.split(F.regexp_replace(F.trim("text"), r"\s+", " "), " "), lambda x: x != ""))


_COUNTS = f"c AS (SELECT doc_id, source, len({_WORDS}) AS size, CASE WHEN len({_WORDS}) >= 10 THEN least(21, len({_WORDS}) - 9) ELSE 0 END::int AS n_windows FROM documents)"


def cataloged(spark, d) -> DataFrame:
    """Documents as files to ingest: their number of windows of 10 words, and their status."""
    docs = table(spark, d, "documents").withColumn("n_words", F.coalesce(F.regexp_count("text", F.lit(r"\S+")), F.lit(0)))
    n = F.when(F.col("n_words") >= 10, F.least(F.lit(21), F.col("n_words") - 9)).otherwise(0)
    return docs.withColumn("n_windows", n).withColumn("status", F.when(F.col("n_words") >= 10, "done").otherwise("short"))


@query(f"WITH {_COUNTS} SELECT CASE WHEN n_windows > 0 THEN 'done' ELSE 'short' END AS status, count(*) AS n, coalesce(sum(n_windows), 0)::bigint AS windows FROM c GROUP BY 1")
def status_counts(spark, d):
    return cataloged(spark, d).groupBy("status").agg(F.count("*").alias("n"), F.coalesce(F.sum("n_windows"), F.lit(0)).cast("long").alias("windows"))


@query(f"WITH {_COUNTS}, e AS (SELECT doc_id AS track_id, unnest(range(0, n_windows)) AS win FROM c) SELECT track_id, win::int AS win, track_id * 21 + win AS row_id FROM e")
def layout_expand(spark, d):
    done = cataloged(spark, d).filter("n_windows > 0")
    return done.select(F.col("doc_id").alias("track_id"), F.explode(F.sequence(F.lit(0), F.col("n_windows") - 1)).alias("win")).withColumn("row_id", F.col("track_id") * 21 + F.col("win"))


@query(f"WITH w AS (SELECT doc_id, {_WORDS} AS ws FROM documents), e AS (SELECT doc_id, ws, unnest(range(0, CASE WHEN len(ws) >= 10 THEN least(21, len(ws) - 9) ELSE 0 END)) AS win FROM w) SELECT doc_id, win::int AS win, md5(array_to_string(ws[win + 1 : win + 10], ' ')) AS digest FROM e")
def doc_windows(spark, d):
    docs = words(table(spark, d, "documents")).select("doc_id", "words")
    count = F.when(F.size("words") >= 10, F.least(F.lit(21), F.size("words") - 9)).otherwise(0)
    # rows are made before windows, so that a text is split once and not once a window
    each = docs.select("doc_id", "words", F.explode(F.sequence(F.lit(1), count)).alias("at")).filter("at >= 1 and size(words) >= 10")
    return each.select("doc_id", (F.col("at") - 1).alias("win"), F.md5(F.array_join(F.slice("words", F.col("at"), 10), " ")).alias("digest"))


@query("SELECT d.doc_id, d.lang, coalesce(l.quality::varchar, '(none)') AS quality, coalesce(l.toxic, -1) AS toxic FROM documents d LEFT JOIN (SELECT doc_id, max(quality) AS quality, max(toxic) AS toxic FROM labels GROUP BY 1) l USING (doc_id)")
def metadata_left_join(spark, d):
    labels = table(spark, d, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"), F.max("toxic").alias("toxic"))
    return table(spark, d, "documents").join(labels, "doc_id", "left").select("doc_id", "lang", F.coalesce(F.col("quality").cast("string"), F.lit("(none)")).alias("quality"), F.coalesce("toxic", F.lit(-1)).alias("toxic"))


@query(
    """WITH s AS (SELECT doc_id, sha256(text) AS sha FROM documents), f AS (SELECT sha, min(doc_id) AS source_id FROM s GROUP BY 1)
 SELECT s.doc_id, f.source_id, CASE WHEN f.source_id < s.doc_id THEN 'copied' ELSE 'pending' END AS status FROM s JOIN f USING (sha)"""
)
def reuse_join(spark, d):
    """Work that an earlier file with the same contents has done already."""
    s = table(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("sha"))
    f = s.groupBy("sha").agg(F.min("doc_id").alias("source_id"))
    return s.join(f, "sha").select("doc_id", "source_id", F.when(F.col("source_id") < F.col("doc_id"), "copied").otherwise("pending").alias("status"))


_LAST_ORDER = "o AS (SELECT o_custkey AS k, o_orderpriority AS v, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS w FROM orders), new AS (SELECT k, v FROM o WHERE w = 1)"


@query(f"WITH old AS (SELECT c_custkey AS k, c_mktsegment AS v FROM customer), {_LAST_ORDER} SELECT coalesce(n.k, o.k) AS k, coalesce(n.v, o.v) AS v FROM old o FULL JOIN new n ON o.k = n.k")
def meta_upsert(spark, d):
    """Keys that new rows repeat take the last one's value."""
    old = table(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.col("c_mktsegment").alias("v"))
    new = table(spark, d, "orders").select(F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("at"), F.col("o_orderpriority").alias("v"))
    return upserted(old, new, "k", "at")


@query(f"WITH {_LAST_ORDER} SELECT c_custkey AS track_id, coalesce(v, '(none)') AS genre FROM customer LEFT JOIN new ON k = c_custkey")
def last_update_join(spark, d):
    """An update by key: of several the last counts, ids that the catalog lacks are ignored, rows without an update keep their default."""
    new = last_of(table(spark, d, "orders").select(F.col("o_custkey").alias("track_id"), F.col("o_orderkey").alias("at"), F.col("o_orderpriority").alias("genre")), "track_id", "at")
    return table(spark, d, "customer").select(F.col("c_custkey").alias("track_id")).join(new, "track_id", "left").select("track_id", F.coalesce("genre", F.lit("(none)")).alias("genre"))


@query("WITH a AS (SELECT c_custkey AS k, c_nationkey AS v FROM customer), b AS (SELECT s_suppkey AS k, s_nationkey AS v FROM supplier) SELECT coalesce(a.k, b.k) AS k, a.v AS was, b.v AS now FROM a FULL JOIN b ON a.k = b.k WHERE a.v IS DISTINCT FROM b.v")
def drift_check(spark, d):
    """Differences between two key-value tables, missing keys included."""
    a = table(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.col("c_nationkey").alias("was"))
    b = table(spark, d, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_nationkey").alias("now"))
    return a.join(b, "k", "full").filter(~F.col("was").eqNullSafe(F.col("now")))


@query("WITH r AS (SELECT row_number() OVER (ORDER BY doc_id) - 1 AS place, concat_ws('|', doc_id, lang, source, text) AS line FROM documents) SELECT count(*) AS n, sum(('0x' || substr(md5(place || ':' || line), 1, 15))::ubigint::hugeint)::varchar AS digest FROM r")
def table_digest(spark, d):
    """A digest of rows in id order: 60 bits of each row together with its place add up, so a changed, missing, added or moved
    row shows, and the rows need not pass through one task."""
    docs = numbered(table(spark, d, "documents").select("doc_id", "lang", "source", "text"), "place", "doc_id")
    line = F.concat_ws("|", F.col("doc_id").cast("string"), "lang", "source", "text")
    own = F.conv(F.substring(F.md5(F.concat(F.col("place").cast("string"), F.lit(":"), line)), 1, 15), 16, 10).cast("decimal(38,0)")
    return docs.agg(F.count("*").alias("n"), F.sum(own).cast("string").alias("digest"))


@query(f"WITH {SEG}, g AS (SELECT track_id, count(*) AS n, min(win) AS lo, max(win) AS hi, round(min(sqrt(list_dot_product(v, v))), 6) AS min_norm, round(max(sqrt(list_dot_product(v, v))), 6) AS max_norm FROM seg GROUP BY 1) SELECT track_id, n, min_norm, max_norm, n = hi - lo + 1 AND lo = 0 AS whole FROM g")
def track_integrity(spark, d):
    s = segments(spark, d).withColumn("norm", V.norm("vector")).groupBy("track_id").agg(F.count("*").alias("n"), F.min("window").alias("lo"), F.max("window").alias("hi"), F.round(F.min("norm"), 6).alias("min_norm"), F.round(F.max("norm"), 6).alias("max_norm"))
    return s.select("track_id", "n", "min_norm", "max_norm", ((F.col("n") == F.col("hi") - F.col("lo") + 1) & (F.col("lo") == 0)).alias("whole"))


@query("WITH r AS (SELECT 'documents' AS name, count(*) AS n, count(DISTINCT doc_id) AS ids FROM documents UNION ALL SELECT 'embeddings', count(*), count(DISTINCT vec_id) FROM embeddings UNION ALL SELECT 'labels', count(*), count(DISTINCT doc_id) FROM labels) SELECT name, n, CASE WHEN n = ids THEN 'OK' ELSE 'FAIL' END AS state FROM r")
def integrity_report(spark, d):
    rows = [table(spark, d, t).agg(F.lit(t).alias("name"), F.count("*").alias("n"), F.countDistinct(k).alias("ids")) for t, k in (("documents", "doc_id"), ("embeddings", "vec_id"), ("labels", "doc_id"))]
    return rows[0].union(rows[1]).union(rows[2]).select("name", "n", F.when(F.col("n") == F.col("ids"), "OK").otherwise("FAIL").alias("state"))


@query("SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels")
def set_except(spark, d):
    return table(spark, d, "documents").select("doc_id").subtract(table(spark, d, "labels").select("doc_id"))


@query("SELECT doc_id FROM documents INTERSECT SELECT doc_id FROM labels")
def set_intersect(spark, d):
    return table(spark, d, "documents").select("doc_id").intersect(table(spark, d, "labels").select("doc_id"))


@query("SELECT 'documents-labels' AS pair, (SELECT count(*) FROM (SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels)) AS missing, (SELECT count(*) FROM (SELECT doc_id FROM labels EXCEPT SELECT doc_id FROM documents)) AS extra")
def set_difference_sizes(spark, d):
    a, b = (table(spark, d, t).select("doc_id").distinct().withColumn(t, F.lit(1)) for t in ("documents", "labels"))
    both = a.join(b, "doc_id", "full")
    return both.agg(F.lit("documents-labels").alias("pair"), F.count_if(F.col("labels").isNull()).alias("missing"), F.count_if(F.col("documents").isNull()).alias("extra"))


@query(f"WITH {_COUNTS} SELECT doc_id, (sum(n_windows) OVER (ORDER BY doc_id ROWS UNBOUNDED PRECEDING) - n_windows)::bigint AS row_offset FROM c")
def running_offsets(spark, d):
    """Exclusive running sum in id order."""
    return running(cataloged(spark, d).select("doc_id", "n_windows"), "row_offset", F.col("n_windows"), "doc_id").select("doc_id", "row_offset")


@query("SELECT event_id, floor(value)::bigint // 60 || ':' || lpad((floor(value)::bigint % 60)::varchar, 2, '0') AS clock FROM events WHERE value >= 0")
def clock_strings(spark, d):
    return table(spark, d, "events").filter("value >= 0").select("event_id", V.clock(F.floor("value")).alias("clock"))


# ---- sampling


def quota_table(sizes: DataFrame, n: int) -> DataFrame:
    """g and quota of strata sizes (g, size): max(1, round half even) of the share, trimmed from the largest quotas or padded
    where most is left, by sorting slots. A row a stratum."""
    total = sizes.agg(F.sum("size").alias("total"), F.count("*").alias("strata"))
    q = sizes.join(total).withColumn("quota", F.greatest(F.lit(1), F.bround(n * F.col("size") / F.col("total")).cast("int")))
    q = q.filter(F.when(F.col("strata") <= n, F.lit(True)).otherwise(F.raise_error(F.lit("fewer rows asked for than strata")).cast("boolean")))
    d = q.agg((F.sum("quota") - n).alias("d"))
    trims = q.join(d).filter("d > 0 and quota >= 2").select("g", "d", F.explode(F.sequence(F.lit(2), F.col("quota"))).alias("v"), F.lit(-1).alias("change"))
    pads = q.join(d).filter("d < 0").select("g", "d", F.explode(F.transform(F.sequence(F.lit(0), -F.col("d").cast("int") - 1), lambda j: F.col("size").cast("int") - F.col("quota") - j)).alias("v"), F.lit(1).alias("change"))
    slots = best_of(trims.union(pads).withColumn("one", F.lit(1)), ["one"], [F.desc("v"), F.desc("g")], 1 << 30, "slot").filter(F.col("slot") <= F.abs("d"))
    change = slots.groupBy("g").agg(F.sum("change").alias("change"))
    return q.join(change, "g", "left").select("g", "size", F.least(F.col("quota") + F.coalesce("change", F.lit(0)), F.col("size")).cast("int").alias("quota"))


_N = 100
_QUOTA = f"""sz AS (SELECT lang AS g, count(*) AS size FROM documents GROUP BY 1), t AS (SELECT sum(size) AS total FROM sz),
 q AS (SELECT g, size, greatest(1, round_even({_N} * size::double / total, 0))::int AS quota FROM sz, t), dd AS (SELECT (sum(quota) - {_N})::bigint AS d FROM q),
 trims AS (SELECT g, unnest(range(2, quota + 1)) AS v, -1 AS change FROM q, dd WHERE d > 0), pads AS (SELECT g, size - quota - unnest(range(0, -d)) AS v, 1 AS change FROM q, dd WHERE d < 0),
 slots AS (SELECT *, row_number() OVER (ORDER BY v DESC, g DESC) AS slot FROM (SELECT * FROM trims UNION ALL SELECT * FROM pads)),
 ch AS (SELECT g, sum(change) AS change FROM slots, dd WHERE slot <= abs(d) GROUP BY 1),
 quotas AS (SELECT q.g, q.size, least(q.quota + coalesce(change, 0), q.size)::int AS quota FROM q LEFT JOIN ch USING (g))"""


@query(f"WITH {_QUOTA} SELECT g, size, quota FROM quotas")
def stratified_quota(spark, d):
    return quota_table(table(spark, d, "documents").groupBy(F.col("lang").alias("g")).agg(F.count("*").alias("size")), _N)


@query(f"WITH {_QUOTA}, r AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY md5('{SEED}:' || doc_id), doc_id) AS k FROM documents) SELECT doc_id, lang FROM r JOIN quotas ON g = lang WHERE k <= quota")
def stratified_sample(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "lang")
    first = best_of(docs.withColumn("h", V.hash_order(SEED, "doc_id")), ["lang"], [F.col("h"), F.col("doc_id")], _N, "k")
    quotas = stratified_quota(spark, d)
    return first.join(quotas, first["lang"] == quotas["g"]).filter("k <= quota").select("doc_id", "lang")


@query(f"SELECT doc_id FROM documents ORDER BY md5('{SEED}:' || doc_id), doc_id LIMIT 50")
def uniform_sample(spark, d):
    return table(spark, d, "documents").select("doc_id").orderBy(V.hash_order(SEED, "doc_id"), "doc_id").limit(50)


@query(f"SELECT vec_id AS row_id, row_number() OVER (ORDER BY md5('{SEED + 1}:' || vec_id), vec_id) - 1 AS place FROM embeddings")
def insertion_order(spark, d):
    own = segments(spark, d).select("row_id", V.hash_order(SEED + 1, "row_id").alias("h"))
    return numbered(own, "place", "h", "row_id").select("row_id", "place")


@query(f"WITH {SEG}, n AS (SELECT track_id, count(*) AS n FROM seg GROUP BY 1) SELECT s.track_id, s.row_id FROM seg s JOIN n USING (track_id) WHERE s.win = n.n // 2")
def mid_window(spark, d):
    segs = segments(spark, d)
    n = segs.groupBy("track_id").agg(F.expr("count(*) div 2").alias("mid"))
    return segs.join(n, "track_id").filter("window = mid").select("track_id", "row_id")


# ---- measures


@query("WITH c AS (SELECT label AS g, count(*)::double AS n FROM embeddings GROUP BY 1) SELECT sum(pow(n / (SELECT sum(n) FROM c), 2)) AS chance FROM c")
def chance_biased(spark, d):
    c = segments(spark, d).groupBy("genre").agg(F.count("*").cast("double").alias("n"))
    return c.agg((F.sum(F.col("n") * F.col("n")) / (F.sum("n") * F.sum("n"))).alias("chance"))


SQL["chance_biased"] = "WITH c AS (SELECT label AS g, count(*)::double AS n FROM embeddings GROUP BY 1) SELECT sum(n * n) / (sum(n) * sum(n)) AS chance FROM c"


@query("WITH c AS (SELECT label AS g, count(*)::double AS n FROM embeddings GROUP BY 1) SELECT sum(n * (n - 1)) / (sum(n) * (sum(n) - 1)) AS chance FROM c")
def chance_unbiased(spark, d):
    c = segments(spark, d).groupBy("genre").agg(F.count("*").cast("double").alias("n"))
    return c.agg((F.sum(F.col("n") * (F.col("n") - 1)) / (F.sum("n") * (F.sum("n") - 1))).alias("chance"))


@query("SELECT event_type, quantile_cont(value, 0.5) AS p50, quantile_cont(value, 0.95) AS p95, quantile_cont(value, 0.99) AS p99, round(1000.0 / avg(value), 6) AS per_second FROM events GROUP BY 1")
def latency_percentiles(spark, d):
    e = table(spark, d, "events")
    speed = e.groupBy("event_type").agg(F.round(1000.0 / F.avg("value"), 6).alias("per_second"))
    return quantiles(e, ["event_type"], "value", {"p50": 0.5, "p95": 0.95, "p99": 0.99}, "event_id").join(speed, "event_type")


@query("WITH p AS (SELECT event_type, event_id % 3 AS pass, quantile_cont(value, 0.95) AS p95 FROM events GROUP BY 1, 2) SELECT event_type, quantile_cont(p95, 0.5) AS median_p95 FROM p GROUP BY 1")
def pass_medians(spark, d):
    e = table(spark, d, "events").withColumn("pass", F.col("event_id") % 3)
    p = quantiles(e, ["event_type", "pass"], "value", {"p95": 0.95}, "event_id")
    return p.groupBy("event_type").agg(F.percentile("p95", 0.5).alias("median_p95"))  # three passes


@query("WITH p AS (SELECT DISTINCT p_size, p_retailprice FROM part) SELECT a.p_size, a.p_retailprice FROM p a WHERE NOT EXISTS (SELECT 1 FROM p b WHERE b.p_size >= a.p_size AND b.p_retailprice <= a.p_retailprice AND (b.p_size > a.p_size OR b.p_retailprice < a.p_retailprice))")
def skyline(spark, d):
    """Points that none beats in both (large size, low price). The best price of each size comes first, so the running
    minimum over sizes sees a row a size."""
    least = table(spark, d, "part").groupBy("p_size").agg(F.min("p_retailprice").alias("p_retailprice"))
    larger = Window.orderBy(F.desc("p_size")).rowsBetween(Window.unboundedPreceding, -1)
    return least.withColumn("m", F.min("p_retailprice").over(larger)).filter("m is null or p_retailprice < m").select("p_size", "p_retailprice")


_BAND = "CASE WHEN l_discount >= 0.00 AND l_discount < 0.03 THEN 'close' WHEN l_discount >= 0.03 AND l_discount < 0.06 THEN 'middle' ELSE 'far' END"


@query(f"SELECT {_BAND} AS band, count(*) AS trials, count(*) FILTER (l_returnflag = 'R') AS correct, (count(*) FILTER (l_returnflag = 'R'))::double / count(*) AS accuracy FROM lineitem GROUP BY 1")
def band_accuracy(spark, d):
    """Trials by band; whatever fits no band falls into the last."""
    x = F.col("l_discount")
    band = F.when((x >= 0.0) & (x < 0.03), "close").when((x >= 0.03) & (x < 0.06), "middle").otherwise("far")
    won = F.count_if(F.col("l_returnflag") == "R")
    return table(spark, d, "lineitem").groupBy(band.alias("band")).agg(F.count("*").alias("trials"), won.alias("correct"), (won / F.count("*")).alias("accuracy"))


def tail(n: Column, k: Column) -> Column:
    """P(at least k of n fair trials); terms as logarithms, so that many trials don't underflow."""
    start = n * F.lit(-math.log(2.0))

    def add(s, i):
        c = s["c"] + F.log((n - i + 1) / i)
        return F.named_struct(F.lit("c"), c, F.lit("s"), s["s"] + F.when(i >= k, F.exp(c)).otherwise(F.lit(0.0)))

    first = F.named_struct(F.lit("c"), start, F.lit("s"), F.when(k <= 0, F.exp(start)).otherwise(F.lit(0.0)))
    return F.aggregate(F.sequence(F.lit(1), n), first, add, lambda s: s["s"])


_TAIL = "WITH g AS (SELECT o_orderpriority AS g, (count(*) % 60 + 1)::int AS n, (count(*) % 60 // 2)::int AS k FROM orders GROUP BY 1)"


@query(
    _TAIL
    + ", i AS (SELECT g, n, k, unnest(range(0, n + 1)) AS i FROM g), c AS (SELECT g, n, k, i, exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) - n * ln(2)) AS p FROM i) SELECT g, n, k, round(sum(p), 6) AS p FROM c WHERE i >= k GROUP BY 1, 2, 3"
)
def binomial_tail(spark, d):
    """P(at least k of n fair trials), term by term from the one before."""
    g = table(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("g")).agg((F.count("*") % 60 + 1).cast("int").alias("n"), F.expr("cast(count(*) % 60 div 2 as int)").alias("k"))
    return g.select("g", "n", "k", F.round(tail(F.col("n"), F.col("k")), 6).alias("p"))


@query(
    """WITH g AS (SELECT o_custkey AS artist, count(*) AS n FROM orders GROUP BY 1 HAVING count(*) >= 12), t AS (SELECT count(*) AS total FROM orders)
 SELECT artist, n, round(n::double / total * 20, 9) AS expected FROM g, t ORDER BY n DESC, artist LIMIT 14"""
)
def large_groups(spark, d):
    """Groups of a least size, the 14 largest, with what chance would expect among 20."""
    o = table(spark, d, "orders")
    g = o.groupBy(F.col("o_custkey").alias("artist")).agg(F.count("*").alias("n")).filter("n >= 12")
    return g.join(o.agg(F.count("*").alias("total"))).select("artist", "n", F.round(F.col("n").cast("double") / F.col("total") * 20, 9).alias("expected")).orderBy(F.desc("n"), "artist").limit(14)


_ARTIST = f"WITH {TRACKS}, a AS (SELECT query_row, (query_track % 10) AS artist, track_id % 10 AS other FROM top), n AS (SELECT track_id % 10 AS artist, count(DISTINCT track_id)::double AS n FROM seg GROUP BY 1)"


@query(_ARTIST + ", h AS (SELECT artist, avg((artist = other)::int::double) AS share FROM a GROUP BY 1) SELECT h.artist, round(share / (n / (SELECT sum(n) FROM n)), 6) AS lift FROM h JOIN n USING (artist)")
def artist_lift(spark, d):
    """How much more often than chance a query's tracks are by its own artist (track id modulo 10)."""
    tracks = segments(spark, d).select("track_id").distinct()
    n = tracks.groupBy((F.col("track_id") % 10).alias("artist")).agg(F.count("*").cast("double").alias("n"))
    found = hits(spark, d).select((F.expr("query_row div 5") % 10).alias("artist"), (F.col("track_id") % 10).alias("other"))
    share = found.groupBy("artist").agg(F.avg((F.col("artist") == F.col("other")).cast("double")).alias("share"))
    return share.join(n, "artist").join(n.agg(F.sum("n").alias("total"))).select("artist", F.round(F.col("share") / (F.col("n") / F.col("total")), 6).alias("lift"))


# ---- graphs


@query(f"SELECT vec_id AS row_id, floor(-ln((('0x' || substr(md5('{SEED}:' || vec_id), 1, 8))::ubigint::double + 0.5) / 4294967296.0) / ln(8.0))::int AS level FROM embeddings")
def hnsw_levels(spark, d):
    return segments(spark, d).select("row_id", V.level(SEED, "row_id", M).alias("level"))


def placed(spark, d) -> DataFrame:
    """All windows, dealt out to shards."""
    segs = segments(spark, d)
    return graph.sharded(segs, graph.shard_count(segs.count())).select("shard", "row_id", "vector")


def index(spark, d) -> DataFrame:
    """The graph over all windows, written once."""
    return store.written(graph.build(placed(spark, d), M), "graph")


def widest(nodes: DataFrame) -> int:
    return int(nodes.groupBy("shard").count().agg(F.max("count")).first()[0])


@query()
def hnsw_recall(spark, d):
    """recall@10 of the beam search at ef 64 against exact search, and the distances that it computed in all shards."""
    found = store.written(graph.search(index(spark, d), queries_of(segments(spark, d)), K, 64, M), "hits")
    work = found.groupBy("query_row").agg(F.max("evaluations").alias("evaluations"))
    return recall(hits(spark, d, "row", "self"), found, K).join(work, "query_row")


@query(SQL["segment_topk_self_excl"])
def hnsw_fullbeam_topk(spark, d):
    """A beam as wide as a shard finds what exact search finds."""
    nodes = index(spark, d)
    return graph.search(nodes, queries_of(segments(spark, d)), K, widest(nodes), M).select("query_row", "rank", "row_id", "score")


def tracks_of(found: DataFrame, k: int) -> DataFrame:
    """The k best tracks other than the query's, each by its best window."""
    others = found.withColumn("track_id", F.expr(f"row_id div {WINDOWS}")).filter(F.col("track_id") != F.expr(f"query_row div {WINDOWS}")).drop("rank")
    once = best_of(others, ["query_row", "track_id"], [F.desc("score"), F.col("row_id")], 1, "w").drop("w")
    return best_of(once, ["query_row"], [F.desc("score"), F.col("row_id")], k).select("query_row", "rank", "track_id", "row_id", "score")


def overfetched(nodes: DataFrame, asked: DataFrame, k: int, want: int = 50) -> DataFrame:
    """k tracks for each query from an index of windows. Queries that `want` windows leave short search again for four times as
    many, until they have k or have seen the whole index; those that have k are done."""
    n, parts = nodes.count(), []
    while True:
        tracks = store.written(tracks_of(graph.search(nodes, asked, want, max(64, want), M), k), "tracks")
        full = tracks.groupBy("query_row").count().filter(F.col("count") >= k).select("query_row")
        last = want >= n
        parts.append(tracks if last else tracks.join(full, "query_row", "left_semi"))
        asked = store.written(asked.join(full.withColumnRenamed("query_row", "row_id"), "row_id", "left_anti"), "asked")
        if last or asked.isEmpty():
            break
        want = min(n, want * 4)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query()
def overfetch_dedupe(spark, d):
    return overfetched(index(spark, d), queries_of(segments(spark, d)), K)


@query(f"WITH {SIMS}, r AS (SELECT *, row_number() OVER (PARTITION BY query_row ORDER BY sim DESC, row_id) AS w FROM sims WHERE row_id <> query_row), b AS (SELECT query_row, track_id, row_id, sim, row_number() OVER (PARTITION BY query_row, track_id ORDER BY sim DESC, row_id) AS t FROM r WHERE w <= 12 AND track_id <> query_track), k AS (SELECT *, row_number() OVER (PARTITION BY query_row ORDER BY sim DESC, row_id) AS rank FROM b WHERE t = 1) SELECT query_row, rank::int AS rank, track_id, row_id, sim AS score FROM k WHERE rank <= 10")
def ann_track_hits(spark, d):
    """Tracks among 12 windows from the index, not widened: there may be fewer than k."""
    nodes = index(spark, d)
    return tracks_of(graph.search(nodes, queries_of(segments(spark, d)), 12, widest(nodes), M), K)


@query("SELECT 'rows' AS what, (SELECT count(*) FROM embeddings) AS n UNION ALL SELECT 'broken rules', 0 UNION ALL SELECT 'misshapen rows', 0")
def hnsw_validate(spark, d):
    """Rows of the built graph, and what is wrong with it."""
    nodes = index(spark, d)
    kinds = {"rows": nodes, "broken rules": graph.problems(nodes, graph.edges(nodes), M), "misshapen rows": graph.misshapen(nodes)}
    out = None
    for name, df in kinds.items():
        one = df.agg(F.lit(name).alias("what"), F.count("*").alias("n"))
        out = one if out is None else out.unionByName(one)
    return out


@query(
    """WITH nodes AS (SELECT n_regionkey AS shard, n_nationkey AS row_id, n_nationkey % 3 AS level, n_nationkey % 7 = 0 AS entry FROM nation),
 base AS (SELECT n_regionkey AS shard, (j % 4) - 1 AS layer, n_nationkey AS src, (n_nationkey + j * 5) % 27 AS dst, n_nationkey, j FROM nation, range(0, 8) AS r(j)),
 links AS (SELECT shard, layer, src, dst FROM base UNION ALL SELECT shard, layer, src, dst FROM base WHERE n_nationkey % 5 = 0 AND j = 1),
 ends AS (SELECT l.*, a.level AS sl, b.level AS dl FROM links l LEFT JOIN nodes a ON a.shard = l.shard AND a.row_id = l.src LEFT JOIN nodes b ON b.shard = l.shard AND b.row_id = l.dst),
 found AS (SELECT 'link of an unknown node' AS problem, count(*) FILTER (sl IS NULL OR dl IS NULL) AS n FROM ends
 UNION ALL SELECT 'link above a node''s level', count(*) FILTER (layer > sl OR layer > dl OR layer < 0) FROM ends
 UNION ALL SELECT 'link to itself', count(*) FILTER (src = dst) FROM ends
 UNION ALL SELECT 'link twice', count(*) FROM (SELECT 1 FROM links GROUP BY shard, layer, src, dst HAVING count(*) > 1)
 UNION ALL SELECT 'too many links', count(*) FROM (SELECT 1 FROM links GROUP BY shard, layer, src HAVING count(*) > CASE WHEN layer = 0 THEN 2 ELSE 1 END)
 UNION ALL SELECT 'entry not one node of the highest level', count(*) FROM (SELECT 1 FROM nodes GROUP BY shard HAVING count(*) FILTER (entry) <> 1 OR coalesce(max(CASE WHEN entry THEN level END) < max(level), true)))
 SELECT problem, n FROM found WHERE n > 0"""
)
def malformed_graph(spark, d):
    """What validation says of a graph that breaks the rules: nations as nodes, linked by arithmetic."""
    nation = table(spark, d, "nation").withColumn("n_nationkey", F.col("n_nationkey").cast("long"))
    nodes = nation.select(F.col("n_regionkey").alias("shard"), F.col("n_nationkey").alias("row_id"), (F.col("n_nationkey") % 3).alias("level"), (F.col("n_nationkey") % 7 == 0).alias("entry"))
    base = nation.select("n_nationkey", F.col("n_regionkey").alias("shard"), F.explode(F.sequence(F.lit(0), F.lit(7))).alias("j"))
    base = base.select("shard", ((F.col("j") % 4) - 1).alias("layer"), F.col("n_nationkey").alias("src"), F.col("j").alias("pos"), ((F.col("n_nationkey") + F.col("j") * 5) % 27).alias("dst"))
    return graph.problems(nodes, base.unionByName(base.filter("src % 5 = 0 and pos = 1")), 1)


@query()
def bfs_order(spark, d):
    nodes = index(spark, d)
    return graph.bfs(nodes, graph.edges(nodes), lambda df: store.written(df, "bfs"))


@query()
def relabel_edges(spark, d):
    """Links with their ends renamed by breadth-first rank."""
    nodes = index(spark, d)
    links = store.written(graph.edges(nodes), "links")
    return graph.permuted(nodes.select("shard", "row_id", "level", "entry"), links, graph.bfs(nodes, links, lambda df: store.written(df, "bfs")))[1]


@query()
def page_locality(spark, d):
    """Pages of 4096 bytes that a neighbourhood's vectors lie on, laid out by id and by breadth-first rank."""
    nodes = index(spark, d)
    links = store.written(graph.edges(nodes), "links")
    by_id = nodes.select("shard", F.col("row_id").alias("node"), (F.row_number().over(Window.partitionBy("shard").orderBy("row_id")) - 1).alias("rank"))
    by_bfs = graph.bfs(nodes, links, lambda df: store.written(df, "bfs")).select("shard", "node", "rank")
    size = 4 * nodes.agg(F.max(F.size("vector"))).first()[0]  # as 32-bit floats
    return graph.locality(links, by_id, size).withColumn("layout", F.lit("id")).unionByName(graph.locality(links, by_bfs, size).withColumn("layout", F.lit("breadth first")))


@query()
def hnsw_sweep(spark, d):
    """Recall and computed distances by links a node and widths of the beams."""
    truth = store.written(hits(spark, d, "row", "self").select("query_row", "row_id"), "truth")
    return graph.sweep(store.written(placed(spark, d), "placed"), queries_of(segments(spark, d)), truth, K, (6, 12), (40, 80), (16, 64))


@query(SQL["segment_topk_self_excl"])
def stored_graph_topk(spark, d):
    """A graph that is built in waves, stopped after the first, taken up again, and loaded back with its sources checked."""
    nodes, path = store.written(placed(spark, d), "placed"), store.fresh_path(spark, "stored")
    graph.build_stored(spark, nodes, path, M, at_once=2, stop_after=1)
    graph.build_stored(spark, nodes, path, M, at_once=2)
    kept = graph.load_stored(spark, nodes, path, M, at_once=2)
    return graph.search(kept, queries_of(segments(spark, d)), K, widest(kept), M).select("query_row", "rank", "row_id", "score")


@query("SELECT doc_id AS track_id, 'done' AS status, sha256(text) AS sha FROM documents")
def resumable_ingest(spark, d):
    from quern.streaming.ingest import ingest_documents

    return ingest_documents(spark, d)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
