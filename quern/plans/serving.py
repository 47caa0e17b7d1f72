"""Serving, identity and listening-test queries, each beside its SQL; see catalogue for the tables' roles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.functions import vectors as V
from quern.operators import exact
from quern.operators.embed import embedded_tracks
from quern.operators.tables import WINDOWS, best_of, numbered, queries_of, required, segments, table
from quern.plans.catalogue import _COUNTS, _N, _WORDS, K, SEED, SEG, SIMS, TRACKS, cataloged, hits, integrity_report, query, words
from quern.sources import store

# ---- searches over a catalog with holes


@query(
    f"""WITH {SIMS}, best AS (SELECT *, row_number() OVER (PARTITION BY query_row, track_id ORDER BY sim DESC, row_id) AS w FROM sims WHERE track_id <> query_track AND row_id % 11 <> 5 AND track_id % 7 <> 3),
 r AS (SELECT *, row_number() OVER (PARTITION BY query_row ORDER BY sim DESC, row_id) AS rank FROM best WHERE w = 1) SELECT query_row, rank::int AS rank, track_id, row_id, sim AS score FROM r WHERE rank <= 10"""
)
def known_tracks_topk(spark, d):
    """Rows that belong to no track (every eleventh here) and tracks that the catalog lacks (every seventh) are never found."""
    segs = segments(spark, d)
    layout = segs.filter("row_id % 11 <> 5").select("row_id", "track_id")
    catalog = segs.select("track_id").distinct().filter("track_id % 7 <> 3")
    known = segs.drop("track_id").join(layout, "row_id").join(catalog, "track_id", "left_semi")
    return exact.topk(queries_of(segs), known, K, "max", "track").select("query_row", "rank", "track_id", "row_id", "score")


@query(f"WITH {SEG}, c AS (SELECT s.* FROM seg s WHERE track_id IN (SELECT doc_id FROM labels WHERE quality IS NOT NULL)), sims AS (SELECT q.row_id AS query_row, c.row_id, round(list_dot_product(q.v, c.v), 9) AS sim FROM seg q, c WHERE q.row_id % 100 = 0 AND c.track_id <> q.track_id), r AS (SELECT *, row_number() OVER (PARTITION BY query_row ORDER BY sim DESC, row_id) AS rank FROM sims) SELECT query_row, rank::int AS rank, row_id, sim AS score FROM r WHERE rank <= 10")
def labelled_topk(spark, d):
    """Only windows of tracks with a label are candidates."""
    segs = segments(spark, d)
    labelled = table(spark, d, "labels").filter("quality is not null").select(F.col("doc_id").alias("track_id"))
    return exact.topk(queries_of(segs), segs.join(labelled, "track_id", "left_semi"), K, "row", "track").select("query_row", "rank", "row_id", "score")


@query(
    f"""WITH {SIMS}, r AS (SELECT *, row_number() OVER (PARTITION BY query_row ORDER BY sim DESC, row_id) AS rank FROM sims WHERE row_id <> query_row AND row_id % 70 = 10 AND genre = query_genre),
 want AS (SELECT row_id AS query_row, k FROM seg, range(1, 11) AS t(k) WHERE row_id % 100 = 0)
 SELECT w.query_row, w.k::int AS rank, coalesce(r.row_id, -1) AS row_id, coalesce(r.sim, '-infinity'::double) AS score FROM want w LEFT JOIN r ON r.query_row = w.query_row AND r.rank = w.k"""
)
def padded_topk(spark, d):
    """k rows for every query: where candidates are few, the list is filled up with id -1 and score -infinity."""
    segs = segments(spark, d)
    asked = queries_of(segs)
    some = segs.filter("row_id % 70 = 10")
    found = exact.topk(asked, some, 1 << 20, "row", "self").join(asked.select(F.col("row_id").alias("query_row"), F.col("genre").alias("query_genre")), "query_row").join(some.select("row_id", "genre"), "row_id").filter("genre = query_genre").drop("rank")
    return padded(best_of(found, ["query_row"], [F.desc("score"), F.col("row_id")], K), asked, K)


def padded(found: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    want = asked.select(F.col("row_id").alias("query_row"), F.explode(F.sequence(F.lit(1), F.lit(k))).alias("rank"))
    return want.join(found.select("query_row", "rank", "row_id", "score"), ["query_row", "rank"], "left").select("query_row", "rank", F.coalesce("row_id", F.lit(-1)).alias("row_id"), F.coalesce("score", F.lit(float("-inf"))).alias("score"))


_CENTER = f"""{SEG}, p AS (SELECT row_id, generate_subscripts(v, 1) AS pos, unnest(v) AS x FROM seg), mu AS (SELECT pos, avg(x) AS m FROM p GROUP BY 1),
 c AS (SELECT row_id, pos, x - m AS x FROM p JOIN mu USING (pos)), n AS (SELECT row_id, sqrt(sum(x * x)) AS n FROM c GROUP BY 1), u AS (SELECT row_id, list(x / n ORDER BY pos) AS v FROM c JOIN n USING (row_id) GROUP BY 1)"""


@query(f"WITH {_CENTER}, sims AS (SELECT q.row_id AS query_row, c.row_id, round(list_dot_product(q.v, c.v), 9) AS sim FROM u q, u c WHERE q.row_id % 100 = 0 AND q.row_id <> c.row_id), r AS (SELECT *, row_number() OVER (PARTITION BY query_row ORDER BY sim DESC, row_id) AS rank FROM sims) SELECT query_row, rank::int AS rank, row_id, round(sim, 6) AS score FROM r WHERE rank <= 10")
def centered_topk(spark, d):
    """Search among vectors less the mean of all, brought back to unit length. The mean is one row."""
    segs = centered(segments(spark, d))
    return exact.topk(queries_of(segs), segs, K, "row", "self").select("query_row", "rank", "row_id", F.round("score", 6).alias("score"))


def centered(segs: DataFrame) -> DataFrame:
    mu = segs.select(F.posexplode("vector").alias("pos", "x")).groupBy("pos").agg(F.avg("x").alias("m")).agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "m"))), lambda s: s["m"]).alias("mu"))
    less = segs.join(F.broadcast(mu)).withColumn("vector", F.zip_with("vector", "mu", lambda a, b: a - b)).drop("mu")
    return less.withColumn("vector", V.normalized("vector"))


@query(
    f"""WITH {SEG}, p AS (SELECT track_id, generate_subscripts(v, 1) AS pos, unnest(v) AS x FROM seg WHERE track_id % 20 = 0), m AS (SELECT track_id, pos, avg(x) AS x FROM p GROUP BY 1, 2),
 n AS (SELECT track_id, sqrt(sum(x * x)) AS n FROM m GROUP BY 1), q AS (SELECT track_id, list(x / n ORDER BY pos) AS v FROM m JOIN n USING (track_id) GROUP BY 1),
 sims AS (SELECT q.track_id AS query_track, c.track_id, c.row_id, round(list_dot_product(q.v, c.v), 9) AS sim FROM q, seg c WHERE c.track_id <> q.track_id),
 best AS (SELECT *, row_number() OVER (PARTITION BY query_track, track_id ORDER BY sim DESC, row_id) AS w FROM sims), r AS (SELECT *, row_number() OVER (PARTITION BY query_track ORDER BY sim DESC, row_id) AS rank FROM best WHERE w = 1)
 SELECT query_track, rank::int AS rank, track_id, row_id, round(sim, 6) AS score FROM r WHERE rank <= 10"""
)
def clip_topk(spark, d):
    """A whole clip as the query: the mean of its windows' vectors, at unit length."""
    segs = segments(spark, d)
    means = segs.filter("track_id % 20 = 0").select("track_id", F.posexplode("vector").alias("pos", "x")).groupBy("track_id", "pos").agg(F.avg("x").alias("x"))
    whole = means.groupBy("track_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "x"))), lambda s: s["x"]).alias("vector"))  # a vector a track
    asked = whole.select(F.col("track_id").alias("row_id"), "track_id", V.normalized("vector").alias("vector"))
    return exact.topk(asked, segs, K, "max", "track").select(F.col("query_row").alias("query_track"), "rank", "track_id", "row_id", F.round("score", 6).alias("score"))


@query(f"WITH {TRACKS}, h AS (SELECT t.query_row, t.rank, t.track_id, t.sim FROM top t WHERE t.rank <= 3) SELECT query_row, to_json({{'rank': rank::int, 'track_id': track_id, 'title': 'Untitled ' || track_id}}) AS card FROM h")
def card_json(spark, d):
    """The first three hits of each query as JSON."""
    top = hits(spark, d, k=3)
    return top.select("query_row", F.to_json(F.struct("rank", "track_id", F.concat(F.lit("Untitled "), F.col("track_id").cast("string")).alias("title"))).alias("card"))


@query("SELECT event_id, (props->>'$.k')::int AS k, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS at FROM events")
def event_props(spark, d):
    """A number from JSON and a time as UTC in ISO form."""
    e = table(spark, d, "events")
    return e.select("event_id", F.from_json("props", "k int")["k"].alias("k"), F.date_format(F.col("ts").cast("timestamp_ntz"), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("at"))


# ---- catalog


@query(f"WITH {_COUNTS} SELECT c.doc_id FROM c JOIN labels l USING (doc_id) WHERE c.n_windows >= 15 AND c.source <> 'web' AND l.quality IS NOT NULL")
def eligible_tracks(spark, d):
    """Enough windows, not of one source, and with a label."""
    found = cataloged(spark, d).filter((F.col("n_windows") >= 15) & (F.col("source") != "web"))
    return found.join(table(spark, d, "labels").filter(F.col("quality").isNotNull()).select("doc_id"), "doc_id").select("doc_id")


@query(f"WITH {_COUNTS}, e AS (SELECT doc_id, size, unnest(range(0, size, 10)) AS beg FROM c) SELECT count(*) FILTER (size - beg >= 10) AS whole, count(*) FILTER (size - beg < 10) AS short FROM e")
def window_guard(spark, d):
    """Windows of ten words side by side: how many are whole, and how many a guard of their length turns away."""
    docs = words(table(spark, d, "documents")).select("doc_id", "words")
    each = docs.filter("size(words) > 0").select("words", F.explode(F.sequence(F.lit(0), F.size("words") - 1, F.lit(10))).alias("at"))
    whole = F.size(F.slice("words", F.col("at") + 1, 10)) == 10
    return each.agg(F.count_if(whole).alias("whole"), F.count_if(~whole).alias("short"))


@query(f"WITH {SEG} SELECT event_id AS row_id, coalesce(s.track_id, -1) AS track_id FROM events e LEFT JOIN seg s ON s.row_id = e.event_id")
def row_owner(spark, d):
    """The track of each row id, -1 for a hole or a row beyond the layout."""
    layout = segments(spark, d).select("row_id", "track_id")
    return table(spark, d, "events").select(F.col("event_id").alias("row_id")).join(layout, "row_id", "left").select("row_id", F.coalesce("track_id", F.lit(-1)).alias("track_id"))


_REUSE = "s AS (SELECT doc_id, sha256(text) AS sha FROM documents WHERE doc_id % 3 = 0), t AS (SELECT doc_id, sha256(CASE WHEN doc_id % 5 = 0 THEN text || ' changed' ELSE text END) AS sha FROM documents WHERE doc_id % 2 = 0)"


def reused(source: DataFrame, target: DataFrame, source_about: DataFrame, target_about: DataFrame) -> DataFrame:
    """doc_id, status and copied of the target's files: 'done' where the source has the file with the same contents. Sources made
    with another configuration (name, value) raise: their results must not be mixed."""
    drift = source_about.withColumnRenamed("value", "was").join(target_about.withColumnRenamed("value", "now"), "name", "full")
    agrees = drift.agg(F.count_if(~F.col("was").eqNullSafe(F.col("now"))).alias("n"))
    checked = required(agrees, F.col("n") == 0, "the source was made with another configuration")  # one row
    both = target.join(source.withColumnRenamed("sha", "had"), "doc_id", "left")
    found = both.withColumn("outcome", F.when(F.col("had").isNull(), "new").when(F.col("had") == F.col("sha"), "copied").otherwise("mismatched"))
    return found.join(F.broadcast(checked)).select("doc_id", F.when(F.col("outcome") == "copied", "done").otherwise("pending").alias("status"), "outcome")


def _reuse(spark, d) -> DataFrame:
    docs = table(spark, d, "documents")
    source = docs.filter("doc_id % 3 = 0").select("doc_id", F.sha2("text", 256).alias("sha"))
    target = docs.filter("doc_id % 2 = 0").select("doc_id", F.sha2(F.when(F.col("doc_id") % 5 == 0, F.concat("text", F.lit(" changed"))).otherwise(F.col("text")), 256).alias("sha"))
    about = table(spark, d, "region").select(F.col("r_regionkey").cast("string").alias("name"), F.col("r_name").alias("value"))
    return reused(source, target, about, about)


@query(f"WITH {_REUSE} SELECT t.doc_id, CASE WHEN s.sha = t.sha THEN 'done' ELSE 'pending' END AS status, CASE WHEN s.sha IS NULL THEN 'new' WHEN s.sha = t.sha THEN 'copied' ELSE 'mismatched' END AS outcome FROM t LEFT JOIN s USING (doc_id)")
def reuse_by_contents(spark, d):
    """Work that another catalog has done already, taken over where id and contents are the same."""
    return _reuse(spark, d)


@query(f"WITH {_REUSE}, r AS (SELECT s.sha AS had, t.sha FROM t LEFT JOIN s USING (doc_id)) SELECT count(*) FILTER (had = sha) AS copied, count(*) FILTER (had <> sha) AS mismatched, count(*) FILTER (had IS NULL) AS untouched FROM r")
def reuse_summary(spark, d):
    one = lambda x: F.count_if(F.col("outcome") == x)
    return _reuse(spark, d).agg(one("copied").alias("copied"), one("mismatched").alias("mismatched"), one("new").alias("untouched"))


@query(f"SELECT vec_id AS row_id, row_number() OVER (ORDER BY md5('{SEED + 1}:' || vec_id), vec_id) - 1 AS place FROM embeddings WHERE vec_id % 3 = 0")
def staged_rows(spark, d):
    """The chosen rows in candidate order, as they are copied to a place of their own."""
    some = segments(spark, d).filter("row_id % 3 = 0").select("row_id", V.hash_order(SEED + 1, "row_id").alias("h"))
    return numbered(some, "place", "h", "row_id").select("row_id", "place")


@query(
    f"""WITH w AS (SELECT doc_id, {_WORDS} AS ws FROM documents), e AS (SELECT doc_id, ws, unnest(range(0, CASE WHEN len(ws) >= 10 THEN least(3, len(ws) - 9) ELSE 0 END)) AS win FROM w),
 c AS (SELECT doc_id, win, len(array_to_string(ws[win + 1 : win + 10], ''))::double AS a, len(ws[win + 1])::double AS b FROM e) SELECT doc_id AS track_id, win::int AS win, round(a / sqrt(a * a + b * b), 6) AS x, round(b / sqrt(a * a + b * b), 6) AS y FROM c"""
)
def embedded_windows(spark, d):
    """The first three windows of every document through a model, which stands in for a real one: lengths of all words and of the
    first."""
    import numpy as np

    def model(windows: list) -> np.ndarray:
        x = np.array([[sum(map(len, w)), len(w[0])] for w in windows], float)
        return x / np.sqrt((x * x).sum(1))[:, None]

    docs = words(table(spark, d, "documents")).select("doc_id", "words")
    count = F.when(F.size("words") >= 10, F.least(F.lit(3), F.size("words") - 9)).otherwise(0)
    each = docs.select("doc_id", "words", F.explode(F.sequence(F.lit(1), count)).alias("at")).filter("at >= 1 and size(words) >= 10")
    windows = each.select(F.col("doc_id").alias("track_id"), (F.col("at") - 1).alias("window"), F.slice("words", F.col("at"), 10).alias("samples"))
    found = embedded_tracks(windows, model, 10)
    return found.select("track_id", F.col("window").alias("win"), F.round(F.col("vector")[0], 6).alias("x"), F.round(F.col("vector")[1], 6).alias("y"))


@query("WITH r AS (SELECT 'documents' AS name, count(*) AS n, count(DISTINCT doc_id) AS ids FROM documents UNION ALL SELECT 'embeddings', count(*), count(DISTINCT vec_id) FROM embeddings UNION ALL SELECT 'labels', count(*), count(DISTINCT doc_id) FROM labels) SELECT to_json({'name': name, 'n': n, 'state': CASE WHEN n = ids THEN 'OK' ELSE 'FAIL' END})::varchar AS line FROM r")
def integrity_json(spark, d):
    """The report as lines of JSON."""
    return integrity_report(spark, d).select(F.to_json(F.struct("name", "n", "state")).alias("line"))


# ---- identity and integrity

_RULES = """WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings), n AS (SELECT vec_id, sqrt(list_dot_product(v, v)) AS n FROM e)"""


@query(_RULES + " SELECT 'rows' AS what, count(*) AS n FROM n UNION ALL SELECT 'not of unit length', count(*) FILTER (abs(n - 1) > 1e-4) FROM n UNION ALL SELECT 'not finite', count(*) FILTER (NOT isfinite(n)) FROM n UNION ALL SELECT 'repeated ids', count(*) - count(DISTINCT vec_id) FROM n")
def collection_checks(spark, d):
    """What an index refuses: vectors that are not finite or not of unit length, and ids that repeat."""
    n = segments(spark, d).select("row_id", V.norm("vector").alias("n"))
    finite = ~F.isnan("n") & (F.abs("n") < float("inf"))
    one = n.agg(F.count("*").alias("a"), F.count_if(F.abs(F.col("n") - 1) > 1e-4).alias("b"), F.count_if(~finite).alias("c"), (F.count("*") - F.count_distinct("row_id")).alias("e"))
    pairs = F.array(*[F.struct(F.lit(t).alias("what"), F.col(c).alias("n")) for t, c in (("rows", "a"), ("not of unit length", "b"), ("not finite", "c"), ("repeated ids", "e"))])
    return one.select(F.explode(pairs).alias("x")).select("x.what", "x.n")


@query(f"WITH {SEG}, p AS (SELECT round(avg(list_dot_product(a.v, b.v)), 7) AS s FROM seg a, seg b WHERE a.row_id <> b.row_id AND a.row_id % 100 = 0 AND b.row_id % 100 = 0 AND a.row_id < 400 AND b.row_id < 400) SELECT s AS mean, s > 0.99 AS collapsed FROM p")
def collapse_check(spark, d):
    """Whether four probes look alike, as they do when a model has broken."""
    return collapse(queries_of(segments(spark, d)).filter("row_id < 400"))


def collapse(probes: DataFrame) -> DataFrame:
    """mean: of the cosines of all pairs of probes, from the length of their sum; collapsed: beyond 0.99 or not a number."""
    n = probes.agg(F.count("*").alias("n"), F.sum(V.dot("vector", "vector")).alias("own"))
    total = probes.select(F.posexplode("vector").alias("pos", "x")).groupBy("pos").agg(F.sum("x").alias("x")).agg(F.sum(F.col("x") * F.col("x")).alias("all"))
    mean = (F.col("all") - F.col("own")) / (F.col("n") * (F.col("n") - 1))
    return n.join(total).select(F.round(mean, 7).alias("mean"), (F.isnan(mean) | (mean > 0.99)).alias("collapsed"))


_IDENTITY = "(SELECT sum(('0x' || substr(md5(vec_id || ':' || label), 1, 15))::ubigint::hugeint)::varchar FROM embeddings)"


@query(f"SELECT (SELECT count(*) FROM embeddings) AS n, {_IDENTITY} AS rows_digest, (SELECT sum(('0x' || substr(md5(doc_id || ':' || source), 1, 15))::ubigint::hugeint)::varchar FROM documents) AS catalog_digest, 'demo' AS model")
def source_identity(spark, d):
    return identity(spark, d)


def identity(spark: SparkSession, d: str, model: str = "demo") -> DataFrame:
    """What results are computed from: digests of rows and catalog, and the model. A catalog with pending files raises."""
    sixty = lambda c: F.sum(F.conv(F.substring(F.md5(c), 1, 15), 16, 10).cast("decimal(38,0)")).cast("string")
    pair = lambda a, b: F.concat(F.col(a).cast("string"), F.lit(":"), F.col(b).cast("string"))
    rows = table(spark, d, "embeddings").agg(F.count("*").alias("n"), sixty(pair("vec_id", "label")).alias("rows_digest"))
    docs = table(spark, d, "documents").withColumn("status", F.lit("done"))
    catalog = docs.agg(sixty(pair("doc_id", "source")).alias("catalog_digest"), F.count_if(F.col("status") == "pending").alias("pending"))
    catalog = required(catalog, F.col("pending") == 0, "the catalog has pending files").drop("pending")
    return rows.join(catalog).withColumn("model", F.lit(model))


def held_out(spark: SparkSession, d: str, path: str, n: int = 8, model: str = "demo") -> DataFrame:
    """Exact neighbours of n queries drawn by hash among all other rows, kept below path with what they were computed from. A
    later call takes them from there; other rows, another model or another n raise."""
    about = {k: str(v) for k, v in identity(spark, d, model).first().asDict().items()} | {"queries": str(n), "seed": str(SEED)}
    if not store.complete(spark, path):
        segs = segments(spark, d)
        asked = segs.orderBy(V.hash_order(SEED, "row_id"), "row_id").limit(n)
        rest = segs.join(F.broadcast(asked.select("row_id")), "row_id", "left_anti")  # n rows
        found = exact.topk(asked, rest, K, "row", "none").select("query_row", "rank", "row_id", "score")
        store.commit(found, path, about)
    return store.load(spark, path, expect=about)


@query(f"WITH {SEG}, a AS (SELECT * FROM seg ORDER BY md5('{SEED}:' || row_id), row_id LIMIT 8), c AS (SELECT * FROM seg WHERE row_id NOT IN (SELECT row_id FROM a)), s AS (SELECT a.row_id AS query_row, c.row_id, round(list_dot_product(a.v, c.v), 9) AS sim FROM a, c), r AS (SELECT *, row_number() OVER (PARTITION BY query_row ORDER BY sim DESC, row_id) AS rank FROM s) SELECT query_row, rank::int AS rank, row_id, sim AS score FROM r WHERE rank <= 10")
def held_out_cached(spark, d):
    """The held-out oracle as a second reader gets it."""
    path = store.fresh_path(spark, "held-out")
    held_out(spark, d, path)
    return held_out(spark, d, path)


# ---- measures


@query(
    f"""WITH {TRACKS}, size AS (SELECT track_id % 10 AS artist, count(DISTINCT track_id) AS n FROM seg GROUP BY 1), kept AS (SELECT artist, n FROM size WHERE n >= 5 ORDER BY n DESC, artist LIMIT 8),
 h AS (SELECT query_track % 10 AS artist, avg((query_track % 10 = track_id % 10)::int::double) AS share FROM top GROUP BY 1),
 l AS (SELECT artist, round(share / (n::double / (SELECT sum(n) FROM size)), 6) AS lift FROM kept JOIN h USING (artist)) SELECT count(*) AS artists, round(quantile_cont(lift, 0.5), 6) AS median_lift FROM l"""
)
def artist_median_lift(spark, d):
    """Over the eight largest artists of five tracks or more that have queries."""
    tracks = segments(spark, d).select("track_id").distinct()
    size = tracks.groupBy((F.col("track_id") % 10).alias("artist")).agg(F.count("*").alias("n"))
    kept = size.filter("n >= 5").orderBy(F.desc("n"), "artist").limit(8)
    found = hits(spark, d).select((F.expr(f"query_row div {WINDOWS}") % 10).alias("artist"), (F.col("track_id") % 10).alias("other"))
    share = found.groupBy("artist").agg(F.avg((F.col("artist") == F.col("other")).cast("double")).alias("share"))
    lift = share.join(kept, "artist").join(size.agg(F.sum("n").alias("total"))).select(F.round(F.col("share") / (F.col("n").cast("double") / F.col("total")), 6).alias("lift"))
    return lift.agg(F.count("*").alias("artists"), F.round(F.percentile("lift", 0.5), 6).alias("median_lift"))


@query(
    """WITH t AS (SELECT l_discount, l_returnflag = 'R' AS won, row_number() OVER (PARTITION BY l_partkey, l_suppkey ORDER BY l_orderkey, l_linenumber) > 1 AS replay FROM lineitem)
 SELECT replay, CASE WHEN l_discount >= 0.00 AND l_discount < 0.03 THEN 'close' WHEN l_discount >= 0.03 AND l_discount < 0.06 THEN 'middle' ELSE 'far' END AS band, count(*) AS trials, count(*) FILTER (won) AS correct FROM t GROUP BY 1, 2"""
)
def replay_split(spark, d):
    """Trials of a pair (part and supplier) that was heard before are counted apart from first ones."""
    first = Window.partitionBy("l_partkey", "l_suppkey").orderBy("l_orderkey", "l_linenumber")
    x = F.col("l_discount")
    band = F.when((x >= 0.0) & (x < 0.03), "close").when((x >= 0.03) & (x < 0.06), "middle").otherwise("far")
    t = table(spark, d, "lineitem").withColumn("replay", F.row_number().over(first) > 1)
    return t.groupBy("replay", band.alias("band")).agg(F.count("*").alias("trials"), F.count_if(F.col("l_returnflag") == "R").alias("correct"))


@query(
    f"""WITH {_COUNTS}, pool AS (SELECT doc_id, row_number() OVER (ORDER BY md5('{SEED}:' || doc_id), doc_id) - 1 AS i FROM c WHERE n_windows >= 15), drawn AS (SELECT doc_id, i % 4 AS band FROM pool WHERE i < {_N // 2})
 SELECT doc_id, band, row_number() OVER (ORDER BY md5('{SEED + 2}:' || doc_id), doc_id) - 1 AS trial FROM drawn"""
)
def band_schedule(spark, d):
    """Trials of a listening test: a drawn pool takes turns in the four bands and is then shuffled."""
    pool = cataloged(spark, d).filter("n_windows >= 15").select("doc_id", V.hash_order(SEED, "doc_id").alias("h"))
    drawn = pool.orderBy("h", "doc_id").limit(_N // 2)
    turns = drawn.withColumn("band", (F.row_number().over(Window.orderBy("h", "doc_id")) - 1) % 4)  # _N // 2 rows
    shuffled = Window.orderBy(V.hash_order(SEED + 2, "doc_id"), "doc_id")
    return turns.select("doc_id", F.col("band").cast("long").alias("band"), (F.row_number().over(shuffled) - 1).cast("long").alias("trial"))


@query("SELECT event_id, 'q=' || CASE WHEN event_type = 'click' THEN 'a+b%2Ac' ELSE event_type || '~1%2F' END AS query FROM events")
def search_links(spark, d):
    """Form encoding of search terms."""
    term = F.when(F.col("event_type") == "click", F.lit("a b*c")).otherwise(F.concat("event_type", F.lit("~1/")))
    return table(spark, d, "events").select("event_id", F.concat(F.lit("q="), V.quoted(term)).alias("query"))


