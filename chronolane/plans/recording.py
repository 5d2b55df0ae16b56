"""Queries over the recording that the driver's tables stand for."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronolane.functions import geometry, text
from chronolane.operators import asof, colour, frames, select, spatial, stats
from chronolane.operators import keyframes as buckets
from chronolane.plans.shared import shared

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as messages: one topic for each event type, nanosecond stamps, seq as the order of arrival."""
    return spark.read.parquet(f"{sf_dir}/events.parquet").select(
        F.concat(F.lit("/"), "event_type").alias("topic"),
        (F.unix_micros(F.col("ts").cast("timestamp")) * 1000).alias("timestamp_ns"),
        F.col("event_id").alias("seq"),
        F.col("user_id").alias("publisher"),
        F.col("value"),
        F.col("props").alias("payload"),
    )


#: What the queries' SQL has in common.
M = "m AS (SELECT '/' || event_type AS topic, epoch_us(ts) * 1000 AS timestamp_ns, event_id AS seq, user_id AS publisher, value, props AS payload FROM events)"
C = f"{M}, c AS (SELECT *, CASE WHEN seq % 7 = 0 THEN 0 ELSE timestamp_ns - (seq % 5) * 1000000 END AS header_ns FROM m)"
P = "p AS (SELECT vec_id AS idx, embedding[1]::DOUBLE * 10 AS x, embedding[2]::DOUBLE * 10 AS y, embedding[3]::DOUBLE * 10 AS z, embedding[4]::DOUBLE AS intensity, label FROM embeddings)"


def stamped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages with a capture clock that some lack."""
    m = messages(spark, sf_dir)
    return m.withColumn("header_ns", F.when(F.col("seq") % 7 == 0, F.lit(0)).otherwise(F.col("timestamp_ns") - (F.col("seq") % 5) * 1_000_000))


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first numbers of each embedding as a point with an intensity."""
    e = F.col("embedding")
    at = lambda k: e[k].cast("double")
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("idx"), (at(0) * 10).alias("x"), (at(1) * 10).alias("y"), (at(2) * 10).alias("z"), at(3).alias("intensity"), "label")


def topic(m: DataFrame, name: str) -> DataFrame:
    return m.where(F.col("topic") == name)


# ---- selection ----


@query(f"WITH {M}, s AS (SELECT topic, count(*) AS n_messages FROM m GROUP BY topic), e AS (SELECT (max(timestamp_ns) - min(timestamp_ns)) / 1e9 AS d FROM m) SELECT topic, n_messages, round(CASE WHEN n_messages > 1 AND d > 0 THEN (n_messages - 1) / d ELSE 0 END, 9) AS hz FROM s, e")
def topic_stats(spark, sf_dir):
    return stats.topic_stats(messages(spark, sf_dir)).withColumn("hz", F.round("hz", 9)).orderBy("topic")


@query(f"WITH {M} SELECT * FROM m WHERE topic LIKE '/%e%' AND topic IN ('/view', '/error', '/purchase')")
def topic_keep(spark, sf_dir):
    return select.keep(messages(spark, sf_dir), ["/v*w", "/error", "/pur*"])


@query(f"WITH {M} SELECT * FROM m WHERE topic NOT IN ('/view', '/click')")
def topic_drop(spark, sf_dir):
    return select.drop(messages(spark, sf_dir), ["/view", "*cli*"])


@query(f"WITH {M} SELECT selector FROM (VALUES ('/nothing*'), ('/click'), ('/clicks'), ('*')) AS v(selector) WHERE NOT EXISTS (SELECT 1 FROM (SELECT DISTINCT topic FROM m) WHERE topic GLOB selector)")
def topic_unmatched(spark, sf_dir):
    return select.unmatched(messages(spark, sf_dir), ["/nothing*", "/click", "/clicks", "*"])


@query(f"WITH {M} SELECT CASE topic WHEN '/view' THEN '/seen' ELSE topic END AS topic, timestamp_ns, seq FROM m")
def topic_rename(spark, sf_dir):
    m = messages(spark, sf_dir)
    return select.rename(m, m, {"/view": "/seen"}).select("topic", "timestamp_ns", "seq")


@query(f"WITH {M}, e AS (SELECT min(timestamp_ns) AS a FROM m) SELECT topic, timestamp_ns, seq FROM m, e WHERE timestamp_ns >= a + 86400000000000 AND timestamp_ns < a + 864000000000000")
def trim_window(spark, sf_dir):
    return select.trim(messages(spark, sf_dir), start="86400s", end="864000s").select("topic", "timestamp_ns", "seq")


@query(f"WITH {M}, e AS (SELECT min(timestamp_ns) AS a FROM m) SELECT topic, timestamp_ns, seq FROM m, e WHERE timestamp_ns >= a + 86400000000000 AND timestamp_ns < a + 86400000000000 + 500000500000000")
def trim_duration(spark, sf_dir):
    return select.trim(messages(spark, sf_dir), start="86400s", duration="500000500ms").select("topic", "timestamp_ns", "seq")


@query(f"WITH {M}, e AS (SELECT min(timestamp_ns) AS a, max(timestamp_ns) AS b FROM m) SELECT topic, timestamp_ns, seq FROM m, e WHERE timestamp_ns >= a + 864000000000000 AND timestamp_ns < b - 864000000000000")
def trim_both(spark, sf_dir):
    return select.trim(messages(spark, sf_dir), both="864000s").select("topic", "timestamp_ns", "seq")


@query(f"WITH {M}, r AS (SELECT timestamp_ns, row_number() OVER (ORDER BY timestamp_ns) - 1 AS k FROM m) SELECT topic, timestamp_ns, seq FROM m WHERE timestamp_ns >= (SELECT timestamp_ns FROM r WHERE k = 100) AND timestamp_ns < (SELECT timestamp_ns FROM r WHERE k = 700)")
def trim_messages(spark, sf_dir):
    return select.trim(messages(spark, sf_dir), start="100msg", end="700msg").select("topic", "timestamp_ns", "seq")


@query(f"WITH {C}, k AS (SELECT *, CASE WHEN header_ns > 0 THEN header_ns ELSE timestamp_ns END AS t FROM c), e AS (SELECT min(t) AS a FROM k) SELECT topic, timestamp_ns, seq FROM k, e WHERE t >= a + 86400000000000 AND t < a + 172800000000000")
def trim_header_clock(spark, sf_dir):
    return select.trim(stamped(spark, sf_dir), start="86400s", end="172800s", clock=select.header_clock()).select("topic", "timestamp_ns", "seq")


@query(f"WITH {M}, s AS (SELECT min(timestamp_ns) AS a, max(timestamp_ns) AS b FROM m WHERE topic IN ('/view', '/signup', '/error') GROUP BY topic), w AS (SELECT max(a) AS a, min(b) AS b FROM s) SELECT topic, timestamp_ns, seq FROM m, w WHERE timestamp_ns BETWEEN a AND b")
def trim_align(spark, sf_dir):
    return select.align(messages(spark, sf_dir), ["/view", "/si*", "/error"]).select("topic", "timestamp_ns", "seq")


@query(f"WITH {M} SELECT topic, seq, row_number() OVER (PARTITION BY topic ORDER BY seq) - 1 AS topic_index FROM m")
def arrival_index(spark, sf_dir):
    return select.arrival_index(messages(spark, sf_dir)).select("topic", "seq", F.col("topic_index").cast("long").alias("topic_index"))


@query(f"WITH {M}, k AS (SELECT seq // 100 AS chunk, min(timestamp_ns) AS a, max(timestamp_ns) AS b, bool_and(topic = '/view') AS gone, bool_or(topic IN ('/view', '/click') AND seq % 1000 < 150) AS touched, bool_and(seq % 997 <> 0) AS trusted FROM (SELECT * FROM m) GROUP BY 1), w AS (SELECT min(timestamp_ns) + 86400000000000 AS s, min(timestamp_ns) + 1728000000000000 AS e FROM m) SELECT chunk, CASE WHEN trusted AND (b < s OR a >= e OR gone) THEN 'drop' WHEN trusted AND a >= s AND b < e AND NOT touched THEN 'copy' ELSE 're-encode' END AS action FROM k, w")
def chunk_plan(spark, sf_dir):
    m = messages(spark, sf_dir).withColumn("chunk", F.floor(F.col("seq") / 100))
    lo, _ = select.extent(m, F.col("timestamp_ns"))
    gone, seldom = F.col("topic") == "/view", F.col("seq") % 1000 < 150
    # the renames touch some stretches only
    plan = select.chunk_plan(m, lo + 86400 * 10**9, lo + 1728000 * 10**9, F.lit(False), (gone | (F.col("topic") == "/click")) & seldom, F.col("seq") % 997 != 0)
    return plan


@query(
    f"WITH {M}, k AS (SELECT topic, count(*) AS n, 'Event' AS kind FROM m GROUP BY 1 UNION ALL SELECT '/idle', 0, 'Event'), w AS (SELECT * FROM (VALUES ('/click', 'Event', true), ('/view', 'Event', false), ('/fresh', 'Event', false), ('/error', 'Other', false), ('/idle', 'Event', false)) AS v(topic, wanted, again)) "
    "SELECT topic, CASE WHEN kind IS NULL THEN 'new' WHEN kind <> wanted THEN 'type mismatch' WHEN n = 0 THEN 'keep' WHEN again THEN 'suppress' ELSE 'conflict' END AS action FROM w LEFT JOIN k USING (topic)"
)
def write_plan(spark, sf_dir):
    known = messages(spark, sf_dir).groupBy("topic").agg(F.count("*").alias("n_messages")).withColumn("type", F.lit("Event"))
    known = known.unionByName(spark.createDataFrame([("/idle", 0, "Event")], "topic string, n_messages long, type string"))
    wanted = spark.createDataFrame([("/click", "Event", True), ("/view", "Event", False), ("/fresh", "Event", False), ("/error", "Other", False), ("/idle", "Event", False)], "topic string, type string, replace boolean")
    return select.write_plan(known, wanted)


# ---- statistics ----


@query(f"WITH {M}, s AS (SELECT seq % 4 AS shard, count(*) AS n, min(timestamp_ns) AS a, max(timestamp_ns) AS b, min(seq) < 3 AS complete FROM m GROUP BY 1) SELECT sum(n)::BIGINT AS n_messages, min(a) AS start_ns, max(b) AS end_ns, bool_and(complete) AS complete FROM s")
def shard_merge(spark, sf_dir):
    s = messages(spark, sf_dir).groupBy((F.col("seq") % 4).alias("shard")).agg(F.count("*").alias("n"), F.min("timestamp_ns").alias("start_ns"), F.max("timestamp_ns").alias("end_ns"), (F.min("seq") < 3).alias("complete"))
    return stats.merged_extent(s)


@query(f"WITH {M}, d AS (SELECT topic, timestamp_ns - lag(timestamp_ns) OVER (PARTITION BY topic ORDER BY seq) AS d FROM m), l AS (SELECT topic, list_sort(list(d) FILTER (d IS NOT NULL)) AS l FROM d GROUP BY topic) SELECT topic, l[len(l) // 2 + 1] AS period_ns FROM l")
def median_period(spark, sf_dir):
    return stats.median_period(messages(spark, sf_dir))


@query(f"WITH {M}, d AS (SELECT topic, timestamp_ns - lag(timestamp_ns) OVER (PARTITION BY topic ORDER BY seq) AS d FROM m), l AS (SELECT topic, list_sort(list(d) FILTER (d IS NOT NULL)) AS l FROM d GROUP BY topic) SELECT topic, CASE WHEN l[len(l) // 2 + 1] > 0 THEN l[len(l) // 2 + 1] // 2 ELSE 50000000 END AS tolerance_ns FROM l")
def default_tolerance(spark, sf_dir):
    return stats.default_tolerance(messages(spark, sf_dir))


@query(f"WITH {M} SELECT topic, arg_min(timestamp_ns, seq) AS first_ns, arg_max(timestamp_ns, seq) AS last_ns, count(*) AS n_messages FROM m GROUP BY topic")
def topic_span(spark, sf_dir):
    return stats.spans(messages(spark, sf_dir))


@query(f"WITH {M}, s AS (SELECT topic, count(*) AS n, (max(timestamp_ns) - min(timestamp_ns)) / 1e9 * 0.0001 AS d FROM m GROUP BY topic), f AS (SELECT topic, floor(least(greatest((n - 1) / d, 1.0), 240.0) * 1000 + 0.5)::BIGINT AS milli FROM s) SELECT topic, milli // gcd(milli, 1000) AS num, 1000 // gcd(milli, 1000) AS den FROM f")
def frame_rate(spark, sf_dir):
    m = messages(spark, sf_dir)
    lo, _ = select.extent(m, F.col("timestamp_ns"))
    return stats.frame_rate(m.withColumn("timestamp_ns", ((F.col("timestamp_ns") - lo) / 10000).cast("long")))


@query(f"WITH {C}, k AS (SELECT topic, seq, CASE WHEN seq % 500 = 3 THEN timestamp_ns - 864000000000000 ELSE timestamp_ns END AS t FROM c), b AS (SELECT topic, lag(t) OVER (PARTITION BY topic ORDER BY seq) > t AS b FROM k) SELECT topic, coalesce(bool_or(b), false) AS nonmonotonic FROM b GROUP BY topic")
def nonmonotonic(spark, sf_dir):
    return stats.backwards(messages(spark, sf_dir), F.when(F.col("seq") % 500 == 3, F.col("timestamp_ns") - 864_000 * 10**9).otherwise(F.col("timestamp_ns")))


@query(f"WITH {P} SELECT 'x' AS property, min(x) AS low, max(x) AS high FROM p UNION ALL SELECT 'y', min(y), max(y) FROM p UNION ALL SELECT 'z', min(z), max(z) FROM p UNION ALL SELECT 'intensity', min(intensity), max(intensity) FROM p")
def property_ranges(spark, sf_dir):
    return stats.ranges(points(spark, sf_dir), ["x", "y", "z", "intensity"])


@query(f"WITH {M} SELECT count_if(topic NOT IN ('/view', '/click')) AS copied, count_if(topic = '/view') AS dropped, count_if(topic = '/click') AS renamed FROM m")
def rewrite_counters(spark, sf_dir):
    t = F.col("topic")
    return stats.counters(messages(spark, sf_dir), {"copied": ~t.isin("/view", "/click"), "dropped": t == "/view", "renamed": t == "/click"})


@query(f"WITH {P}, d AS (SELECT list_sort(list(abs(x))) AS l FROM p) SELECT round(least(greatest(l[len(l) // 2 + 1] * 4, 0.05), 5.0), 6) AS radius FROM d")
def spacing_radius(spark, sf_dir):
    return stats.spacing_radius(points(spark, sf_dir).withColumn("s", F.abs("x")), "s").withColumn("radius", F.round("radius", 6))


@query(f"WITH {P}, s AS (SELECT avg(x) AS mx, avg(y) AS my, avg(z) AS mz, avg(0.6*x - 0.8*y + 3) AS nx, avg(0.8*x + 0.6*y - 1) AS ny, avg(z + 2) AS nz, covar_pop(x, 0.6*x - 0.8*y + 3) AS xx, covar_pop(y, 0.8*x + 0.6*y - 1) AS yy, covar_pop(x, 0.8*x + 0.6*y - 1) AS xy, covar_pop(y, 0.6*x - 0.8*y + 3) AS yx FROM p), t AS (SELECT *, atan2(xy - yx, xx + yy) AS th FROM s) SELECT round(th, 6) AS theta, round(nx - cos(th) * mx + sin(th) * my, 6) AS dx, round(ny - sin(th) * mx - cos(th) * my, 6) AS dy, round(nz - mz, 6) AS dz FROM t")
def planar_fit(spark, sf_dir):
    p = points(spark, sf_dir).select(F.col("x").alias("ax"), F.col("y").alias("ay"), F.col("z").alias("az"), F.expr("0.6D*x - 0.8D*y + 3").alias("bx"), F.expr("0.8D*x + 0.6D*y - 1").alias("by"), F.expr("z + 2").alias("bz"))
    return stats.planar_fit(p).select(*[F.round(c, 6).alias(c) for c in ("theta", "dx", "dy", "dz")])


@query(f"WITH {M}, r AS (SELECT topic, seq, row_number() OVER (PARTITION BY topic ORDER BY seq) - 1 AS r, count(*) OVER (PARTITION BY topic) AS n FROM m), k AS (SELECT DISTINCT topic, n, floor(i * ((n - 1) / 49.0) + 0.5)::BIGINT AS r FROM (SELECT DISTINCT topic, n FROM r), range(50) t(i)) SELECT r.topic, r.seq FROM r JOIN k ON r.topic = k.topic AND r.r = k.r")
def even_subsample(spark, sf_dir):
    return stats.evenly(messages(spark, sf_dir), ["topic"], "seq", 50).select("topic", "seq")


@query(f"WITH {M} SELECT topic, publisher AS track, count(*) AS n, count(DISTINCT value::BIGINT % 5) AS submaps FROM m GROUP BY 1, 2 HAVING count(DISTINCT value::BIGINT % 5) >= 2")
def track_filter(spark, sf_dir):
    m = messages(spark, sf_dir).withColumn("submap", F.rint("value").cast("long") % 5)
    return m.groupBy("topic", F.col("publisher").alias("track")).agg(F.count("*").alias("n"), F.countDistinct("submap").alias("submaps")).where("submaps >= 2")


@query(f"WITH {M} SELECT topic, time_bucket(INTERVAL 1 DAY, make_timestamp(timestamp_ns // 1000)) AS day, count(*) AS n, sum(value)::DECIMAL(18,2)::DOUBLE AS total FROM m GROUP BY 1, 2")
def daily_rollup(spark, sf_dir):
    m = messages(spark, sf_dir)
    day = F.date_trunc("day", F.timestamp_micros(F.expr("timestamp_ns div 1000"))).cast("timestamp_ntz")
    return m.groupBy("topic", day.alias("day")).agg(F.count("*").alias("n"), F.sum("value").cast("decimal(18,2)").cast("double").alias("total"))


# ---- joins in time ----

_BACK = "last_value({v} IGNORE NULLS) OVER (ORDER BY timestamp_ns, q, seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
_AHEAD = "last_value({v} IGNORE NULLS) OVER (ORDER BY timestamp_ns DESC, q, seq DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"


def _both(left: str, right: str, value: str = "value") -> str:
    """SQL for the rows of one topic with what the other had before and after."""
    return (
        f"u AS (SELECT timestamp_ns, seq, 1 AS q, NULL::BIGINT AS rt, NULL::BIGINT AS rs, NULL::DOUBLE AS rv FROM m WHERE topic = '{left}' UNION ALL SELECT timestamp_ns, seq, 0, timestamp_ns, seq, {value} FROM m WHERE topic = '{right}'), "
        f"n AS (SELECT *, {_BACK.format(v='rt')} AS pt, {_BACK.format(v='rs')} AS ps, {_BACK.format(v='rv')} AS pv, {_AHEAD.format(v='rt')} AS nt, {_AHEAD.format(v='rs')} AS ns, {_AHEAD.format(v='rv')} AS nv FROM u), "
        "b AS (SELECT * FROM n WHERE q = 1)"
    )


_NEAR = "CASE WHEN nt IS NULL THEN {p} WHEN pt IS NULL THEN {n} WHEN timestamp_ns - pt <= nt - timestamp_ns THEN {p} ELSE {n} END"


@query(f"WITH {M}, {_both('/click', '/view')} SELECT seq, {_NEAR.format(p='ps', n='ns')} AS match_seq FROM b")
def nearest(spark, sf_dir):
    m = messages(spark, sf_dir)
    return asof.nearest(topic(m, "/click"), topic(m, "/view"), ["value"]).select("seq", F.col("match.seq").alias("match_seq"))


_TOL = 300 * 10**9


@query(f"WITH {M}, {_both('/click', '/view')}, k AS (SELECT seq, timestamp_ns, {_NEAR.format(p='ps', n='ns')} AS s, {_NEAR.format(p='pt', n='nt')} AS t FROM b) SELECT seq, CASE WHEN abs(t - timestamp_ns) <= {_TOL} THEN s END AS match_seq FROM k")
def nearest_within(spark, sf_dir):
    m = messages(spark, sf_dir)
    return asof.within(topic(m, "/click"), topic(m, "/view"), ["value"], _TOL).select("seq", F.col("match.seq").alias("match_seq"))


@query(f"WITH {M}, {_both('/click', '/view')} SELECT seq, round(CASE WHEN pt IS NULL THEN nv WHEN nt IS NULL OR pt = timestamp_ns OR pt = nt THEN pv ELSE pv + (nv - pv) * ((timestamp_ns - pt) / (nt - pt)) END, 6) AS value FROM b")
def interpolate(spark, sf_dir):
    m = messages(spark, sf_dir)
    return asof.interpolated(topic(m, "/click").drop("value"), topic(m, "/view"), ["value"]).select("seq", F.round("value", 6).alias("value"))


@query(f"WITH {M}, {_both('/click', '/view')} SELECT seq, round(CASE WHEN pt IS NULL OR nt IS NULL THEN NULL WHEN pt = timestamp_ns OR pt = nt THEN pv ELSE pv + (nv - pv) * ((timestamp_ns - pt) / (nt - pt)) END, 6) AS value FROM b")
def interpolate_strict(spark, sf_dir):
    m = messages(spark, sf_dir)
    return asof.interpolated(topic(m, "/click").drop("value"), topic(m, "/view"), ["value"], extrapolate=False).select("seq", F.round("value", 6).alias("value"))


@query(f"WITH {M}, s AS (SELECT timestamp_ns AS a, timestamp_ns + 600000000000 AS e, seq AS span FROM m WHERE topic = '/signup') SELECT m.seq, CASE WHEN m.timestamp_ns <= s.e THEN s.span END AS span FROM m ASOF LEFT JOIN s ON m.timestamp_ns >= s.a WHERE m.topic = '/error'")
def interval_assign(spark, sf_dir):
    m = messages(spark, sf_dir)
    spans = topic(m, "/signup").select(F.col("timestamp_ns").alias("start_ns"), (F.col("timestamp_ns") + 600 * 10**9).alias("end_ns"), F.col("seq").alias("span"))
    return asof.interval(topic(m, "/error"), spans, "span").select("seq", "span")


@query(f"WITH {M}, i AS (SELECT seq, timestamp_ns + 1800000000000 AS t FROM m WHERE topic = '/signup'), c AS (SELECT seq, timestamp_ns FROM m WHERE topic <> '/signup') SELECT seq, 1 AS copied, seq AS place FROM c UNION ALL SELECT i.seq, 0, coalesce((SELECT min(c.seq) FROM c WHERE c.timestamp_ns >= i.t), 4611686018427387904) FROM i")
def inject_merge(spark, sf_dir):
    m = messages(spark, sf_dir).select("topic", "timestamp_ns", "seq")
    added = topic(m, "/signup").withColumn("timestamp_ns", F.col("timestamp_ns") + 1800 * 10**9)
    return asof.injected(m.where("topic <> '/signup'"), added).select("seq", "copied", "place")


@query(f"WITH {M} SELECT a.seq, (SELECT min(b.seq) FROM m b WHERE b.topic = a.topic AND b.timestamp_ns >= a.timestamp_ns + 3600000000000) AS forward_seq, (SELECT max(b.seq) FROM m b WHERE b.topic = a.topic AND b.timestamp_ns <= a.timestamp_ns - 3600000000000) AS backward_seq FROM m a")
def cursor_step(spark, sf_dir):
    m = messages(spark, sf_dir).select("topic", "timestamp_ns", "seq")
    hop = lambda ns: m.select("topic", (F.col("timestamp_ns") + ns).alias("timestamp_ns"), F.col("seq").alias("from"))
    ahead = asof.neighbours(hop(3600 * 10**9), m, [], ["topic"]).select(F.col("from").alias("seq"), F.col("next.seq").alias("forward_seq"))
    back = asof.neighbours(hop(-3600 * 10**9), m, [], ["topic"]).select(F.col("from").alias("seq"), F.col("prev.seq").alias("backward_seq"))
    return ahead.join(back, "seq")


# ---- frames ----

_E = "e AS (SELECT 'root' AS parent, 'r' || r_regionkey AS child FROM region UNION ALL SELECT 'r' || n_regionkey, 'n' || n_nationkey FROM nation UNION ALL SELECT 'n' || s_nationkey, 's' || s_suppkey FROM supplier)"


def frame_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions, nations and suppliers as a tree of frames."""
    t = lambda n: spark.read.parquet(f"{sf_dir}/{n}.parquet")
    name = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    out = t("region").select(F.lit("root").alias("parent"), name("r", "r_regionkey").alias("child"))
    out = out.union(t("nation").select(name("r", "n_regionkey"), name("n", "n_nationkey")))
    return out.union(t("supplier").select(name("n", "s_nationkey"), name("s", "s_suppkey")))


@query(f"WITH RECURSIVE {_E}, c AS (SELECT 'root' AS root, 'root' AS descendant, 0 AS depth, 'root' AS path UNION ALL SELECT root, e.child, depth + 1, path || '/' || e.child FROM c JOIN e ON e.parent = c.descendant) SELECT * FROM c")
def tree_paths(spark, sf_dir):
    shared(spark)
    return frames.closure(frame_edges(spark, sf_dir))


@query(
    f"WITH RECURSIVE {_E}, x AS (SELECT * FROM e UNION SELECT * FROM (VALUES ('n3', 'n3'), ('elsewhere', 'n4'), ('c1', 'c2'), ('c2', 'c3'), ('c3', 'c1'), ('o1', 'o2'), ('o2', 'o1')) AS v(parent, child)), "
    "up AS (SELECT DISTINCT parent AS frame FROM x WHERE parent NOT IN (SELECT child FROM x) UNION SELECT x.child FROM up JOIN x ON x.parent = up.frame) "
    "SELECT 'self edge' AS fault, child AS frame FROM x WHERE parent = child UNION SELECT 'opposite edges', a.child FROM x a JOIN x b ON a.parent = b.child AND a.child = b.parent WHERE a.parent <> a.child "
    "UNION SELECT 'several parents', child FROM x GROUP BY child HAVING count(*) > 1 UNION SELECT 'cycle', child FROM x WHERE child NOT IN (SELECT frame FROM up)"
)
def forest_faults(spark, sf_dir):
    shared(spark)
    extra = spark.createDataFrame([("n3", "n3"), ("elsewhere", "n4"), ("c1", "c2"), ("c2", "c3"), ("c3", "c1"), ("o1", "o2"), ("o2", "o1")], "parent string, child string")
    return frames.forest_faults(frame_edges(spark, sf_dir).unionByName(extra))


@query(f"WITH {M} SELECT topic, arg_min(seq, seq) AS seq, arg_min(value, seq) AS value FROM m GROUP BY topic")
def first_per_topic(spark, sf_dir):
    return frames.first_per_topic(messages(spark, sf_dir)).select("topic", "seq", "value")


@query(f"WITH {M} SELECT topic, 'f' || publisher AS child, arg_max(value, seq) AS tx, min(seq) AS first_seq FROM m GROUP BY 1, 2")
def static_latest(spark, sf_dir):
    m = messages(spark, sf_dir).select("topic", F.concat(F.lit("f"), F.col("publisher")).alias("child"), F.col("value").alias("tx"), "seq")
    return frames.latest(m).select("topic", "child", "tx", "first_seq")


# ---- geometry and points ----

_Q = "q AS (SELECT idx, x / s AS x, y / s AS y, z / s AS z, w / s AS w FROM (SELECT idx, x, y, z, 5.0 + intensity AS w, sqrt(x*x + y*y + z*z + (5.0 + intensity) * (5.0 + intensity)) AS s FROM p))"


@query(f"WITH {P}, {_Q} SELECT idx, round(atan2(2*(w*x + y*z), 1 - 2*(x*x + y*y)), 6) AS roll, round(asin(greatest(-1, least(1, 2*(w*y - z*x)))), 6) AS pitch, round(atan2(2*(w*z + x*y), 1 - 2*(y*y + z*z)), 6) AS yaw FROM q")
def quat_to_rpy(spark, sf_dir):
    q = (F.col("x"), F.col("y"), F.col("z"), 5.0 + F.col("intensity"))
    return points(spark, sf_dir).select("idx", *[F.round(c, 6).alias(n) for c, n in zip(geometry.to_rpy(q), ("roll", "pitch", "yaw"), strict=True)])


@query(f"WITH {P} SELECT idx, round(0.6*x - 0.8*y + 1, 6) AS x, round(0.8*x + 0.6*y + 2, 6) AS y, round(z + 3, 6) AS z FROM p")
def rigid_transform(spark, sf_dir):
    t, q = tuple(map(F.lit, (1.0, 2.0, 3.0))), (F.lit(0.0), F.lit(0.0), F.lit(0.2**0.5), F.lit(0.8**0.5))
    moved = geometry.transform((F.col("x"), F.col("y"), F.col("z")), t, q)
    return points(spark, sf_dir).select("idx", *[F.round(c, 6).alias(n) for c, n in zip(moved, "xyz", strict=True)])


@query(f"WITH {P} SELECT floor(x / 0.5)::BIGINT AS vx, floor(y / 0.5)::BIGINT AS vy, floor(z / 0.5)::BIGINT AS vz, round(avg(x), 6) AS x, round(avg(y), 6) AS y, round(avg(z), 6) AS z, count(*) AS n_points, min(idx) AS first_idx FROM p GROUP BY 1, 2, 3")
def voxel_centroid(spark, sf_dir):
    v = spatial.voxels(points(spark, sf_dir), 0.5)
    return v.select("vx", "vy", "vz", *[F.round(a, 6).alias(a) for a in "xyz"], "n_points", "first_idx")


@query(f"WITH {P} SELECT floor(x / 2.0)::BIGINT AS vx, floor(y / 2.0)::BIGINT AS vy, floor(z / 2.0)::BIGINT AS vz, round(avg(x), 6) AS x, count(*) AS n_points FROM p GROUP BY 1, 2, 3")
def voxel_merge(spark, sf_dir):
    p = points(spark, sf_dir)
    v = spatial.merged([spatial.voxels(p.where(F.col("idx") % 3 == k), 2.0) for k in range(3)])
    return v.select("vx", "vy", "vz", F.round("x", 6).alias("x"), "n_points")


_D2 = "(a.x-b.x)*(a.x-b.x) + (a.y-b.y)*(a.y-b.y) + (a.z-b.z)*(a.z-b.z)"


@query(f"WITH {P}, d AS (SELECT a.idx, b.idx AS other, {_D2} AS d2 FROM p a, p b), r AS (SELECT *, row_number() OVER (PARTITION BY idx ORDER BY d2, other) AS rank FROM d) SELECT idx, other, rank FROM r WHERE rank <= 4")
def knn(spark, sf_dir):
    shared(spark)
    p = points(spark, sf_dir)
    return spatial.nearest(p, p, 4, 1.0).select("idx", "other", F.col("rank").cast("long").alias("rank"))


@query(f"WITH {P} SELECT a.idx, count(*) AS n FROM p a, p b WHERE {_D2} <= 1 GROUP BY a.idx")
def radius_join(spark, sf_dir):
    p = points(spark, sf_dir)
    return spatial.within(p, p, 1.0).groupBy("idx").agg(F.count("*").alias("n"))


@query(f"WITH {P} SELECT a.idx FROM p a, p b WHERE a.idx <> b.idx AND {_D2} <= 1 GROUP BY a.idx HAVING count(*) >= 3")
def radius_outliers(spark, sf_dir):
    return spatial.inliers(points(spark, sf_dir), 1.0, 3).select("idx")


@query(f"WITH {P}, d AS (SELECT a.idx, b.label, row_number() OVER (PARTITION BY a.idx ORDER BY {_D2}, b.idx) AS r FROM p a, p b WHERE b.idx % 4 = 0 AND {_D2} <= 1) SELECT p.idx, d.label FROM p LEFT JOIN d ON p.idx = d.idx AND d.r = 1")
def colour_propagation(spark, sf_dir):
    shared(spark)
    p = points(spark, sf_dir)
    return spatial.propagated(p, p.where("idx % 4 = 0"), ["label"], 1.0)


_V = "v AS (SELECT DISTINCT floor(x)::BIGINT AS vx, floor(y)::BIGINT AS vy, floor(z)::BIGINT AS vz FROM p)"


@query(f"WITH {P}, {_V}, o AS (SELECT range - 1 AS d FROM range(3)), n AS (SELECT vx + a.d AS vx, vy + b.d AS vy, vz + c.d AS vz FROM v, o a, o b, o c) SELECT vx, vy, vz FROM n GROUP BY 1, 2, 3 HAVING count(*) = 27")
def void_erode(spark, sf_dir):
    return spatial.void(points(spark, sf_dir).select(*spatial.cell(1.0)), 1)


@query(f"WITH {P}, v AS (SELECT DISTINCT floor(x)::BIGINT AS vx, floor(y)::BIGINT AS vy, floor(z)::BIGINT AS vz FROM p WHERE idx % 2 = 0) SELECT idx FROM p WHERE NOT EXISTS (SELECT 1 FROM v WHERE vx = floor(x) AND vy = floor(y) AND vz = floor(z))")
def dynamic_antijoin(spark, sf_dir):
    p = points(spark, sf_dir)
    return spatial.outside(p, p.where("idx % 2 = 0").select(*spatial.cell(1.0)).distinct(), 1.0).select("idx")


@query(f"WITH {P}, v AS (SELECT DISTINCT label, floor(x / 0.5)::BIGINT AS vx, floor(y / 0.5)::BIGINT AS vy, floor(z / 0.5)::BIGINT AS vz FROM p WHERE idx % 3 = 0) SELECT idx FROM p WHERE EXISTS (SELECT 1 FROM v WHERE v.label = p.label AND abs(vx - floor(x / 0.5)) <= 1 AND abs(vy - floor(y / 0.5)) <= 1 AND abs(vz - floor(z / 0.5)) <= 1)")
def support_gate(spark, sf_dir):
    p = points(spark, sf_dir)
    return spatial.supported(p, p.where("idx % 3 = 0").select("label", *spatial.cell(0.5)), 0.5, "label").select("idx")


_K = [20.0, 0.0, 16.0, 0.0, 20.0, 12.0, 0.0, 0.0, 1.0]
_PX = "x AS (SELECT idx, floor(20.0 * x / z + 16)::INT AS u, floor(20.0 * y / z + 12)::INT AS v, z AS depth FROM p WHERE z > 0), i AS (SELECT * FROM x WHERE u >= 0 AND u < 32 AND v >= 0 AND v < 24)"


@query(f"WITH {P}, {_PX} SELECT idx, u, v, round(depth, 6) AS depth FROM i")
def project_points(spark, sf_dir):
    return spatial.projected(points(spark, sf_dir), _K, 32, 24).select("idx", "u", "v", F.round("depth", 6).alias("depth"))


@query(f"WITH {P}, {_PX}, f AS (SELECT u, v, min(depth) AS front FROM i GROUP BY 1, 2) SELECT i.idx FROM i JOIN f USING (u, v) WHERE depth <= front + 0.5")
def depth_buffer(spark, sf_dir):
    return spatial.visible(spatial.projected(points(spark, sf_dir), _K, 32, 24), 0.5).select("idx")


@query(f"WITH {P}, {_PX} SELECT u, v, arg_max(idx, depth) AS idx FROM i GROUP BY 1, 2")
def overlay_order(spark, sf_dir):
    px = spatial.projected(points(spark, sf_dir), _K, 32, 24).withColumn("n", F.col("idx"))
    return spatial.overlay(px, "n").select("u", "v", F.col("n").alias("idx"))


@query("SELECT c, round(CASE WHEN c / 255.0 <= 0.04045 THEN c / 255.0 / 12.92 ELSE pow((c / 255.0 + 0.055) / 1.055, 2.4) END, 9) AS linear, c::INT AS back FROM (SELECT range AS c FROM range(256))")
def srgb(spark, sf_dir):
    linear = geometry.to_linear(F.col("id"))
    return spark.range(256).select(F.col("id").alias("c"), F.round(linear, 9).alias("linear"), geometry.to_srgb(linear).alias("back"))


_O = "o AS (SELECT user_id AS point_idx, (event_id % 3)::INT AS camera, event_id AS image_seq, (value * 7)::BIGINT % 256 AS r, (value * 11)::BIGINT % 256 AS g, (value * 13)::BIGINT % 256 AS b, (event_id % 4)::DOUBLE AS weight FROM events)"
_L = "CASE WHEN {0} / 255.0 <= 0.04045 THEN {0} / 255.0 / 12.92 ELSE pow(({0} / 255.0 + 0.055) / 1.055, 2.4) END"


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = lambda k: (F.rint(F.col("value") * k).cast("long") % 256)
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return e.select(F.col("user_id").alias("point_idx"), (F.col("event_id") % 3).cast("int").alias("camera"), F.col("event_id").alias("image_seq"), c(7).alias("r"), c(11).alias("g"), c(13).alias("b"), (F.col("event_id") % 4).cast("double").alias("weight"))


@query(
    f"WITH {_O}, k AS (SELECT *, row_number() OVER (PARTITION BY point_idx ORDER BY 0.299*r + 0.587*g + 0.114*b, camera, image_seq) - 1 AS k, count(*) OVER (PARTITION BY point_idx) AS n FROM o), a AS (SELECT point_idx, r AS ar, g AS ag, b AS ab FROM k WHERE k = (3*n + 3) // 4 - 1), "
    f"t AS (SELECT k.*, greatest(abs(r - ar), abs(g - ag), abs(b - ab)) <= 48 AS near FROM k JOIN a USING (point_idx)), s AS (SELECT point_idx, " + ", ".join(f"CASE WHEN sum(weight) > 0 THEN sum(weight * {_L.format(c)}) / sum(weight) ELSE avg({_L.format(c)}) END AS {c}" for c in "rgb") + " FROM t WHERE near GROUP BY point_idx) "
    "SELECT point_idx, " + ", ".join(f"floor((CASE WHEN {c} <= 0.0031308 THEN {c} * 12.92 ELSE 1.055 * pow({c}, 1 / 2.4) - 0.055 END) * 255 + 0.5)::INT AS {c}" for c in "rgb") + " FROM s"
)
def robust_colour(spark, sf_dir):
    return colour.robust(observations(spark, sf_dir))


_S = "floor((CASE WHEN {0} <= 0.0031308 THEN {0} * 12.92 ELSE 1.055 * pow({0}, 1 / 2.4) - 0.055 END) * 255 + 0.5)"


@query(
    f"WITH {_O}, l AS (SELECT point_idx, camera, sum(weight) AS w, " + ", ".join(f"sum(weight * {_L.format(c)}) / sum(weight) AS {c}" for c in "rgb") + " FROM o WHERE weight > 0 GROUP BY 1, 2), "
    "p AS (SELECT point_idx, camera, w, " + ", ".join(f"{_S.format(c)} AS {c}" for c in "rgb") + " FROM l), "
    "q AS (SELECT c.camera, " + ", ".join(f"({_L.format(f'a.{c}')}) / ({_L.format(f'c.{c}')}) AS {c}" for c in "rgb") + " FROM p a JOIN p c USING (point_idx) WHERE a.camera = (SELECT min(camera) FROM p) AND c.camera <> a.camera AND least(a.r, a.g, a.b, c.r, c.g, c.b) >= 8), "
    "g AS (SELECT camera, " + ", ".join(f"CASE WHEN count(*) >= 64 THEN greatest(0.2, least(5.0, median({c}))) ELSE 1.0 END AS {c}" for c in "rgb") + " FROM q GROUP BY 1), "
    "h AS (SELECT point_idx, w, " + ", ".join(f"least(1.0, ({_L.format(f'p.{c}')}) * coalesce(g.{c}, 1.0)) AS {c}" for c in "rgb") + " FROM p LEFT JOIN g USING (camera)), "
    "a AS (SELECT point_idx, w, " + ", ".join(f"{_S.format(c)} AS {c}" for c in "rgb") + " FROM h), "
    "z AS (SELECT point_idx, " + ", ".join(f"sum(w * ({_L.format(c)})) / sum(w) AS {c}" for c in "rgb") + " FROM a GROUP BY 1) "
    "SELECT point_idx, " + ", ".join(f"({_S.format(c)})::INT AS {c}" for c in "rgb") + " FROM z"
)
def gain_blend(spark, sf_dir):
    return colour.blended(observations(spark, sf_dir))


# ---- text ----


@query(f"WITH {M} SELECT seq, strftime(make_timestamp(timestamp_ns // 1000), '%Y-%m-%d %H:%M:%S') || '.' || lpad((timestamp_ns % 1000000000)::VARCHAR, 9, '0') || ' UTC (' || (timestamp_ns // 1000000000) || '.' || lpad((timestamp_ns % 1000000000)::VARCHAR, 9, '0') || ')' AS stamp, replace(topic, '/', '__') AS file FROM m")
def stamp_text(spark, sf_dir):
    return messages(spark, sf_dir).select("seq", text.stamp(F.col("timestamp_ns")).alias("stamp"), text.file_name(F.col("topic")).alias("file"))


@query(f"WITH {M} SELECT timestamp_ns, value AS tx, (seq % 10)::DOUBLE AS ty FROM m")
def tum_round_trip(spark, sf_dir):
    m = messages(spark, sf_dir)
    zero, one = F.lit(0.0), F.lit(1.0)
    lines = m.select(text.tum_line(F.col("timestamp_ns"), [F.col("value"), (F.col("seq") % 10).cast("double"), zero, zero, zero, zero, one]).alias("value"))
    other = spark.createDataFrame([("# comment",), ("",), ("1.5 0 0 0 0 0 1",), ("1e9 0 0 0 0 0 0 1",), ("1.1234567891 0 0 0 0 0 0 1",)], "value string")
    return text.parse_tum(lines.union(other)).select("timestamp_ns", "tx", "ty")


# ---- without SQL ----


_KEY = f"{M}, f AS (SELECT topic, min(seq) AS seq, arg_min(value, seq) AS value FROM m GROUP BY topic), k AS (SELECT topic, seq, value, 0 AS bucket FROM f UNION ALL SELECT k.topic, min(m.seq), arg_min(m.value, m.seq), k.bucket + 1 FROM k JOIN m ON m.topic = k.topic AND m.seq > k.seq AND (m.value - k.value) * (m.value - k.value) >= 625 GROUP BY k.topic, k.bucket)"


@query(f"WITH RECURSIVE {_KEY} SELECT m.topic, m.seq, (max(k.bucket) OVER (PARTITION BY m.topic ORDER BY m.seq))::BIGINT AS bucket FROM m LEFT JOIN k ON k.topic = m.topic AND k.seq = m.seq")
def keyframes(spark, sf_dir):
    shared(spark)
    m = messages(spark, sf_dir).select("topic", "seq", F.col("value").alias("tx"), *[F.lit(0.0).alias(c) for c in ("ty", "tz", "qx", "qy", "qz")], F.lit(1.0).alias("qw"))
    return buckets.keyframes(m, 25.0, 0.5)


@query()
def reservoir_sample(spark, sf_dir):
    return colour.reservoir(observations(spark, sf_dir), ["point_idx"], "image_seq")


@query()
def point_normals(spark, sf_dir):
    shared(spark)
    return spatial.normals(points(spark, sf_dir), 8, 1.0)
