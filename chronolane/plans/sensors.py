"""Queries over sensor messages: rows of the driver's tables become payloads, are read back, and typed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronolane.functions import cdr, message_from_text, sensors
from chronolane.functions import message_text as text_of
from chronolane.operators import asof, frames, gnss, inertial, stats
from chronolane.plans.recording import C, M, messages, query, stamped, topic
from chronolane.plans.shared import shared


def _header(frame, t=None):
    t = F.col("timestamp_ns") if t is None else t
    return F.struct(F.struct(F.floor(t / 1_000_000_000).cast("int").alias("sec"), (t % 1_000_000_000).alias("nanosec")).alias("stamp"), frame.alias("frame_id"))


def _xyz(*values):
    return F.struct(*[F.lit(v).cast("double").alias(a) if not hasattr(v, "cast") else v.cast("double").alias(a) for a, v in zip("xyzw", values, strict=False)])


def _zeros(n):
    return F.array_repeat(F.lit(0.0), n)


def _sent(rows: DataFrame, schema: str) -> DataFrame:
    """topic, timestamp_ns, seq and message, sent as payloads and read back."""
    return cdr.decoded(cdr.encoded(rows, schema), schema)


@query(f"WITH {M} SELECT topic, seq, timestamp_ns AS stamp_ns, 'imu' AS frame_id, value AS wx, publisher::DOUBLE AS wy, -value AS wz, value / 2 AS ax, seq::DOUBLE AS ay, 9.5::DOUBLE AS az FROM m")
def imu_samples(spark, sf_dir):
    value = F.col("value")
    m = F.struct(_header(F.lit("imu")).alias("header"), _xyz(0.0, 0.0, 0.0, 1.0).alias("orientation"), _zeros(9).alias("orientation_covariance"), _xyz(value, F.col("publisher"), -value).alias("angular_velocity"), _zeros(9).alias("angular_velocity_covariance"), _xyz(value / 2, F.col("seq"), 9.5).alias("linear_acceleration"), _zeros(9).alias("linear_acceleration_covariance"))
    rows = messages(spark, sf_dir).select("topic", "timestamp_ns", "seq", m.alias("message"))
    return sensors.imu(_sent(rows, sensors.IMU)).drop("timestamp_ns")


@query(f"WITH {M} SELECT topic, seq, timestamp_ns AS stamp_ns, 'gnss' AS frame_id, (seq % 3)::INT - 1 AS status, value / 10 AS latitude, -value AS longitude, publisher::DOUBLE AS altitude, value AS east_variance, 2 AS covariance_type FROM m")
def gnss_fixes(spark, sf_dir):
    value = F.col("value")
    status = F.struct((F.col("seq") % 3 - 1).alias("status"), F.lit(1).alias("service"))
    m = F.struct(_header(F.lit("gnss")).alias("header"), status.alias("status"), (value / 10).alias("latitude"), (-value).alias("longitude"), F.col("publisher").cast("double").alias("altitude"), F.array_repeat(value, 9).alias("position_covariance"), F.lit(2).alias("position_covariance_type"))
    rows = messages(spark, sf_dir).select("topic", "timestamp_ns", "seq", m.alias("message"))
    found = sensors.fixes(_sent(rows, sensors.NAV_SAT_FIX))
    return found.select("topic", "seq", "stamp_ns", "frame_id", "status", "latitude", "longitude", "altitude", F.get("covariance", F.lit(0)).alias("east_variance"), "covariance_type")


def _nations(spark, sf_dir) -> DataFrame:
    """A message for each region with the transforms to its nations; even regions are static. One transform of each has no child's name."""
    n, r = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("nation", "region"))
    key = F.col("n_nationkey")
    moved = lambda child: F.struct(_header(F.col("r_name"), key.cast("long") * 1_500_000_000).alias("header"), child.alias("child_frame_id"), F.struct(_xyz(key, key / 2, 0.0).alias("translation"), _xyz(0.0, 0.0, 0.0, 1.0).alias("rotation")).alias("transform"))
    both = n.join(r, n["n_regionkey"] == r["r_regionkey"]).select("r_regionkey", F.explode(F.array(F.struct(key.alias("k"), moved(F.col("n_name")).alias("t")), F.struct((key + 1000).alias("k"), moved(F.lit("")).alias("t")))).alias("e"))
    rows = both.groupBy("r_regionkey").agg(F.array_sort(F.collect_list("e"), lambda a, b: a["k"].cast("int") - b["k"].cast("int")).alias("e"))
    name = F.when(F.col("r_regionkey") % 2 == 0, "/tf_static").otherwise("/tf")
    m = F.struct(F.transform("e", lambda x: x["t"]).alias("transforms"))
    rows = rows.select(name.alias("topic"), F.col("r_regionkey").cast("long").alias("timestamp_ns"), F.col("r_regionkey").cast("long").alias("seq"), m.alias("message"))
    return sensors.transforms(_sent(rows, sensors.TF_MESSAGE))


_N = "FROM nation JOIN region ON n_regionkey = r_regionkey"


@query(f"SELECT CASE WHEN r_regionkey % 2 = 0 THEN '/tf_static' ELSE '/tf' END AS topic, r_name AS parent, k.child AS child, n_nationkey * 1500000000::BIGINT AS stamp_ns, r_regionkey % 2 = 0 AS is_static, n_nationkey::DOUBLE AS tx, n_nationkey / 2 AS ty, 1::DOUBLE AS qw {_N}, LATERAL (SELECT unnest([n_name, '']) AS child) k")
def tf_transforms(spark, sf_dir):
    return _nations(spark, sf_dir).select("topic", "parent", "child", "stamp_ns", "is_static", "tx", "ty", "qw")


@query(f"SELECT r_name AS parent, n_name AS child, CASE WHEN r_regionkey % 2 = 0 THEN 'static' ELSE 'moving' END AS kind {_N}")
def tf_tree(spark, sf_dir):
    return frames.union_tree(frames.edge_sets(_nations(spark, sf_dir)))


def _cameras(spark, sf_dir) -> DataFrame:
    """A camera info for each part."""
    p = spark.read.parquet(f"{sf_dir}/part.parquet")
    size = F.col("p_size")
    k = F.array(*[F.lit(v) if isinstance(v, float) else v.cast("double") for v in (size * 10, F.lit(0.5), size * 5, 0.0, size * 11, size * 4, 0.0, 0.0, 1.0)])
    q = F.array(*[F.lit(v) if isinstance(v, float) else v.cast("double") for v in (size * 10, 0.0, size * 5, size, 0.0, size * 11, size * 4, size * 2, 0.0, 0.0, 1.0, 7.0)])
    roi = F.struct(*[F.lit(0).alias(c) for c in ("x_offset", "y_offset", "height", "width")], F.lit(False).alias("do_rectify"))
    m = F.struct(_header(F.lit("cam"), F.col("p_partkey").cast("long")).alias("header"), (size * 8 + 1).alias("height"), (size * 10 + 3).alias("width"), F.lit("plumb_bob").alias("distortion_model"), _zeros(5).alias("d"), k.alias("k"), _zeros(9).alias("r"), q.alias("p"), F.lit(2).alias("binning_x"), F.lit(3).alias("binning_y"), roi.alias("roi"))
    name = F.concat(F.lit("/cam"), (F.col("p_partkey") % 2).cast("string"))
    rows = p.select(name.alias("topic"), F.col("p_partkey").cast("long").alias("timestamp_ns"), F.col("p_partkey").cast("long").alias("seq"), m.alias("message"))
    return cdr.encoded(rows, sensors.CAMERA_INFO)


@query("SELECT p_partkey::BIGINT AS seq, round((p_size * 10 + 3) * 0.5::DOUBLE)::BIGINT AS width, round((p_size * 8 + 1) * 0.25::DOUBLE)::BIGINT AS height, p_size * 5::DOUBLE AS fx, 0.25::DOUBLE AS skew, p_size * 2.75::DOUBLE AS fy, p_size::DOUBLE AS cy, p_size * 0.5::DOUBLE AS tx, 7::DOUBLE AS tz FROM part")
def camera_scaled(spark, sf_dir):
    found = sensors.camera_infos(cdr.decoded(_cameras(spark, sf_dir), sensors.CAMERA_INFO))
    at = lambda c, i, name: F.get(c, F.lit(i)).alias(name)
    return sensors.scaled(found, 0.5, 0.25).select("seq", "width", "height", at("k", 0, "fx"), at("k", 1, "skew"), at("k", 4, "fy"), at("k", 5, "cy"), at("p", 3, "tx"), at("p", 11, "tz"))


@query("SELECT '/cam' || p_partkey % 2 AS topic, p_partkey::BIGINT AS seq, CASE WHEN p_partkey % 2 = 1 THEN 640 ELSE p_size * 10 + 3 END::BIGINT AS width, (p_size * 8 + 1)::BIGINT AS height, 3::BIGINT AS binning_y FROM part")
def camera_replaced(spark, sf_dir):
    changed = sensors.with_camera(_cameras(spark, sf_dir), ["/cam1"], {"width": 640})
    m = F.col("message")
    return cdr.decoded(changed, sensors.CAMERA_INFO).select("topic", "seq", m["width"].alias("width"), m["height"].alias("height"), m["binning_y"].alias("binning_y"))


@query("SELECT '/cam' || p_partkey % 2 AS topic, min(p_partkey)::BIGINT AS seq, 10 * arg_min(p_size, p_partkey)::DOUBLE AS fx FROM part GROUP BY ALL")
def camera_first(spark, sf_dir):
    first = frames.first_per_topic(_cameras(spark, sf_dir))
    return sensors.camera_infos(cdr.decoded(first, sensors.CAMERA_INFO)).select("topic", "seq", F.get("k", F.lit(0)).alias("fx"))


_AT = 5_005_000_000


@query(f"""WITH {M},
s AS (SELECT topic, seq, seq * 10000000 AS t, (publisher % 10 - 4.5)::DOUBLE / 100 AS w, (value % 10) / 1000 AS ax, 0.001::DOUBLE AS ay, 0.011::DOUBLE AS az FROM m),
d AS (SELECT *, sign(t - {_AT}) AS way, abs(t - {_AT}) AS tau FROM s WHERE t <> {_AT}),
h AS (SELECT *, way * (tau - coalesce(lag(tau) OVER (PARTITION BY topic, way ORDER BY tau), 0)) / 1e9 AS h FROM d),
r AS (SELECT *, sum(w * h) OVER (PARTITION BY topic, way ORDER BY tau) AS turn FROM h),
a AS (SELECT *, CASE WHEN way > 0 THEN turn - w * h ELSE turn END AS u FROM r),
g AS (SELECT *, cos(u) * ax - sin(u) * ay AS gx, sin(u) * ax + cos(u) * ay AS gy, az - 0.01 AS gz FROM a),
v AS (SELECT *, 0.1 + sum(gx * h) OVER k AS vx, sum(gy * h) OVER k AS vy, sum(gz * h) OVER k AS vz FROM g WINDOW k AS (PARTITION BY topic, way ORDER BY tau))
SELECT topic, seq, round(sum((vx - gx * h / 2) * h) OVER k, 3) + 0 AS px, round(sum((vy - gy * h / 2) * h) OVER k, 3) + 0 AS py, round(sum((vz - gz * h / 2) * h) OVER k, 3) + 0 AS pz, round(vx, 3) + 0 AS vx, round(vy, 3) + 0 AS vy, round(sin(turn / 2), 3) + 0 AS qz FROM v WINDOW k AS (PARTITION BY topic, way ORDER BY tau)
UNION ALL SELECT DISTINCT topic, NULL::BIGINT, 0, 0, 0, 0.1, 0, 0 FROM s""")
def dead_reckoning(spark, sf_dir):
    """Samples at 100 Hz, ahead of and behind a state at 5.005 s."""
    shared(spark)
    m = messages(spark, sf_dir)
    zero = F.lit(0.0)
    samples = m.select("topic", "seq", (F.col("seq") * 10_000_000).alias("timestamp_ns"), zero.alias("wx"), zero.alias("wy"), ((F.col("publisher") % 10 - 4.5) / 100).alias("wz"), (F.col("value") % 10 / 1000).alias("ax"), F.lit(0.001).alias("ay"), F.lit(0.011).alias("az"))
    state = {c: zero for c in inertial.STATE} | {"qw": F.lit(1.0), "vx": F.lit(0.1)}
    bias = {f"b{k}{a}": zero for k in "wa" for a in "xyz"}
    boundary = m.select("topic").distinct().select("topic", F.lit(_AT).alias("timestamp_ns"), *[v.alias(k) for k, v in (state | bias).items()])
    found = inertial.propagated(samples, boundary, (0.0, 0.0, -0.01), 2 * 10**9)
    r = lambda c, name: (F.round(c, 3) + 0.0).alias(name)
    return found.select("topic", "seq", r("tx", "px"), r("ty", "py"), r("tz", "pz"), r("vx", "vx"), r("vy", "vy"), r("qz", "qz"))


_HOUR = 3_600_000_000_000


@query(f"""WITH {M}, f AS (SELECT timestamp_ns, seq, value AS x, (publisher % 100)::DOUBLE AS y FROM m WHERE topic = '/view'),
k AS (SELECT seq AS id, timestamp_ns AS t, value / 2 AS ex, (publisher % 7)::DOUBLE AS ey FROM m WHERE topic = '/click' AND timestamp_ns - {_HOUR} >= (SELECT min(timestamp_ns) FROM f) AND timestamp_ns + {_HOUR} <= (SELECT max(timestamp_ns) FROM f)),
p AS (SELECT k.*, f.timestamp_ns AS pt, f.x AS px, f.y AS py FROM k ASOF JOIN f ON k.t >= f.timestamp_ns),
n AS (SELECT p.*, f.timestamp_ns AS nt, f.x AS nx, f.y AS ny FROM p ASOF JOIN f ON p.t <= f.timestamp_ns),
i AS (SELECT id, ex + 1 AS ex, ey + 2 AS ey, CASE WHEN nt = pt THEN px ELSE px + (nx - px) * ((t - pt) / (nt - pt)) END AS gx, CASE WHEN nt = pt THEN py ELSE py + (ny - py) * ((t - pt) / (nt - pt)) END AS gy, CASE WHEN t - pt <= nt - t THEN px ELSE nx END AS var FROM n),
o AS (SELECT atan2(covar_pop(gy, ex) - covar_pop(gx, ey), covar_pop(gx, ex) + covar_pop(gy, ey)) AS turn, avg(ex) AS mex, avg(ey) AS mey, avg(gx) AS mgx, avg(gy) AS mgy FROM i)
SELECT id, round(mex + cos(turn) * (gx - mgx) + sin(turn) * (gy - mgy) - 1, 4) AS wx, round(mey - sin(turn) * (gx - mgx) + cos(turn) * (gy - mgy) - 2, 4) AS wy, round((cos(turn) ^ 2 * var + sin(turn) ^ 2) * 4 + 0.25, 4) AS xx, round(cos(turn) * sin(turn) * (1 - var) * 4, 4) AS xy FROM i, o""")
def gnss_priors(spark, sf_dir):
    """Views as fixes, clicks as submaps of two hours."""
    m = messages(spark, sf_dir)
    zero, t = F.lit(0.0), F.col("timestamp_ns")
    spread = F.array(F.col("value"), zero, zero, zero, F.lit(1.0), zero, zero, zero, F.lit(1.0))
    fixes = topic(m, "/view").select("timestamp_ns", "seq", F.col("value").alias("x"), (F.col("publisher") % 100).cast("double").alias("y"), zero.alias("z"), spread.alias("covariance"))
    submaps = topic(m, "/click").select(F.col("seq").alias("id"), (t - _HOUR).alias("start_ns"), t.alias("mid_ns"), (t + _HOUR).alias("end_ns"), (F.col("value") / 2).alias("tx"), (F.col("publisher") % 7).cast("double").alias("ty"), *[zero.alias(c) for c in ("tz", "qx", "qy", "qz")], F.lit(1.0).alias("qw"))
    out = gnss.aligned(gnss.constrained(submaps, fixes, (1.0, 2.0, 0.0)))
    cov = gnss.prior_covariance(F.col("covariance"), F.col("c"), F.col("s"), 0.5, 2.0, 9.0)
    at = lambda i: F.round(F.get(cov, F.lit(i)), 4)
    return out.select("id", F.round("wx", 4).alias("wx"), F.round("wy", 4).alias("wy"), at(0).alias("xx"), at(1).alias("xy"))


@query(f"""WITH {C}, f AS (SELECT seq, timestamp_ns, header_ns FROM c WHERE topic = '/click'), p AS (SELECT * FROM c WHERE topic = '/view' AND header_ns > 0),
w AS (SELECT seq, header_ns > 0 AS h, CASE WHEN header_ns > 0 THEN header_ns ELSE timestamp_ns END AS t FROM f),
k AS (SELECT seq, timestamp_ns AS at, FALSE AS h FROM p UNION ALL SELECT seq, header_ns, TRUE FROM p),
a AS (SELECT w.*, k.at AS pt, k.seq AS ps FROM w ASOF LEFT JOIN k ON w.h = k.h AND w.t >= k.at),
b AS (SELECT a.*, k.at AS nt, k.seq AS ns FROM a ASOF LEFT JOIN k ON a.h = k.h AND a.t <= k.at)
SELECT seq, CASE WHEN h THEN 'header' ELSE 'record' END AS clock, CASE WHEN pt IS NULL THEN ns WHEN nt IS NULL OR t - pt <= nt - t THEN ps ELSE ns END AS match_seq FROM b""")
def clock_choice(spark, sf_dir):
    m = stamped(spark, sf_dir)
    clouds = topic(m, "/view").where("header_ns > 0")
    found = asof.matched_by_clock(topic(m, "/click").select("seq", "timestamp_ns", "header_ns"), clouds.select("seq", "timestamp_ns", "header_ns"), [])
    return found.select("seq", "clock", F.col("match.seq").alias("match_seq"))


@query(f"WITH {M} SELECT topic, timestamp_ns + seq % 2 AS timestamp_ns, CASE WHEN seq % 2 = 0 THEN seq END AS found_seq FROM m")
def exact_fetch(spark, sf_dir):
    m = messages(spark, sf_dir)
    wanted = m.select("topic", (F.col("timestamp_ns") + F.col("seq") % 2).alias("timestamp_ns"))
    return asof.fetched(wanted, m.select("topic", "timestamp_ns", "seq")).select("topic", "timestamp_ns", F.col("found.seq").alias("found_seq"))


@query(f"WITH {M} SELECT topic, count(*) FILTER (topic <> '/view' AND seq % 3 = 0) AS n FROM m GROUP BY topic")
def declared_topics(spark, sf_dir):
    m = messages(spark, sf_dir)
    return stats.declared_counts(m, m.where("topic <> '/view' AND seq % 3 = 0"))


_NOTE = "===\n".join(["std_msgs/Header header\nstring note\nint64[] numbers\nbool late\nfloat64 value\n", "MSG: std_msgs/Header\nbuiltin_interfaces/Time stamp\nstring frame_id\n"])


@query(
    f"WITH {M} SELECT topic, seq, 'header:' || chr(10) || '  stamp:' || chr(10) || '    sec: ' || timestamp_ns // 1000000000 || chr(10) || '    nanosec: ' || timestamp_ns % 1000000000 || chr(10) || '  frame_id: ''it''''s ' || topic || '''' || chr(10) "
    "|| 'note: ''' || replace(coalesce(payload, ''), '''', '''''') || '''' || chr(10) || 'numbers: [' || CASE WHEN seq % 40 > 32 THEN '<' || seq % 40 || ' items>' ELSE coalesce(array_to_string(list_transform(range(seq % 40), lambda x: x * 7), ', '), '') END || ']' || chr(10) || 'late: ' || (seq % 3 = 0) || chr(10) || 'value: ' || CASE seq % 8 WHEN 0 THEN '0' WHEN 4 THEN '0.5' WHEN 2 THEN '0.25' WHEN 6 THEN '0.75' ELSE (seq % 8 * 0.125)::VARCHAR END || chr(10) AS text FROM m"
)
def message_text(spark, sf_dir):
    """Messages with quotes, short, long and empty arrays, as text."""
    seq = F.col("seq")
    many = F.transform(F.sequence(F.lit(0), seq % 40), lambda x: x * 7)
    m = F.struct(_header(F.concat(F.lit("it's "), "topic")).alias("header"), F.coalesce("payload", F.lit("")).alias("note"), F.slice(many, F.lit(1), (seq % 40).cast("int")).alias("numbers"), (seq % 3 == 0).alias("late"), ((seq % 8) * 0.125).cast("double").alias("value"))
    sent = cdr.encoded(messages(spark, sf_dir).select("topic", "timestamp_ns", "seq", m.alias("message")), _NOTE)
    return text_of.rendered(sent, _NOTE).select("topic", "seq", "text")


_ENTRY = "===\n".join(["std_msgs/Header header\nint8 small\nfloat64 value\nstring note\nint64[<=4] numbers\n", "MSG: std_msgs/Header\nbuiltin_interfaces/Time stamp\nstring frame_id\n"])


@query(f"""WITH {M} SELECT topic, seq, timestamp_ns // 1000000000 AS sec, timestamp_ns % 1000000000 AS nanosec, seq % 200 - 60 AS small, value, 'it''s ' || topic AS note, seq % 6 AS n, NULL AS error FROM m WHERE seq % 200 < 188 AND seq % 6 <= 4 AND seq % 7 <> 3
UNION ALL SELECT topic, seq, NULL, NULL, NULL, NULL, NULL, NULL, CASE WHEN seq % 200 >= 188 THEN 'small: out of the range of int8' WHEN seq % 7 = 3 THEN 'value: missing' ELSE 'numbers: holds more than 4' END FROM m WHERE NOT (seq % 200 < 188 AND seq % 6 <= 4 AND seq % 7 <> 3)""")
def text_to_message(spark, sf_dir):
    """Texts of the messages become payloads stamped with their times; some do not fit, and say where."""
    shared(spark)
    seq, n = F.col("seq"), (F.col("seq") % 6).cast("int")
    number = F.when(seq % 7 == 3, "").otherwise(F.concat(F.lit("value: "), F.col("value").cast("string"), F.lit("\n")))
    many = F.concat_ws(", ", F.slice(F.array(*[F.lit(str(k)) for k in range(6)]), F.lit(1), n))
    text = F.concat(F.lit("# entry\nheader:\n  frame_id: map\nsmall: "), (seq % 200 - 60).cast("string"), F.lit("\n"), number, F.lit("note: 'it''s "), "topic", F.lit("'\nnumbers: ["), many, F.lit("]\n"))
    made = message_from_text.encoded(messages(spark, sf_dir).select("topic", "timestamp_ns", "seq", text.alias("text")), _ENTRY, sync_stamps=True).checkpoint()  # read twice below
    m = F.col("message")
    stamp = m["header"]["stamp"]
    good = cdr.decoded(made.where("payload IS NOT NULL"), _ENTRY).select("topic", "seq", stamp["sec"].cast("long").alias("sec"), stamp["nanosec"].cast("long").alias("nanosec"), m["small"].cast("long").alias("small"), m["value"].alias("value"), m["note"].alias("note"), F.size(m["numbers"]).cast("long").alias("n"), F.lit(None).cast("string").alias("error"))
    return good.unionByName(made.where("payload IS NULL").select("topic", "seq", "error"), allowMissingColumns=True)
