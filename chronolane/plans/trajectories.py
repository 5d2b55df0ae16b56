"""Queries over trajectories through frames, the maps made along them, and calibration files."""

from __future__ import annotations

from pyspark.sql import functions as F

from chronolane.operators import clouds, frames, select, stats
from chronolane.plans.recording import M, P, messages, points, query, topic
from chronolane.plans.shared import shared, shared_path
from chronolane.sources import calibration

_DAY = 86_400_000_000_000
_ARM = f"(SELECT min(timestamp_ns) FROM m) + {2 * _DAY} AND (SELECT min(timestamp_ns) FROM m) + {10 * _DAY}"


def _unturned():
    return [*[F.lit(0.0).alias(c) for c in ("qx", "qy", "qz")], F.lit(1.0).alias("qw")]


def _edges(spark, sf_dir):
    """map to base from clicks, base to arm from some days' views, arm to cam static: moved by (1, 2, 3) and turned by a quarter."""
    m = messages(spark, sf_dir)
    low = m.agg(F.min("timestamp_ns")).first()[0]

    def moving(rows, name, parent, child):
        at = rows.groupBy(F.col("timestamp_ns").alias("stamp_ns")).agg(F.max("value").alias("tx"), F.max("publisher").cast("double").alias("ty"))
        return at.select(F.lit(name).alias("topic"), F.lit(parent).alias("parent"), F.lit(child).alias("child"), "stamp_ns", F.lit(False).alias("is_static"), "tx", "ty", F.lit(0.0).alias("tz"), *_unturned())

    odometry = moving(topic(m, "/click"), "/odom", "map", "base")
    arm = moving(topic(m, "/view").where(F.col("timestamp_ns").between(low + 2 * _DAY, low + 10 * _DAY)), "/arm", "base", "arm")
    half = 0.5**0.5
    still = spark.createDataFrame([("/tf_static", "arm", "cam", 0, True, 1.0, 2.0, 3.0, 0.0, 0.0, half, half)], odometry.schema)
    return odometry.unionByName(arm).unionByName(still)


_SAMPLES = f"""{M}, o AS (SELECT timestamp_ns AS t, max(value) AS x, max(publisher) AS y FROM m WHERE topic = '/click' GROUP BY t),
a AS (SELECT timestamp_ns AS t, max(value) AS x, max(publisher) AS y FROM m WHERE topic = '/view' AND timestamp_ns BETWEEN {_ARM} GROUP BY t),
n AS (SELECT o.*, p.t AS pt, p.x AS px, p.y AS py, q.t AS qt, q.x AS qx, q.y AS qy, CASE WHEN p.t = q.t THEN 0 ELSE (o.t - p.t) / (q.t - p.t) END AS f FROM o ASOF LEFT JOIN a p ON o.t >= p.t ASOF LEFT JOIN a q ON o.t <= q.t),
s AS (SELECT *, CASE WHEN pt IS NULL THEN 'before the first transform' WHEN qt IS NULL THEN 'after the last transform' END AS reason, x + px + (qx - px) * f + 1 AS sx, y + py + (qy - py) * f + 2 AS sy FROM n)"""


@query(f"WITH {_SAMPLES} SELECT t AS timestamp_ns, CASE WHEN reason IS NULL THEN round(-sy, 5) + 0 END AS tx, CASE WHEN reason IS NULL THEN round(sx, 5) + 0 END AS ty, CASE WHEN reason IS NULL THEN -3::DOUBLE END AS tz, CASE WHEN reason IS NULL THEN round(-sqrt(0.5), 6) END AS qz, reason, CASE WHEN reason IS NOT NULL THEN 'arm' END AS frame FROM s")
def trajectory_sampled(spark, sf_dir):
    """The map as the camera sees it at every stamp of the odometry, with why there is no pose where there is none."""
    shared(spark)
    out = frames.trajectory(_edges(spark, sf_dir), "/odom", "cam", "map")
    sign = F.when(F.col("qw") < 0, -1).otherwise(1)
    return out.select("timestamp_ns", (F.round("tx", 5) + 0).alias("tx"), (F.round("ty", 5) + 0).alias("ty"), (F.round("tz", 9) + 0).alias("tz"), F.round(F.col("qz") * sign, 6).alias("qz"), "reason", "frame")


@query(f"WITH {_SAMPLES} SELECT reason, 'arm' AS frame, count(*) AS n_skipped, min(t) AS first_ns, max(t) AS last_ns FROM s WHERE reason IS NOT NULL GROUP BY reason")
def trajectory_skipped(spark, sf_dir):
    shared(spark)
    return frames.skipped(frames.trajectory(_edges(spark, sf_dir), "/odom", "cam", "map"))


@query(
    f"WITH {M}, {P}, c AS (SELECT timestamp_ns AS t, max(value) AS x, max(publisher)::DOUBLE AS y FROM m WHERE topic = '/click' GROUP BY t), "
    "k AS (SELECT *, (SELECT min(t) FROM c) + (idx - 60) * 60000000000 AS t FROM p), "
    "w AS (SELECT k.idx, k.x + a.x + (b.x - a.x) * CASE WHEN a.t = b.t THEN 0 ELSE (k.t - a.t) / (b.t - a.t) END AS x, k.y + a.y + (b.y - a.y) * CASE WHEN a.t = b.t THEN 0 ELSE (k.t - a.t) / (b.t - a.t) END AS y, k.z FROM k ASOF JOIN c a ON k.t >= a.t ASOF JOIN c b ON k.t <= b.t) "
    "SELECT floor(x / 50)::BIGINT AS vx, floor(y / 50)::BIGINT AS vy, floor(z / 50)::BIGINT AS vz, round(avg(x), 4) + 0 AS x, round(avg(y), 4) + 0 AS y, round(avg(z), 4) + 0 AS z, count(*) AS n_points, min(idx) AS first_idx FROM w GROUP BY ALL"
)
def voxel_map(spark, sf_dir):
    """Points a minute apart, from an hour before the trajectory on, carried by it and averaged by voxel."""
    c = topic(messages(spark, sf_dir), "/click").groupBy("timestamp_ns").agg(F.max("value").alias("tx"), F.max("publisher").cast("double").alias("ty"))
    low = c.agg(F.min("timestamp_ns")).first()[0]
    p = points(spark, sf_dir).withColumn("timestamp_ns", F.lit(low) + (F.col("idx") - 60) * 60_000_000_000)
    out = clouds.mapped(p.select("idx", "timestamp_ns", "x", "y", "z"), c.select("*", F.lit(0.0).alias("tz"), *_unturned()), 50.0)
    return out.withColumns({a: F.round(a, 4) + 0 for a in "xyz"})


_SHAPE = "arg_min(p_size, p_partkey) AS s, arg_min(p_retailprice, p_partkey)::DOUBLE AS c"


@query(f"WITH g AS (SELECT p_brand, {_SHAPE} FROM part GROUP BY p_brand) SELECT p_brand AS camera_name, s * 10::BIGINT AS width, s * 8::BIGINT AS height, 'plumb_bob' AS distortion_model, 2::BIGINT AS n_d, c AS fx, s / 3.2e0 AS cx, s / -1024 AS d1 FROM g")
def calibration_files(spark, sf_dir):
    """A calibration for each brand, written as files and read back."""
    one = F.struct("p_size", F.col("p_retailprice").cast("double").alias("c"))
    g = spark.read.parquet(f"{sf_dir}/part.parquet").groupBy("p_brand").agg(F.min_by(one, "p_partkey").alias("v")).select("p_brand", "v.*")
    s, zero, one = F.col("p_size").cast("double"), F.lit(0.0), F.lit(1.0)
    row = [F.col("c"), zero, s / 3.2, zero, F.col("c"), s / 4, zero, zero, one]
    made = g.select(
        F.col("p_brand").alias("camera_name"),
        (F.col("p_size") * 10).cast("long").alias("width"),
        (F.col("p_size") * 8).cast("long").alias("height"),
        F.lit("plumb_bob").alias("distortion_model"),
        F.array(zero, s / -1024).alias("d"),
        F.array(*row).alias("k"),
        F.array(*[one if k % 4 == 0 else zero for k in range(9)]).alias("r"),
        F.array(*row[:3], zero, *row[3:6], zero, *row[6:], zero).alias("p"),
    )
    path = shared_path(spark, "calibrations")
    calibration.write_calibrations(made, path)
    at = lambda c, k: F.get(c, F.lit(k))
    return calibration.read_calibrations(spark, path).select("camera_name", "width", "height", "distortion_model", F.size("d").cast("long").alias("n_d"), at("k", 0).alias("fx"), at("p", 2).alias("cx"), at("d", 1).alias("d1"))


@query(f"WITH {M} SELECT topic, count(*) AS n_messages FROM m WHERE topic IN ('/click', '/error') GROUP BY topic")
def topic_counts(spark, sf_dir):
    return stats.topic_counts(messages(spark, sf_dir), ["/click", "/error", "/absent"])


@query(f"WITH {M}, t AS (SELECT DISTINCT CASE WHEN topic < '/l' THEN topic || '/tf_static' ELSE topic || '/tf' END AS topic FROM m WHERE topic <> '/error') SELECT topic, suffix(topic, 'tf_static') AS is_static, CASE WHEN topic = '/view/tf' THEN 0 ELSE 1 END AS place FROM t WHERE topic = '/view/tf' OR topic < '/l'")
def tree_topics(spark, sf_dir):
    """Every event type as a transform topic (errors as another kind): one by its name, and the static ones."""
    kind = F.when(F.col("topic") == "/error", "std_msgs/msg/String").otherwise(select.TRANSFORMS)
    ending = F.when(F.col("topic") < "/l", "/tf_static").otherwise("/tf")
    catalogue = messages(spark, sf_dir).select(F.concat("topic", ending).alias("topic"), kind.alias("type")).distinct()
    return select.tree_topics(catalogue, ["/view/tf", "static"])
