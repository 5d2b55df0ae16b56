"""Queries over recordings that are written from the driver's tables, in the shared folder, and read back; and over cloud messages."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chronolane.functions import cdr, sensors
from chronolane.operators import clouds, order
from chronolane.plans.recording import M, P, messages, points, query
from chronolane.plans.shared import shared, shared_path
from chronolane.sources import recording


def _written(spark, sf_dir: str, storage: str, n: int = 4) -> DataFrame:
    """The events as a recording of n shards, opened."""
    recording.register(spark)
    path = shared_path(spark, "recording")
    m = messages(spark, sf_dir).withColumn("payload", F.encode(F.coalesce("payload", F.lit("")), "UTF-8"))
    recording.repack(m, path, storage, n)
    return spark.read.format("recording").load(path)


_BYTES = "coalesce(payload, '') AS payload"


@query(f"WITH {M} SELECT topic, timestamp_ns, {_BYTES} FROM m")
def recording_scan(spark, sf_dir):
    return _written(spark, sf_dir, "mcap").select("topic", "timestamp_ns", F.decode("payload", "UTF-8").alias("payload"))


@query(f"WITH {M} SELECT topic, timestamp_ns, {_BYTES} FROM m WHERE topic IN ('/click', '/error')")
def recording_keep(spark, sf_dir):
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    kept = _written(spark, sf_dir, "mcap").where(F.col("topic").isin("/click", "/error"))
    return kept.select("topic", "timestamp_ns", F.decode("payload", "UTF-8").alias("payload"))


@query(f"WITH {M}, e AS (SELECT min(timestamp_ns) AS a FROM m) SELECT topic, timestamp_ns, {_BYTES} FROM m, e WHERE timestamp_ns >= a + 86400000000000 AND timestamp_ns < a + 864000000000000")
def recording_slice(spark, sf_dir):
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    low = messages(spark, sf_dir).agg(F.min("timestamp_ns")).first()[0]
    r = _written(spark, sf_dir, "sqlite3").where((F.col("timestamp_ns") >= low + 86400 * 10**9) & (F.col("timestamp_ns") < low + 864000 * 10**9))
    return r.select("topic", "timestamp_ns", F.decode("payload", "UTF-8").alias("payload"))


@query(f"WITH {M}, e AS (SELECT max(timestamp_ns) AS b FROM m) SELECT topic, count(*) AS n_messages, (min(timestamp_ns))::BIGINT AS first_ns FROM (SELECT CASE topic WHEN '/view' THEN '/seen' ELSE topic END AS topic, timestamp_ns FROM m WHERE topic <> '/click') GROUP BY topic")
def recording_repacked(spark, sf_dir):
    """From one storage to another, a topic dropped and one renamed on the way."""
    m = _written(spark, sf_dir, "sqlite3").where("topic <> '/click'").withColumn("topic", F.when(F.col("topic") == "/view", "/seen").otherwise(F.col("topic")))
    path = shared_path(spark, "repacked")
    recording.repack(m.drop("shard"), path, "mcap", 3)
    return spark.read.format("recording").load(path).groupBy("topic").agg(F.count("*").alias("n_messages"), F.min("timestamp_ns").alias("first_ns"))


@query(f"WITH {M} SELECT topic, timestamp_ns, seq, row_number() OVER (ORDER BY timestamp_ns, seq % 3 <> 0, seq) - 1 AS place FROM m")
def time_order(spark, sf_dir):
    shared(spark)
    m = messages(spark, sf_dir).select("topic", "timestamp_ns", "seq")
    return order.placed(m, F.col("seq") % 3 == 0)


@query(f"WITH {M}, h AS (SELECT topic, timestamp_ns // 3600000000000 * 3600000000000 AS timestamp_ns, seq FROM m) SELECT topic, timestamp_ns, row_number() OVER (ORDER BY timestamp_ns, seq % 3 <> 0, seq) - 1 AS place FROM h")
def recording_in_time_order(spark, sf_dir):
    """Messages of whole hours, many to a stamp, written in time order with a third of them reserved, and read in storage order."""
    recording.register(spark)
    path = shared_path(spark, "ordered")
    m = messages(spark, sf_dir).withColumn("timestamp_ns", F.floor(F.col("timestamp_ns") / 3_600_000_000_000) * 3_600_000_000_000).withColumn("payload", F.encode("topic", "UTF-8"))
    recording.write_in_time_order(m, path, F.col("seq") % 3 == 0)
    r = spark.read.format("recording").load(path).select("topic", "timestamp_ns", "shard", "seq")
    ends = r.groupBy("shard").agg(F.count("*").alias("n"))  # a row for each shard
    ends = ends.select("shard", F.coalesce(F.sum("n").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    at = F.row_number().over(Window.partitionBy("shard").orderBy("seq")) - 1
    return r.withColumn("at", at).join(F.broadcast(ends), "shard").select("topic", "timestamp_ns", (F.col("before") + F.col("at")).alias("place"))


@query(f"WITH {M} SELECT '/tf' AS topic, timestamp_ns, 'map' AS parent, 'base' AS child, value AS tx, publisher::DOUBLE AS ty, false AS is_static FROM m WHERE seq % 10 = 0 UNION ALL SELECT '/tf_static', (SELECT min(timestamp_ns) FROM m), r_name, n_name, n_nationkey::DOUBLE, 0, true FROM nation JOIN region ON n_regionkey = r_regionkey")
def recording_with_tree(spark, sf_dir):
    """A trajectory and a static tree embedded in a recording as topics, and read back."""
    recording.register(spark)
    m = messages(spark, sf_dir)
    zero, one = F.lit(0.0), F.lit(1.0)
    rest = [*[zero.alias(c) for c in ("tz", "qx", "qy", "qz")], one.alias("qw")]
    track = m.where("seq % 10 = 0").select("seq", F.col("timestamp_ns").alias("stamp_ns"), F.lit("map").alias("parent"), F.lit("base").alias("child"), F.col("value").alias("tx"), F.col("publisher").alias("ty"), *rest)
    n, r = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("nation", "region"))
    low = m.agg(F.min("timestamp_ns")).first()[0]
    tree = n.join(r, n["n_regionkey"] == r["r_regionkey"]).select(F.lit(low).alias("stamp_ns"), F.col("r_name").alias("parent"), F.col("n_name").alias("child"), F.col("n_nationkey").alias("tx"), zero.alias("ty"), *rest)
    path = shared_path(spark, "embedded")
    added = sensors.moving_messages(track, "/tf").unionByName(sensors.static_message(tree, "/tf_static", low))
    recording.embed(m.withColumn("payload", F.encode(F.coalesce("payload", F.lit("")), "UTF-8")), added, path)
    back = spark.read.format("recording").load(path).where(F.col("topic").isin("/tf", "/tf_static"))
    found = sensors.transforms(cdr.decoded(back, sensors.TF_MESSAGE))
    return found.select("topic", "timestamp_ns", "parent", "child", "tx", "ty", "is_static")


_T0 = 1_700_000_000


@query(
    f"WITH {P}, k AS (SELECT label, idx % 3 AS part, idx, x::FLOAT AS x, y::FLOAT AS y, z::FLOAT AS z, (idx % 8) * 0.125 AS t FROM p), g AS (SELECT label, min(part) AS p0 FROM k GROUP BY label) "
    "SELECT label AS cloud_seq, row_number() OVER (PARTITION BY label ORDER BY part, idx) - 1 AS point_idx, CASE WHEN part = 1 THEN (x::DOUBLE + 1)::FLOAT ELSE x END::DOUBLE AS x, CASE WHEN part = 1 THEN (y::DOUBLE + 2)::FLOAT ELSE y END::DOUBLE AS y, z::DOUBLE AS z, (t + part * 0.25)::DOUBLE AS t FROM k"
)
def cloud_groups(spark, sf_dir):
    """Each label's points as messages of three sensors, joined to one cloud: the second sensor's moved, times counted from the group's stamp."""
    p = points(spark, sf_dir).withColumn("part", (F.col("idx") % 3).cast("int"))
    stamp = (F.lit(_T0) + F.col("label").cast("long")) * 1_000_000_000
    p = p.withColumn("cloud_seq", F.col("label").cast("long") * 3 + F.col("part")).withColumn("header_stamp_ns", stamp + F.col("part") * 250_000_000)
    p = p.withColumn("point_idx", F.col("idx").cast("long")).withColumn("t", (F.col("idx") % 8) * 0.125)
    sent = clouds.packed(p, "lidar").select(F.concat(F.lit("/lidar"), F.col("cloud_seq") % 3).alias("topic"), F.col("cloud_seq").alias("seq"), "header_stamp_ns", "payload")
    picks = sent.select(F.floor(F.col("seq") / 3).alias("group_id"), (F.lit(_T0 * 10**9) + F.floor(F.col("seq") / 3) * 10**9).alias("stamp_ns"), (F.col("seq") % 3).cast("int").alias("part"), "topic", "seq")
    made = clouds.assembled(sent, picks, "base", {1: (1.0, 2.0, 0.0, 0.0, 0.0, 0.0, 1.0)})
    return clouds.unpacked(made.select(F.col("group_id").alias("cloud_seq"), "payload")).select("cloud_seq", "point_idx", "x", "y", "z", "t")
