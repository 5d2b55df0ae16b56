"""Colour observations of points, the best frames of buckets, and reservoirs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chronolane.functions.geometry import to_linear, to_srgb

CHANNELS = ("r", "g", "b")


def luminance():
    """In thousandths: whole numbers, so colours of equal luminance are equal to each other."""
    return 299 * F.col("r") + 587 * F.col("g") + 114 * F.col("b")


def robust(observations: DataFrame, trim: int = 48) -> DataFrame:
    """point_idx and colour: the weighted mean in linear light of the observations near the 75th percentile by luminance.

    Near: no channel further than `trim` from that observation's; where all are
    further, all stay; where the weights sum to nothing, the plain mean.
    """
    w = Window.partitionBy("point_idx")
    o = observations.withColumn("_r", F.row_number().over(w.orderBy(luminance(), "camera", "image_seq")) - 1).withColumn("_n", F.count("*").over(w))
    at = F.floor((3 * F.col("_n") + 3) / 4) - 1
    anchor = {c: F.max(F.when(F.col("_r") == at, F.col(c))).over(w) for c in CHANNELS}
    o = o.withColumns({f"_{c}": v for c, v in anchor.items()})
    near = F.greatest(*[F.abs(F.col(c) - F.col(f"_{c}")) for c in CHANNELS]) <= trim
    o = o.withColumn("_near", near).withColumn("_any", F.max(F.col("_near").cast("int")).over(w))
    o = o.where((F.col("_any") == 0) | F.col("_near"))
    mean = lambda c: F.when(F.sum("weight") > 0, F.sum(F.col("weight") * to_linear(F.col(c))) / F.sum("weight")).otherwise(F.avg(to_linear(F.col(c))))
    return o.groupBy("point_idx").agg(*[to_srgb(mean(c)).alias(c) for c in CHANNELS])


def per_camera(observations: DataFrame) -> DataFrame:
    """point_idx, camera, the colour a camera gives a point (weighted mean in linear light, as bytes) and its weight; without weight there is none."""
    mean = lambda c: to_srgb(F.sum(F.col("weight") * to_linear(F.col(c))) / F.sum("weight")).alias(c)
    return observations.where("weight > 0").groupBy("point_idx", "camera").agg(*[mean(c) for c in CHANNELS], F.sum("weight").alias("weight"))


def gains(results: DataFrame, low: float = 0.2, high: float = 5.0, least: int = 64, dark: int = 8) -> DataFrame:
    """camera and a gain in linear light for each channel: the median ratio of the first camera's colours to the camera's.

    It counts points that both see with no channel under `dark`; cameras that
    share fewer than `least` of them, and the first one, have 1.
    """
    first = results.agg(F.min("camera").alias("first"))  # one row
    lit = results.where(F.least(*CHANNELS) >= dark)
    ref = lit.join(F.broadcast(first), F.col("camera") == F.col("first")).select("point_idx", *[to_linear(F.col(c)).alias(f"_{c}") for c in CHANNELS], "first")
    both = lit.join(ref, "point_idx").where("camera <> first")
    ratio = both.groupBy("camera").agg(F.count("*").alias("n"), *[F.median(F.col(f"_{c}") / to_linear(F.col(c))).alias(c) for c in CHANNELS])
    gain = lambda c: F.when(F.col("n") >= least, F.greatest(F.lit(low), F.least(F.lit(high), F.col(c)))).otherwise(F.lit(1.0))
    found = ratio.select(F.col("camera").alias("_c"), *[gain(c).alias(f"gain_{c}") for c in CHANNELS])
    out = results.select("camera").distinct().join(found, F.col("camera") == F.col("_c"), "left")
    return out.select("camera", *[F.coalesce(f"gain_{c}", F.lit(1.0)).alias(f"gain_{c}") for c in CHANNELS])


def blended(observations: DataFrame, **options) -> DataFrame:
    """point_idx and the mean in linear light of the cameras' colours under their gains, weighted by the cameras' weights."""
    results = per_camera(observations)
    o = results.join(F.broadcast(gains(results, **options)), "camera")  # one row for each camera
    aligned = lambda c: to_srgb(to_linear(F.col(c)) * F.col(f"gain_{c}"))
    mean = lambda c: to_srgb(F.sum(F.col("weight") * to_linear(aligned(c))) / F.sum("weight"))
    return o.groupBy("point_idx").agg(*[mean(c).alias(c) for c in CHANNELS])


def best_of_bucket(frames: DataFrame) -> DataFrame:
    """The sharpest frame of each (topic, bucket), of equals the earliest; frames without a bucket all stay."""
    rest = [c for c in frames.columns if c not in ("topic", "bucket")]
    free = frames.where("bucket IS NULL").select("topic", "bucket", *rest)
    best = frames.where("bucket IS NOT NULL").groupBy("topic", "bucket").agg(F.max_by(F.struct(*rest), F.struct("score", -F.col("seq"))).alias("v")).select("topic", "bucket", "v.*")
    return best.unionByName(free)


def reservoir(observations: DataFrame, keys: list[str], order: str, size: int = 16) -> DataFrame:
    """Of each key at most `size` rows: row n (from 0, by order) takes slot n, later ones the slot that a hash of the key and n picks below n + 1, if it is below size."""
    w = Window.partitionBy(*keys).orderBy(order)
    n = observations.withColumn("_n", F.row_number().over(w) - 1)
    slot = F.when(F.col("_n") < size, F.col("_n")).otherwise(F.pmod(F.xxhash64(*keys, "_n"), F.col("_n") + 1))
    rest = observations.columns
    held = n.withColumn("_slot", slot.cast("long")).where(F.col("_slot") < size)
    return held.groupBy(*keys, "_slot").agg(F.max_by(F.struct(*rest), "_n").alias("v")).select("v.*")

