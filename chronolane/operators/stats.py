"""Counts, extents, rates and checks of message tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronolane.operators import order


def topic_stats(messages: DataFrame) -> DataFrame:
    """topic, n_messages and hz: messages less one over the recording's whole duration; 0 for one message or no duration."""
    per = messages.groupBy("topic").agg(F.count("*").alias("n_messages"), F.min("timestamp_ns").alias("a"), F.max("timestamp_ns").alias("b"))
    whole = per.agg(F.min("a").alias("lo"), F.max("b").alias("hi"))  # one row, from a row per topic
    out = per.crossJoin(F.broadcast(whole))
    seconds = (F.col("hi") - F.col("lo")) / 1e9
    hz = F.when((F.col("n_messages") > 1) & (seconds > 0), (F.col("n_messages") - 1) / seconds).otherwise(F.lit(0.0))
    return out.select("topic", "n_messages", hz.alias("hz"))


def merged_extent(shards: DataFrame) -> DataFrame:
    """One row of shards' rows (n, start_ns, end_ns, complete)."""
    return shards.agg(F.sum("n").alias("n_messages"), F.min("start_ns").alias("start_ns"), F.max("end_ns").alias("end_ns"), F.bool_and("complete").alias("complete"))


def gaps(messages: DataFrame) -> DataFrame:
    """Adds gap_ns: the time since the topic's message before."""
    out = order.with_previous(messages, ["topic"], "seq", "timestamp_ns", "_previous")
    return out.withColumn("gap_ns", F.col("timestamp_ns") - F.col("_previous")).drop("_previous")


def median_period(messages: DataFrame) -> DataFrame:
    """topic and period_ns: the upper median of the times between messages."""
    return order.upper_median(gaps(messages), ["topic"], "gap_ns").withColumnRenamed("median", "period_ns")


def default_tolerance(messages: DataFrame, fallback_ns: int = 50_000_000) -> DataFrame:
    """topic and tolerance_ns: half the median period, or the fallback for topics without one."""
    found = messages.select("topic").distinct().join(median_period(messages), "topic", "left")
    half = F.when(F.col("period_ns") > 0, F.floor(F.col("period_ns") / 2)).otherwise(F.lit(fallback_ns))
    return found.select("topic", half.cast("long").alias("tolerance_ns"))


def spans(messages: DataFrame) -> DataFrame:
    """topic, first_ns, last_ns (in the order of arrival) and n_messages."""
    return messages.groupBy("topic").agg(F.min_by("timestamp_ns", "seq").alias("first_ns"), F.max_by("timestamp_ns", "seq").alias("last_ns"), F.count("*").alias("n_messages"))


def frame_rate(messages: DataFrame, low: float = 1.0, high: float = 240.0, default: float = 10.0) -> DataFrame:
    """topic and the frame rate as a fraction of thousandths in lowest terms."""
    s = spans(messages)
    seconds = (F.col("last_ns") - F.col("first_ns")) / 1e9
    fps = F.when((F.col("n_messages") > 1) & (seconds > 0), F.least(F.greatest((F.col("n_messages") - 1) / seconds, F.lit(low)), F.lit(high))).otherwise(F.lit(default))
    milli = F.floor(fps * 1000 + 0.5).cast("long")
    # the greatest common divisor of milli and 1000 is a product of twos and fives
    g = F.lit(1)
    for p in (2, 5):
        g = g * F.when(F.col("milli") % p**3 == 0, p**3).when(F.col("milli") % p**2 == 0, p**2).when(F.col("milli") % p == 0, p).otherwise(1)
    out = s.select("topic", milli.alias("milli")).withColumn("g", g)
    return out.select("topic", F.expr("milli div g").alias("num"), F.expr("1000 div g").alias("den"))


def backwards(messages: DataFrame, clock: Column) -> DataFrame:
    """topic and whether its clock ever runs backwards in the order of arrival."""
    out = order.with_previous(messages.withColumn("_c", clock), ["topic"], "seq", "_c", "_previous")
    return out.groupBy("topic").agg(F.coalesce(F.bool_or(F.col("_previous") > F.col("_c")), F.lit(False)).alias("nonmonotonic"))


def ranges(points: DataFrame, columns: list[str]) -> DataFrame:
    """property, low and high over all points; 0 and 1 where there are none."""
    aggs = [f(c).alias(f"{n}_{c}") for c in columns for n, f in (("low", F.min), ("high", F.max))]
    pairs = F.array(*[F.struct(F.lit(c).alias("property"), F.coalesce(f"low_{c}", F.lit(0.0)).alias("low"), F.coalesce(f"high_{c}", F.lit(1.0)).alias("high")) for c in columns])
    return points.agg(*aggs).select(F.explode(pairs).alias("r")).select("r.*")


def counters(messages: DataFrame, flags: dict[str, Column]) -> DataFrame:
    """One row: how many messages each flag holds for."""
    return messages.agg(*[F.count_if(v).alias(k) for k, v in flags.items()])


def spacing_radius(points: DataFrame, spacing: str, low: float = 0.05, high: float = 5.0, factor: float = 4.0) -> DataFrame:
    """One row: the search radius from the upper median spacing."""
    m = order.upper_median(points, [], spacing)
    return m.select(F.least(F.greatest(F.col("median") * factor, F.lit(low)), F.lit(high)).alias("radius"))


def planar_fit(pairs: DataFrame) -> DataFrame:
    """One row: the rotation about z and the shift that best carry (ax, ay, az) to (bx, by, bz)."""
    mean = [F.avg(c).alias(f"m{c}") for c in ("ax", "ay", "az", "bx", "by", "bz")]
    # covariances, as means of products lose the digits of points far from the origin
    s = pairs.agg(*mean, *[F.covar_pop(f"a{i}", f"b{j}").alias(i + j) for i in "xy" for j in "xy"])
    s = s.withColumn("theta", F.atan2(F.col("xy") - F.col("yx"), F.col("xx") + F.col("yy")))
    c, n = F.cos("theta"), F.sin("theta")
    return s.select("theta", (F.col("mbx") - c * F.col("max") + n * F.col("may")).alias("dx"), (F.col("mby") - n * F.col("max") - c * F.col("may")).alias("dy"), (F.col("mbz") - F.col("maz")).alias("dz"))


def evenly(rows: DataFrame, keys: list[str], by: str, most: int) -> DataFrame:
    """At most `most` rows of each key, evenly spaced by rank in the order of `by` (an integer, distinct within a key), first and last kept."""
    n = rows.groupBy(*keys).agg(F.count("*").alias("_n"))
    out = order.numbered(rows, keys, by, "_r").join(n, keys)
    step = (F.col("_n") - 1) / (most - 1)
    # the position nearest to a rank names it, if rounding that position's place gives the rank
    k = F.floor(F.col("_r") / step + 0.5)
    hit = F.exists(F.array(k - 1, k, k + 1), lambda i: (i >= 0) & (i <= most - 1) & (F.floor(i * step + 0.5) == F.col("_r")))
    return out.where((F.col("_n") <= most) | hit).drop("_r", "_n")


def declared_counts(topics: DataFrame, messages: DataFrame) -> DataFrame:
    """topic and n for every declared topic, 0 where it has no messages."""
    n = messages.groupBy("topic").agg(F.count("*").alias("n"))
    return topics.select("topic").distinct().join(n, "topic", "left").select("topic", F.coalesce("n", F.lit(0)).alias("n"))


def topic_counts(messages: DataFrame, topics: list[str]) -> DataFrame:
    """topic and n_messages of the topics named; those without messages have no row."""
    return messages.where(F.col("topic").isin(*topics)).groupBy("topic").agg(F.count("*").alias("n_messages"))
