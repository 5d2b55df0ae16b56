"""Joins in time: nearest, interpolated and interval joins that keep each topic in many tasks.

Neighbours in time come from windows over short stretches of time. What lies
beyond a stretch's ends (the last row before it and the first row after it) comes
from a table with one row for each stretch, so a topic's rows never meet in one
task, however long the recording.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

STRETCH_NS = 6 * 3600 * 10**9


def neighbours(left: DataFrame, right: DataFrame, columns: list[str], by: list[str] | None = None, stretch_ns: int = STRETCH_NS, strict_next: bool = False) -> DataFrame:
    """The left rows with prev and next: structs of the right's timestamp_ns, seq and columns.

    prev is the last right row at or before the left row's timestamp_ns, next the
    first one at or after it (after it only, if strict_next). Of equal stamps prev
    takes the highest seq, next the lowest.
    """
    by = by or []
    names = left.columns
    value = F.struct("timestamp_ns", "seq", *columns).alias("_v")
    part = F.floor(F.col("timestamp_ns") / stretch_ns).alias("_p")
    r = right.select(*by, part, "timestamp_ns", F.col("seq").alias("_s"), F.lit(0).alias("_q"), value, F.lit(None).cast(left.select(F.struct(*names)).schema[0].dataType).alias("_l"))
    l = left.select(*by, part, "timestamp_ns", F.lit(None).cast("long").alias("_s"), F.lit(1).alias("_q"), F.lit(None).cast(r.schema["_v"].dataType).alias("_v"), F.struct(*names).alias("_l"))  # noqa: E741
    both = r.unionByName(l)
    w = Window.partitionBy(*by, "_p")
    back = w.orderBy("timestamp_ns", "_q", "_s").rowsBetween(Window.unboundedPreceding, 0)
    q = F.col("_q").desc() if strict_next else F.col("_q")
    ahead = w.orderBy(F.col("timestamp_ns").desc(), q, F.col("_s").desc()).rowsBetween(Window.unboundedPreceding, 0)
    found = both.withColumn("_prev", F.last("_v", ignorenulls=True).over(back)).withColumn("_next", F.last("_v", ignorenulls=True).over(ahead))
    # one row for each stretch
    key = F.struct("timestamp_ns", "_s")
    ends = both.groupBy(*by, "_p").agg(F.min_by("_v", F.when(F.col("_q") == 0, key)).alias("_a"), F.max_by("_v", F.when(F.col("_q") == 0, key)).alias("_b"))
    order = Window.partitionBy(*by).orderBy("_p")
    ends = ends.select(
        *[F.col(b).alias(f"_k{i}") for i, b in enumerate(by)],
        F.col("_p").alias("_kp"),
        F.last("_b", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1)).alias("_before"),
        F.first("_a", ignorenulls=True).over(order.rowsBetween(1, Window.unboundedFollowing)).alias("_after"),
    )
    on = [F.col("_p") == F.col("_kp"), *[F.col(b).eqNullSafe(F.col(f"_k{i}")) for i, b in enumerate(by)]]
    out = found.where("_q = 1").select("_l", *by, "_p", "_prev", "_next").join(ends, on)
    return out.select("_l.*", F.coalesce("_prev", "_before").alias("prev"), F.coalesce("_next", "_after").alias("next"))


def closer() -> Column:
    """prev or next, the nearer in time; of two equally near the earlier."""
    t = F.col("timestamp_ns")
    one = F.when(F.col("next").isNull(), F.col("prev")).when(F.col("prev").isNull(), F.col("next"))
    return one.when(t - F.col("prev.timestamp_ns") <= F.col("next.timestamp_ns") - t, F.col("prev")).otherwise(F.col("next"))


def nearest(left: DataFrame, right: DataFrame, columns: list[str], by: list[str] | None = None, offset_ns: int = 0, **options) -> DataFrame:
    """The left rows with match: the right row nearest in time (of two equally near the earlier); offset_ns moves the right for matching only."""
    moved = right.withColumn("timestamp_ns", F.col("timestamp_ns") + offset_ns)
    out = neighbours(left, moved, columns, by, **options)
    return out.withColumn("match", closer()).drop("prev", "next")


def within(left: DataFrame, right: DataFrame, columns: list[str], tolerance_ns: int, by: list[str] | None = None, offset_ns: int = 0, **options) -> DataFrame:
    """As `nearest`, with match null beyond the tolerance (which itself still counts); every left row stays, repeated ones too."""
    out = nearest(left, right, columns, by, offset_ns, **options)
    return out.withColumn("match", F.when(F.abs(F.col("match.timestamp_ns") - F.col("timestamp_ns")) <= tolerance_ns, F.col("match")))


def blend(column: str) -> Column:
    """A column between prev and next by time; the end's value outside, the row's own at an exact hit."""
    a, b, t = F.col("prev.timestamp_ns"), F.col("next.timestamp_ns"), F.col("timestamp_ns")
    f = (t - a) / (b - a)
    inner = F.col(f"prev.{column}") + (F.col(f"next.{column}") - F.col(f"prev.{column}")) * f
    return F.when(F.col("prev").isNull(), F.col(f"next.{column}")).when(F.col("next").isNull() | (a == t) | (a == b), F.col(f"prev.{column}")).otherwise(inner)


def interpolated(left: DataFrame, right: DataFrame, columns: list[str], by: list[str] | None = None, extrapolate: bool = True, **options) -> DataFrame:
    """The left rows with each column of the right at their times; outside the right's span clamped, or null."""
    out = neighbours(left, right, columns, by, **options)
    inside = F.col("prev").isNotNull() & F.col("next").isNotNull()
    made = [(blend(c) if extrapolate else F.when(inside, blend(c))).alias(c) for c in columns]
    return out.select(*[c for c in left.columns if c not in columns], *made)


def interval(left: DataFrame, spans: DataFrame, name: str, by: list[str] | None = None, **options) -> DataFrame:
    """The left rows with the last span (name, start_ns, end_ns) that starts at or before them, null if it ends before them."""
    r = spans.select(*(by or []), F.col("start_ns").alias("timestamp_ns"), F.col(name).alias("seq"), "end_ns")
    out = neighbours(left, r, ["end_ns"], by, **options)
    return out.withColumn(name, F.when(F.col("timestamp_ns") <= F.col("prev.end_ns"), F.col("prev.seq"))).drop("prev", "next")


def injected(stream: DataFrame, added: DataFrame) -> DataFrame:
    """One table of both with place: added rows go before the first stream row (by seq) with a stamp no smaller than theirs.

    Sort by (place, copied, timestamp_ns, seq). A stream's row matters for this only
    where it raises the running maximum, so the search is one in time over those.
    """
    part = F.floor(F.col("seq") / 65536).alias("_p")
    per = stream.groupBy(part).agg(F.max("timestamp_ns").alias("_m"))
    up = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    per = per.select("_p", F.max("_m").over(up).alias("_base"))  # one row for every 65,536 of the stream
    w = Window.partitionBy("_p").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    lead = stream.withColumn("_p", part).join(per, "_p")
    top = F.greatest("_base", F.max("timestamp_ns").over(w))
    lead = lead.withColumn("_top", top).where(F.col("_top").isNull() | (F.col("timestamp_ns") > F.col("_top"))).select("timestamp_ns", "seq")
    placed = neighbours(added, lead, [])
    end = F.lit(2**62)
    a = placed.withColumn("place", F.coalesce("next.seq", end)).withColumn("copied", F.lit(1) * 0).drop("prev", "next")
    return stream.withColumn("place", F.col("seq")).withColumn("copied", F.lit(1)).unionByName(a)


def matched_by_clock(frames: DataFrame, clouds: DataFrame, columns: list[str], **options) -> DataFrame:
    """The frames with clock and match: by header stamps where the frame has one and every cloud has, else by the time of recording.

    Both have timestamp_ns, header_ns (0 or null: none) and seq. `match` is the
    nearest cloud in that clock, its timestamp_ns that of the clock.
    """
    lacking = clouds.where(F.coalesce("header_ns", F.lit(0)) <= 0).limit(1).select(F.lit(True).alias("_lacking"))  # one row at most
    names = frames.columns
    some = frames.join(F.broadcast(lacking), how="left")
    header = (F.coalesce("header_ns", F.lit(0)) > 0) & F.col("_lacking").isNull()
    some = some.select(F.struct(*names).alias("_f"), F.when(header, "header").otherwise("record").alias("clock"), F.when(header, F.col("header_ns")).otherwise(F.col("timestamp_ns")).alias("timestamp_ns"))
    both = clouds.select("*", F.lit("record").alias("clock")).unionByName(clouds.where("header_ns > 0").withColumn("timestamp_ns", F.col("header_ns")).withColumn("clock", F.lit("header")))
    return nearest(some, both, columns, ["clock"], **options).select("_f.*", "clock", "match")


def fetched(wanted: DataFrame, messages: DataFrame) -> DataFrame:
    """The messages recorded exactly at each wanted topic and timestamp_ns, of several the first by seq; null where there is none."""
    rest = [c for c in messages.columns if c not in ("topic", "timestamp_ns")]
    first = messages.join(wanted.select("topic", "timestamp_ns").distinct(), ["topic", "timestamp_ns"], "left_semi")
    first = first.groupBy("topic", "timestamp_ns").agg(F.min_by(F.struct(*rest), "seq").alias("found"))
    return wanted.join(first, ["topic", "timestamp_ns"], "left").select(*wanted.columns, "found")
