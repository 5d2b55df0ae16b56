"""Order within keys, without a window over a whole key.

Rows are cut into stretches of their order (an integer such as seq). Windows run
inside a stretch; what lies before it comes from a table of one row per stretch.
`placed` does without an integer: it ranges the rows over the partitions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

STRETCH = 65_536


def _with_ends(rows: DataFrame, keys: list[str], order: str, size: int, what: Column, carried) -> DataFrame:
    """The rows with `_p`, their stretch, and `_before`: what earlier stretches leave behind."""
    cut = rows.withColumn("_p", F.floor(F.col(order) / size))
    ends = cut.groupBy(*keys, "_p").agg(what.alias("_left"))
    ends = ends.withColumn("_before", carried(Window.partitionBy(*keys).orderBy("_p"))).drop("_left")
    ends = ends.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_p").alias("_kp"), "_before")
    on = [F.col("_p") == F.col("_kp"), *[F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)]]
    return cut.join(ends, on).drop("_kp", *[f"_k{i}" for i in range(len(keys))])


def numbered(rows: DataFrame, keys: list[str], order: str, name: str, size: int = STRETCH) -> DataFrame:
    """Adds `name`: the row's number within its keys by the order, from 0. The order is distinct within a key."""
    before = lambda w: F.coalesce(F.sum("_left").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    out = _with_ends(rows, keys, order, size, F.count("*"), before)
    inner = Window.partitionBy(*keys, "_p").orderBy(order)
    return out.withColumn(name, (F.col("_before") + F.row_number().over(inner) - 1).cast("long")).drop("_p", "_before")


def with_previous(rows: DataFrame, keys: list[str], order: str, column: str, name: str, size: int = STRETCH) -> DataFrame:
    """Adds `name`: the column of the row before within the keys by the order."""
    last = F.max_by(F.struct(F.col(column).alias("v")), order)
    out = _with_ends(rows, keys, order, size, last, lambda w: F.lag("_left").over(w))
    inner = Window.partitionBy(*keys, "_p").orderBy(order)
    own = F.lag(F.struct(F.col(column).alias("v"))).over(inner)
    return out.withColumn(name, F.coalesce(own, "_before")).withColumn(name, F.col(f"{name}.v")).drop("_p", "_before")


def upper_median(values: DataFrame, keys: list[str], value: str) -> DataFrame:
    """keys and median: the upper of the middle values, exactly.

    Approximate quantiles close in on it; the values below are counted and those
    between are counted by value, so no key's rows meet in one task. keys may be
    empty.
    """
    v = values.where(F.col(value).isNotNull()).select(*keys, F.col(value).alias("_v"))
    near = v.groupBy(*keys).agg(F.percentile_approx("_v", [0.4995, 0.5005], 20_000).alias("_q"), F.count("*").alias("_n"))
    near = near.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.get("_q", F.lit(0)).alias("_lo"), F.get("_q", F.lit(1)).alias("_hi"), "_n")
    if keys:
        on = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)]
        met = v.join(near, on).drop(*[f"_k{i}" for i in range(len(keys))])
    else:
        met = v.crossJoin(F.broadcast(near))  # one row
    counts = met.groupBy(*keys, "_n", F.when(F.col("_v") < F.col("_lo"), F.lit(None)).otherwise(F.col("_v")).alias("_v"), (F.col("_v") > F.col("_hi")).alias("_above"))
    counts = counts.agg(F.count("*").alias("_c")).where("NOT _above")
    upto = F.sum("_c").over(Window.partitionBy(*keys).orderBy(F.col("_v").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0))
    found = counts.withColumn("_upto", upto).where((F.col("_upto") > F.floor(F.col("_n") / 2)) & F.col("_v").isNotNull())
    return found.groupBy(*keys).agg(F.min("_v").alias("median"))


def in_time(messages: DataFrame, reserved: Column | None = None, partitions: int | None = None) -> DataFrame:
    """The messages ranged over partitions and sorted in each, so that partition after partition they are in time order.

    Of equal stamps those first that fill a reserved place (a message made later
    than it belongs), then by arrival (seq). The whole key ranges them, so a stamp
    that many share is spread, and what stands at a border is where it belongs.
    """
    after = ~F.coalesce(reserved, F.lit(False)) if reserved is not None else F.lit(True)
    by = ["timestamp_ns", "_after", "seq"]
    spark = messages.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    return messages.withColumn("_after", after).repartitionByRange(n, *by).sortWithinPartitions(*by).drop("_after")


def placed(messages: DataFrame, reserved: Column | None = None, name: str = "place") -> DataFrame:
    """Adds each message's place in time order (`in_time`), gapless from 0; it cuts the lineage by a checkpoint."""
    sorted_ = in_time(messages, reserved).withColumn("_at", F.monotonically_increasing_id()).checkpoint()
    # a row for each partition
    ends = sorted_.groupBy(F.shiftright("_at", 33).alias("_p")).agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ends = ends.select("_p", before.alias("_before"))
    out = sorted_.withColumn("_p", F.shiftright("_at", 33)).join(F.broadcast(ends), "_p")
    return out.withColumn(name, F.col("_before") + F.col("_at").bitwiseAND((1 << 33) - 1)).drop("_p", "_at", "_before")
