"""Text forms of stamps, topics, transforms and trajectories, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def whole_seconds(ns: Column) -> Column:
    return F.floor(ns.cast("decimal(20,0)") / 1_000_000_000).cast("long")


def nine_digits(ns: Column) -> Column:
    return F.lpad(F.pmod(ns, F.lit(1_000_000_000)).cast("string"), 9, "0")


def stamp(ns: Column) -> Column:
    """Nanoseconds as YYYY-MM-DD HH:MM:SS.nnnnnnnnn UTC (s.n), exact."""
    seconds, rest = whole_seconds(ns).cast("string"), nine_digits(ns)
    return F.concat(F.date_format(F.timestamp_seconds(whole_seconds(ns)), "yyyy-MM-dd HH:mm:ss"), F.lit("."), rest, F.lit(" UTC ("), seconds, F.lit("."), rest, F.lit(")"))


def file_name(topic: Column) -> Column:
    return F.replace(topic, F.lit("/"), F.lit("__"))


def names(array: Column) -> Column:
    """Names joined by commas, or (none)."""
    return F.when(F.size(array) > 0, F.array_join(array, ", ")).otherwise(F.lit("(none)"))


def camera_info_topic(topic: Column) -> Column:
    """The camera-info topic beside an image topic, raw or rectified in colour, compressed or not; null beside others."""
    stem = F.regexp_extract(topic, r"^([\s\S]*)/image_(?:raw|rect_color)(?:/compressed)?$", 1)
    return F.when(topic.rlike(r"/image_(raw|rect_color)(/compressed)?$"), F.concat(stem, F.lit("/camera_info")))


def tum_line(ns: Column, values: list[Column]) -> Column:
    """A trajectory line: seconds with nine decimals from the integer stamp, then the values with nine decimals."""
    second = F.concat(whole_seconds(ns).cast("string"), F.lit("."), nine_digits(ns))
    return F.concat_ws(" ", second, *[F.format_string("%.9f", v) for v in values])


def parse_tum(lines: DataFrame) -> DataFrame:
    """timestamp_ns, tx, ty, tz, qx, qy, qz, qw of trajectory lines (value); blank, comment and malformed lines are left out."""
    parts = F.split(F.trim("value"), r"\s+", -1)
    number = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"
    out = lines.where(~F.trim("value").startswith("#")).select(parts.alias("p")).where(F.size("p") == 8)
    out = out.where(F.col("p")[0].rlike(r"^\d{1,10}(\.\d{1,9})?$") & F.forall(F.slice("p", 2, 7), lambda x: x.rlike(number)))
    whole, rest = F.split_part(F.col("p")[0], F.lit("."), F.lit(1)), F.split_part(F.col("p")[0], F.lit("."), F.lit(2))
    ns = whole.cast("long") * 1_000_000_000 + F.rpad(rest, 9, "0").cast("long")
    return out.select(ns.alias("timestamp_ns"), *[F.col("p")[k + 1].cast("double").alias(c) for k, c in enumerate(("tx", "ty", "tz", "qx", "qy", "qz", "qw"))])
