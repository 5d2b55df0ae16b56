"""Topic selection, renames, clocks and time windows of a message table.

A message table has topic, timestamp_ns and seq (the order of arrival), and any
other columns; header_ns, where there is one, is the capture clock.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronolane.operators import order

_UNITS = {"ns": 1, "us": 10**3, "µs": 10**3, "ms": 10**6, "s": 10**9}


def glob_pattern(glob: str) -> str:
    """A glob's regular expression: a star stands for any characters, slashes and none included."""
    return "^" + ".*".join(map(re.escape, glob.split("*"))) + "$"


def matches(topic: Column, globs: Iterable[str]) -> Column:
    out = F.lit(False)
    for g in globs:
        out = out | ((topic == g) if "*" not in g else topic.rlike(glob_pattern(g)))
    return out


def unmatched(topics: DataFrame, globs: Iterable[str]) -> DataFrame:
    """The selectors that no topic of the catalogue matches. Selectors are a few strings of a call."""
    selectors = topics.sparkSession.createDataFrame([(g, glob_pattern(g)) for g in dict.fromkeys(globs)], "selector string, pattern string")
    return selectors.join(topics.select("topic").distinct(), F.expr("topic RLIKE pattern"), "left_anti").select("selector")


def keep(messages: DataFrame, globs: Iterable[str]) -> DataFrame:
    return messages.where(matches(F.col("topic"), globs))


def drop(messages: DataFrame, globs: Iterable[str]) -> DataFrame:
    return messages.where(~matches(F.col("topic"), globs))


def rename(messages: DataFrame, topics: DataFrame, names: dict[str, str]) -> DataFrame:
    """Topics under new names; a source that is absent or a target that exists is an error."""
    known = {r["topic"] for r in topics.where(F.col("topic").isin([*names, *names.values()])).select("topic").distinct().collect()}
    for old, new in names.items():
        if not old or not new or old == new:
            raise ValueError(f"cannot rename {old!r} to {new!r}")
        if old not in known:
            raise ValueError(f"no topic {old!r}")
        if new in known:
            raise ValueError(f"topic {new!r} exists")
    if len(set(names.values())) < len(names):
        raise ValueError("two topics would get one name")
    topic = F.col("topic")
    for old, new in names.items():
        topic = F.when(F.col("topic") == old, new).otherwise(topic)
    return messages.withColumn("topic", topic)


def header_clock() -> Column:
    """The capture clock, or the record clock where a message has no stamp above zero."""
    return F.when(F.col("header_ns") > 0, F.col("header_ns")).otherwise(F.col("timestamp_ns"))


def duration_ns(text: str, bare: str | None = None) -> int:
    """Nanoseconds of a duration such as 1.5s or 20ms; bare: the unit of a number without one, if that may be."""
    m = re.fullmatch(r"\s*((?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?)\s*(ns|us|µs|ms|s)?\s*", text)
    if not m or not (m[2] or bare):
        raise ValueError(f"not a duration: {text!r}")
    return int(float(m[1]) * _UNITS[m[2] or bare] + 0.5)


def extent(messages: DataFrame, clock: Column) -> tuple[int, int]:
    """First and last clock value: two numbers."""
    r = messages.agg(F.min(clock).alias("a"), F.max(clock).alias("b")).first()
    if r["a"] is None:
        raise ValueError("the recording has no messages")
    return r["a"], r["b"]


def nth_clock(messages: DataFrame, clock: Column, n: int) -> int | None:
    """The n-th smallest clock value, from 0; by counts for each value of a coarse grid first, so that nothing is sorted whole."""
    lo, hi = extent(messages, clock)
    while True:
        width = max(1, -(-(hi - lo + 1) // 4096))
        cells = messages.where(clock.between(lo, hi)).groupBy(F.floor((clock - lo) / width).cast("long").alias("c")).count().orderBy("c").collect()
        for r in cells:  # 4,096 rows at most
            if n < r["count"]:
                break
            n -= r["count"]
        else:
            return None
        lo, hi = lo + r["c"] * width, min(hi, lo + (r["c"] + 1) * width - 1)
        if width == 1:
            return lo


def trim(messages: DataFrame, start: str | None = None, end: str | None = None, duration: str | None = None, both: str | None = None, clock: Column | None = None) -> DataFrame:
    """Messages of a window [start, end) given as offsets with a unit from the recording's start, or as counts of messages (5msg)."""
    clock = F.col("timestamp_ns") if clock is None else clock
    if sum(x is not None for x in (end, duration)) > 1 or (both is not None and any(x is not None for x in (start, end, duration))):
        raise ValueError("these bounds exclude each other")
    lo, hi = extent(messages, clock)

    def bound(text: str) -> int | None:
        m = re.fullmatch(r"\s*(\d+)msg\s*", text)
        return nth_clock(messages, clock, int(m[1])) if m else lo + duration_ns(text)

    if both is not None:
        cut = duration_ns(both)
        if 2 * cut >= hi - lo:
            raise ValueError("nothing would be left")
        return messages.where((clock >= lo + cut) & (clock < hi - cut))
    first = bound(start) if start is not None else lo
    if first is None or first > hi:
        raise ValueError("the start is past the end")
    out = messages.where(clock >= first)
    until = first + duration_ns(duration) if duration is not None else bound(end) if end is not None else None
    if until is not None:
        if until <= first:
            raise ValueError("the window is empty")
        out = out.where(clock < until)
    return out


def align(messages: DataFrame, globs: Iterable[str], clock: Column | None = None) -> DataFrame:
    """Messages from the latest first to the earliest last clock of the selected topics, both included."""
    clock = F.col("timestamp_ns") if clock is None else clock
    spans = keep(messages, globs).groupBy("topic").agg(F.min(clock).alias("a"), F.max(clock).alias("b"))
    r = spans.agg(F.max("a").alias("a"), F.min("b").alias("b")).first()
    if r["a"] is None or r["a"] > r["b"]:
        raise ValueError("the topics have no time in common")
    return messages.where(clock.between(r["a"], r["b"]))


def write_plan(topics: DataFrame, wanted: DataFrame) -> DataFrame:
    """What to do with each wanted topic (topic, type, replace): new, keep, suppress, conflict or type mismatch."""
    known = topics.select("topic", F.col("type").alias("own"), F.col("n_messages"))
    state = (
        F.when(F.col("own").isNull(), "new")
        .when(F.col("own") != F.col("type"), "type mismatch")
        .when(F.coalesce("n_messages", F.lit(0)) == 0, "keep")
        .when(F.col("replace"), "suppress")
        .otherwise("conflict")
    )
    return wanted.join(known, "topic", "left").select("topic", state.alias("action"))


def chunk_plan(messages: DataFrame, start: int, end: int, dropped: Column, renamed: Column, trusted: Column) -> DataFrame:
    """chunk and action: drop, copy or re-encode, from the flags and clocks of each chunk's messages."""
    t = F.col("timestamp_ns")
    by = messages.groupBy("chunk").agg(
        F.min(t).alias("a"), F.max(t).alias("b"), F.bool_and(dropped).alias("all_dropped"), F.bool_or(dropped | renamed).alias("touched"), F.bool_and(trusted).alias("trusted")
    )
    outside = (F.col("b") < start) | (F.col("a") >= end)
    inside = (F.col("a") >= start) & (F.col("b") < end)
    action = F.when(F.col("trusted") & (outside | F.col("all_dropped")), "drop").when(F.col("trusted") & inside & ~F.col("touched"), "copy").otherwise("re-encode")
    return by.select("chunk", action.alias("action"))


def arrival_index(messages: DataFrame) -> DataFrame:
    """Adds the message's number within its topic, from 0."""
    return order.numbered(messages, ["topic"], "seq", "topic_index")


#: The ending of a static transform topic's name, and the type of transform topics.
STATIC_ENDING, TRANSFORMS = "tf_static", "tf2_msgs/msg/TFMessage"


def tree_topics(catalogue: DataFrame, requested: list[str]) -> DataFrame:
    """topic and is_static of the transform topics (topic, type) asked for, by name, "static" or "dynamic", with the place of the first request that meets each.

    Raises where a name is no transform topic of the recording. At most as many
    rows as requests are looked at on the driver.
    """
    own = catalogue.where(F.col("type") == TRANSFORMS).select("topic", F.col("topic").endswith(STATIC_ENDING).alias("is_static")).distinct()
    names = [r for r in requested if r not in ("static", "dynamic")]
    known = {r["topic"] for r in own.where(F.col("topic").isin(*names)).select("topic").collect()} if names else set()
    if unknown := [n for n in names if n not in known]:
        raise ValueError(f"no transform topics, nor static or dynamic: {', '.join(unknown)}")
    place = F.lit(None).cast("int")
    for k, r in reversed(list(enumerate(requested))):
        meets = F.col("is_static") if r == "static" else ~F.col("is_static") if r == "dynamic" else F.col("topic") == r
        place = F.when(meets, k).otherwise(place)
    return own.withColumn("place", place).where("place IS NOT NULL")
