"""Online operators: grouping of several cameras' observations, keyframes, replay."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

GROUPS = "rig string, anchor_ns long, camera_id int, stamp_ns long, track_id long, u double, v double, late long"
_STATE = "rows string, late long, done long"
_COLUMNS = ["camera_id", "stamp_ns", "track_id", "u", "v"]


def ready_groups(rows: pd.DataFrame, anchor: int, period_ns: int, lag: int, cameras: int, final: bool, done: int) -> tuple[pd.DataFrame, pd.DataFrame, int, int]:
    """The groups that are complete, the rows that wait, how many were late, and the end of the last group.

    A group opens at a stamp of the anchor camera and takes all rows of
    [stamp, stamp + period). It is complete when every camera has passed its end,
    or any camera has passed it by `lag` periods, or the stream has ended. Rows
    before the next group's start that no group takes are late.
    """
    rows = rows.sort_values(["stamp_ns", "camera_id", "track_id"], kind="stable", ignore_index=True)
    old = rows["stamp_ns"] < done
    late, rows, out = int(old.sum()), rows[~old], []
    newest = rows.groupby("camera_id")["stamp_ns"].max()
    slowest = newest.min() if len(newest) >= cameras else -(2**62)
    fastest = newest.max() if len(newest) else -(2**62)
    while len(starts := rows.loc[rows["camera_id"] == anchor, "stamp_ns"]):
        begin = int(starts.min())
        end = begin + period_ns
        if not (final or slowest >= end or fastest >= end + lag * period_ns):
            break
        late += int((rows["stamp_ns"] < begin).sum())
        out.append(rows[(rows["stamp_ns"] >= begin) & (rows["stamp_ns"] < end)].assign(anchor_ns=begin))
        rows, done = rows[rows["stamp_ns"] >= end], end
    if final:
        late, rows = late + len(rows), rows[:0]
    empty = rows[:0].assign(anchor_ns=pd.Series(dtype="int64"))
    return (pd.concat(out) if out else empty), rows, late, done


def grouped(observations: DataFrame, anchor: int, period_ns: int, cameras: int, lag: int = 3, idle_ms: int = 30_000, lateness: str = "1 minute") -> DataFrame:
    """Groups of a stream of rig, camera_id, stamp_ns, track_id, u, v: one state for each rig.

    A rig that the watermark has left behind by `idle_ms` is flushed as if it had
    ended, so nothing waits for ever. `late` counts the rig's late rows so far.
    """

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        import io

        held, late, done = state.get if state.exists else ("", 0, -(2**62))
        waiting = [pd.read_json(io.StringIO(held), orient="split", precise_float=True)] if held else []
        new = [b[_COLUMNS] for b in batches] if not state.hasTimedOut else []
        rows = pd.concat([*waiting, *new]) if waiting or new else pd.DataFrame(columns=_COLUMNS)
        rows = rows.astype({"camera_id": "int64", "stamp_ns": "int64", "track_id": "int64", "u": float, "v": float})
        out, rest, n, done = ready_groups(rows, anchor, period_ns, lag, cameras, state.hasTimedOut, int(done))
        late += n
        if state.hasTimedOut:
            state.remove()
        else:
            state.update((rest.to_json(orient="split", index=False, double_precision=15) if len(rest) else "", int(late), int(done)))
            newest = int(rows["stamp_ns"].max()) // 1_000_000 if len(rows) else 0
            state.setTimeoutTimestamp(max(newest + idle_ms, state.getCurrentWatermarkMs() + 1))
        if len(out):
            yield out.assign(rig=key[0], late=late)[["rig", "anchor_ns", *_COLUMNS, "late"]]

    timed = observations.withColumn("ts", F.timestamp_micros(F.expr("stamp_ns div 1000"))).withWatermark("ts", lateness)
    return timed.groupBy("rig").applyInPandasWithState(run, GROUPS, _STATE, "append", GroupStateTimeout.EventTimeTimeout)


def replay(spark: SparkSession, path: str, schema: str, files_per_trigger: int = 1) -> DataFrame:
    """A stream of a folder of Parquet files, a few at a time."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def rates(messages: DataFrame, window: str = "1 hour", lateness: str = "10 minutes") -> DataFrame:
    """Counts for each topic and window of a message stream with a watermark on the record clock."""
    timed = messages.withColumn("ts", F.timestamp_micros(F.expr("timestamp_ns div 1000"))).withWatermark("ts", lateness)
    return timed.groupBy(F.window("ts", window), "topic").agg(F.count("*").alias("n"))


def paired(images: DataFrame, scans: DataFrame, window_ms: int, lateness: str = "1 minute") -> DataFrame:
    """Each image's stamp with that of the nearest scan within the window (of two the earlier): a stream-stream join bounded in time on both sides, then the least gap."""
    i = images.select(F.timestamp_micros(F.expr("stamp_ns div 1000")).alias("i_ts"), F.col("stamp_ns").alias("image_ns")).withWatermark("i_ts", lateness)
    s = scans.select(F.timestamp_micros(F.expr("stamp_ns div 1000")).alias("s_ts"), F.col("stamp_ns").alias("scan_ns")).withWatermark("s_ts", lateness)
    near = F.expr(f"s_ts BETWEEN i_ts - INTERVAL {window_ms} MILLISECONDS AND i_ts + INTERVAL {window_ms} MILLISECONDS")
    gap = F.col("scan_ns") - F.col("image_ns")
    best = i.join(s, near).groupBy("i_ts", "image_ns").agg(F.min_by("scan_ns", F.struct(F.abs(gap), "scan_ns")).alias("scan_ns"))
    return best.select("image_ns", "scan_ns", gap.alias("gap_ns"))
