"""Groups of messages that are put together as their last member arrives, and keyframes, as streams with state.

Both use `transformWithState`, so the session needs the RocksDB state store
(spark.sql.streaming.stateStore.providerClass). Times are event times: timers fire
when the watermark passes them, and a replay gives the same rows again.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from chronolane.operators import clouds
from chronolane.operators.keyframes import POSE, opens

#: The session's setting that these operators need: fixed values.
STATE_STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
_ASSEMBLED = [c.split()[0] for c in clouds.ASSEMBLED.split(", ")]
FRAMES = "topic string, bucket long, seq long, score double, late long"


def _timed(stream: DataFrame, lateness: str) -> DataFrame:
    return stream.withColumn("ts", F.timestamp_micros(F.expr("timestamp_ns div 1000"))).withWatermark("ts", lateness)


class _Assembler(StatefulProcessor):
    """Of each group: the payloads so far by part; when the last one wanted is there, the joined message."""

    def __init__(self, frame: str, poses: Mapping[int, Sequence[float]], patience_ms: int) -> None:
        self.frame, self.poses, self.patience_ms = frame, dict(poses), patience_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getMapState("held", "part int", "payload binary")
        self.about = handle.getValueState("about", "stamp_ns long, wanted int, left int")

    def _close(self) -> None:
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        stamp, wanted, left = self.about.get() if self.about.exists() else (0, 0, -1)
        newest = 0
        for pdf in rows:
            for part, payload, at, n, ts in pdf[["part", "payload", "stamp_ns", "wanted", "ts"]].itertuples(index=False):
                newest = max(newest, ts.value // 1_000_000)
                stamp, wanted, left = int(at), int(n), int(n) if left < 0 else left
                # a part that is here already came twice; a group that was given out takes no more
                if left and not self.held.containsKey((int(part),)):
                    self.held.updateValue((int(part),), (bytes(payload or b""),))
                    left -= 1
                    if left == 0:
                        picks = [(k[0], bytes(v[0])) for k, v in self.held.iterator()]
                        self.held.clear()
                        yield pd.DataFrame([clouds.joined(picks, key[0], stamp, wanted, self.frame, self.poses)], columns=_ASSEMBLED)
        self.about.update((stamp, wanted, left))
        self._close()
        self.handle.registerTimer(max(newest, timerValues.getCurrentWatermarkInMs()) + self.patience_ms)

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        stamp, wanted, left = self.about.get()
        self.about.clear()
        self.held.clear()
        if left:
            yield pd.DataFrame([(key[0], stamp, None, 0, wanted, [], f"{left} of {wanted} messages are missing")], columns=_ASSEMBLED)

    def close(self) -> None:
        pass


def assembled(messages: DataFrame, picks: DataFrame, frame: str, poses: Mapping[int, Sequence[float]] | None = None, patience_ms: int = 30_000, lateness: str = "10 seconds") -> DataFrame:
    """`clouds.assembled` for a stream of topic, timestamp_ns, seq, payload and a table of picks.

    A group comes out with the batch that brings its last message. A message goes
    to every group that picks it. A group still lacks messages when the watermark
    has passed its newest one by `patience_ms`: then it comes out without a payload
    and is forgotten, so state does not grow. Messages later than `lateness`, and
    those that come twice, count for nothing.
    """
    wanted = picks.groupBy("group_id").agg(F.count("*").cast("int").alias("wanted"))
    p = picks.join(wanted, "group_id").select("group_id", "stamp_ns", "part", "wanted", F.col("topic").alias("_t"), F.col("seq").alias("_s"))
    met = _timed(messages, lateness).join(p, (F.col("topic") == F.col("_t")) & (F.col("seq") == F.col("_s")))
    rows = met.select("group_id", "stamp_ns", F.col("part").cast("int").alias("part"), "wanted", "payload", "ts")
    return rows.groupBy("group_id").transformWithStateInPandas(_Assembler(frame, poses or {}, patience_ms), clouds.ASSEMBLED, "Append", "EventTime")


class _Picker(StatefulProcessor):
    """Of each topic: the anchor of its bucket and the sharpest frame of it so far."""

    def __init__(self, distance: float, angle: float, idle_ms: int) -> None:
        self.distance, self.angle, self.idle_ms = distance, angle, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.anchor = handle.getValueState("anchor", "bucket long, last long, late long, " + ", ".join(f"{c} double" for c in POSE))
        self.best = handle.getValueState("best", "seq long, score double")

    def _row(self, key: tuple, bucket: int | None, seq: int, score: float, late: int) -> tuple:
        return key[0], bucket, seq, score, late

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        new = pd.concat(list(rows)).sort_values("seq")
        bucket, last, late, *pose = self.anchor.get() if self.anchor.exists() else (-1, -(2**62), 0, *[0.0] * 7)
        best, pose, out = self.best.get() if self.best.exists() else None, np.array(pose, float), []
        for seq, score, *at in new[["seq", "score", *POSE]].itertuples(index=False):
            at = np.array(at, float)
            if seq <= last:
                late += 1
                continue
            last = int(seq)
            if np.isnan(at).any():
                out.append(self._row(key, None, last, score, late))
            elif bucket < 0 or self.distance <= 0 or opens(pose, at[None, :], self.distance, self.angle)[0]:
                if best:
                    out.append(self._row(key, bucket, *best, late))
                bucket, pose, best = bucket + 1, at, (last, float(score))
            elif best and score > best[1]:
                best = (last, float(score))
        self.anchor.update((bucket, last, int(late), *pose.tolist()))
        if best:
            self.best.update(best)
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        newest = int(new["ts"].max().value // 1_000_000)
        self.handle.registerTimer(max(newest, timerValues.getCurrentWatermarkInMs()) + self.idle_ms)
        if out:
            yield pd.DataFrame(out, columns=["topic", "bucket", "seq", "score", "late"]).astype({"bucket": "Int64"})

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        if self.best.exists():
            bucket, _, late, *_ = self.anchor.get()
            yield pd.DataFrame([self._row(key, bucket, *self.best.get(), late)], columns=["topic", "bucket", "seq", "score", "late"])
            self.best.clear()

    def close(self) -> None:
        pass


def keyframes(frames: DataFrame, distance: float, angle: float, idle_ms: int = 30_000, lateness: str = "10 seconds") -> DataFrame:
    """The sharpest frame of each bucket, of a stream of topic, timestamp_ns, seq, score and a pose.

    As `operators.keyframes` with `colour.best_of_bucket`: a bucket's frame comes
    out when the next one begins, or when the watermark has passed the topic's
    newest frame by `idle_ms`; frames without a pose come out at once. State is a
    pose and a frame for each topic. Frames are taken in the order of seq; one that
    comes after a later one of its topic only counts as late.
    """
    rows = _timed(frames, lateness).select("topic", "seq", F.col("score").cast("double").alias("score"), *[F.col(c).cast("double").alias(c) for c in POSE], "ts")
    return rows.groupBy("topic").transformWithStateInPandas(_Picker(distance, angle, idle_ms), FRAMES, "Append", "EventTime")
