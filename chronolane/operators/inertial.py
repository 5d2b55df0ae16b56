"""Poses from inertial samples, before and after a known state.

A sample moves the state by a step that does not depend on the state itself once
it is said in the state's own frame, and such steps compose: (turn, velocity,
place, time). Steps are summed up inside stretches of time side by side, the
sums of stretches are put in a row, and each stretch adds what lies before it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

STRETCH_NS = 60 * 10**9
STATE = ("tx", "ty", "tz", "qx", "qy", "qz", "qw", "vx", "vy", "vz")
_STEP = ("dqx", "dqy", "dqz", "dqw", "dvx", "dvy", "dvz", "dpx", "dpy", "dpz", "dt")


def exp(phi: np.ndarray) -> np.ndarray:
    """Quaternions (x, y, z, w) of rotation vectors, a row each."""
    half = np.linalg.norm(phi, axis=1, keepdims=True) / 2
    return np.concatenate([phi * np.sinc(half / np.pi) / 2, np.cos(half)], axis=1)


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    v, w, x, y = a[:, :3], a[:, 3:], b[:, :3], b[:, 3:]
    return np.concatenate([w * x + y * v + np.cross(v, x), w * y - (v * x).sum(axis=1, keepdims=True)], axis=1)


def turned(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    u = 2 * np.cross(q[:, :3], v)
    return v + q[:, 3:] * u + np.cross(q[:, :3], u)


def unit(q: np.ndarray) -> np.ndarray:
    """Quaternions that are all but of length 1, at length 1: else rounding errors of the length add up over a long recording."""
    return q * (1.5 - (q * q).sum(axis=1, keepdims=True) / 2)


def composed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Steps a, then b, a row each, in the columns of _STEP."""
    q, v, p, t = a[:, :4], a[:, 4:7], a[:, 7:10], b[:, 10:]
    return np.concatenate([unit(product(q, b[:, :4])), v + turned(q, b[:, 4:7]), p + v * t + turned(q, b[:, 7:10]), a[:, 10:] + t], axis=1)


def running(steps: np.ndarray, first: np.ndarray | None = None) -> np.ndarray:
    """Each row's step with all before it, by doubling; `first` marks where to begin anew."""
    n = np.arange(len(steps))
    since = n if first is None else n - np.maximum.accumulate(np.where(first, n, 0))
    out, by = steps.copy(), 1
    while by <= since.max(initial=0):
        rows = np.nonzero(since >= by)[0]
        out[rows] = composed(out[rows - by], out[rows])
        by *= 2
    return out


def propagated(samples: DataFrame, boundary: DataFrame, gravity: tuple[float, float, float] = (0.0, 0.0, -9.80665), stretch_ns: int = STRETCH_NS) -> DataFrame:
    """topic, seq, timestamp_ns, pose and velocity at each sample, and at the boundary (seq null).

    samples: topic, seq, timestamp_ns, angular velocity wx, wy, wz and acceleration
    ax, ay, az in the sensor's frame. boundary: a row for each topic with
    timestamp_ns, the state (tx .. qw, vx, vy, vz) and the biases bwx .. bwz,
    bax .. baz. After the boundary a sample holds since the one before it, under
    the orientation at that time; before it, until the one after it, under its own
    orientation. Of equal stamps the one nearer in seq to the boundary's side
    counts (the first after it, the last before it); samples at the boundary's
    stamp, of topics without a boundary or with nulls go.

    A stretch's samples go through one task a batch at a time; a row for each stretch of a topic is in memory in another.
    """
    b = boundary.select("topic", F.col("timestamp_ns").alias("_at"), *[F.col(f"b{k}{a}").alias(f"_b{k}{a}") for k in "wa" for a in "xyz"])
    s = samples.select("topic", "seq", "timestamp_ns", *[f"{k}{a}" for k in "wa" for a in "xyz"]).dropna().join(b, "topic").where("timestamp_ns <> _at")
    s = s.select("topic", "seq", "timestamp_ns", F.signum(F.col("timestamp_ns") - F.col("_at")).cast("int").alias("way"), F.abs(F.col("timestamp_ns") - F.col("_at")).alias("tau"), *[(F.col(f"{k}{a}") - F.col(f"_b{k}{a}")).alias(f"{k}{a}") for k in "wa" for a in "xyz"])
    s = s.withColumn("part", F.floor(F.col("tau") / stretch_ns))
    order = Window.partitionBy("topic", "way").orderBy("part")  # a row for each stretch
    ends = s.groupBy("topic", "way", "part").agg(F.max("tau").alias("_last")).withColumn("since", F.coalesce(F.lag("_last").over(order), F.lit(0))).drop("_last")

    def inside(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Rows in the order of key, tau and side. What a stretch has come to is carried from batch to batch, so a stretch may be of any length."""
        last = None  # key, tau and steps of the last row
        for pdf in frames:
            if pdf.empty:
                continue
            key = list(zip(pdf["topic"], pdf["way"], pdf["part"], strict=True))
            tau = pdf["tau"].to_numpy()
            first = np.array([True] + [key[k] != key[k - 1] for k in range(1, len(key))])
            again = np.concatenate([[False], tau[1:] == tau[:-1]]) & ~first
            if last and last[0] == key[0]:
                first[0], again[0] = False, tau[0] == last[1]
            pdf, tau, first = pdf[~again], tau[~again], first[~again]
            if pdf.empty:
                continue
            before = np.concatenate([[last[1] if last else 0], tau[:-1]])
            way = pdf["way"].to_numpy()
            h = (way * (tau - np.where(first, pdf["since"].to_numpy(), before)))[:, None] / 1e9
            turn = unit(exp(pdf[["wx", "wy", "wz"]].to_numpy() * h))
            a = pdf[["ax", "ay", "az"]].to_numpy()
            a = np.where(way[:, None] > 0, a, turned(turn, a))
            steps = np.concatenate([turn, a * h, a * h * h / 2, h], axis=1)
            if not first[0]:
                steps[:1] = composed(last[2], steps[:1])
            steps = running(steps, first)
            end = pdf.iloc[-1]
            last = (end["topic"], end["way"], end["part"]), tau[-1], steps[-1:]
            out = pdf[["topic", "way", "part", "seq", "timestamp_ns", "tau"]].copy()
            out[list(_STEP)] = steps
            yield out

    numbers = ", ".join(f"{c} double" for c in _STEP)
    key = ["topic", "way", "part"]
    # by a hash: a shuffle by the join's own key would be left out, and where the join then turns into a broadcast a stretch's rows lie in many tasks
    sorted_ = s.join(ends, key).repartition(F.xxhash64(*key)).sortWithinPartitions(*key, "tau", F.col("seq") * F.col("way"))
    local = sorted_.mapInPandas(inside, f"topic string, way int, part long, seq long, timestamp_ns long, tau long, {numbers}").checkpoint()

    def in_a_row(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("part")
        steps = running(pdf[list(_STEP)].to_numpy().astype(np.longdouble)).astype(float)  # a stretch's sum is rounded once
        none = np.array([[0, 0, 0, 1.0, *[0.0] * 7]])
        out = pdf[["topic", "way", "part"]].copy()
        out[[f"_{c}" for c in _STEP]] = np.concatenate([none, steps[:-1]])
        return out

    whole = local.groupBy("topic", "way", "part").agg(F.max_by(F.struct(*_STEP), "tau").alias("v")).select("topic", "way", "part", "v.*")
    before = whole.groupBy("topic", "way").applyInPandas(in_a_row, "topic string, way int, part long, " + ", ".join(f"_{c} double" for c in _STEP))
    start = boundary.select("topic", *[F.col(c).alias(f"_0{c}") for c in STATE])
    met = local.join(before, ["topic", "way", "part"]).join(start, "topic")
    g = np.array([gravity])
    names = ["topic", "seq", "timestamp_ns"]

    def placed(frames):
        for pdf in frames:
            step = composed(pdf[[f"_{c}" for c in _STEP]].to_numpy(), pdf[list(_STEP)].to_numpy())
            state = pdf[[f"_0{c}" for c in STATE]].to_numpy()
            p, q, v = state[:, :3], state[:, 3:7], state[:, 7:]
            q = q / np.linalg.norm(q, axis=1, keepdims=True)
            t = step[:, 10:]
            out = pdf[names].copy()
            out[list(STATE)] = np.concatenate([p + v * t + turned(q, step[:, 7:10]) + g * t * t / 2, product(q, step[:, :4]), v + turned(q, step[:, 4:7]) + g * t], axis=1)
            yield out

    moved = met.select(*names, *[f"_{c}" for c in _STEP], *_STEP, *[f"_0{c}" for c in STATE]).mapInPandas(placed, "topic string, seq long, timestamp_ns long, " + ", ".join(f"{c} double" for c in STATE))
    return moved.unionByName(boundary.select("topic", F.lit(None).cast("long").alias("seq"), "timestamp_ns", *STATE))
