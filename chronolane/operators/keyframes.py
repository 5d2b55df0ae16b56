"""Keyframes: buckets of poses, each begun by the first pose far enough from the one that began the bucket before.

Where a bucket begins depends on where the one before began, so a topic looks like
one long chain. It is cut into stretches of seq, and what a stretch does is a
function: from the pose that holds when it is entered (the anchor) to the pose that
holds when it is left. That function is worked out for those anchors only that can
come up: first, in every stretch at once, for a chain that begins with the stretch;
then, in every stretch at once, for the anchors that the stretches before were found
to hand over; and so on. Chains that share one keyframe stay together from there
on, so after a few rounds no new anchor comes up on the true path, which is then
known from its beginning; where chains never meet (poses at even steps) a stretch
is entered by each pose of a bucket once at most. Stretches that no pose of can be
far enough from an anchor, by the bounds of their places and quaternions, are passed
over at once: a rig that stands still for hours costs no rounds.

A task holds one stretch of poses, or one row for each stretch of a topic and anchor
found in it.

Defined results: a distance of 0 or less begins a bucket with every pose; an angle
of 0 or less leaves rotations out; poses with a null in them have a null bucket and
hold nothing (they are kept by `best_of_bucket`, each for itself); seq must be
distinct in a topic; no rows give no rows; a null topic counts as a topic.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronolane.operators import order

POSE = ["tx", "ty", "tz", "qx", "qy", "qz", "qw"]
_NONE = -(2**63)  # the anchor of a chain that begins with its stretch
#: Both sides of a cogroup must have columns of their own.
_own = lambda df: df.toDF(*df.columns)
_POSES = ", ".join(f"{c} double" for c in POSE)


def opens(anchor: np.ndarray, poses: np.ndarray, distance: float, angle: float) -> np.ndarray:
    """Which of the poses are far enough from the anchor."""
    d = poses[:, :3] - anchor[:3]
    out = d[:, 0] * d[:, 0] + d[:, 1] * d[:, 1] + d[:, 2] * d[:, 2] >= distance * distance
    if angle > 0:
        dot = np.abs(sum(poses[:, 3 + k] * anchor[3 + k] for k in range(4)))
        out |= 2 * np.arccos(np.minimum(dot, 1.0)) >= angle
    return out


def openings(anchor: np.ndarray | None, poses: np.ndarray, distance: float, angle: float) -> list[int]:
    """Where buckets begin; without an anchor the first pose begins one."""
    found, at, step = [], 0, 16
    if anchor is None and len(poses):
        found, at, anchor = [0], 1, poses[0]
    while at < len(poses):
        hit = opens(anchor, poses[at : at + step], distance, angle)
        if hit.any():
            at += int(hit.argmax())
            found.append(at)
            anchor, at, step = poses[at], at + 1, 16
        else:
            at, step = at + step, min(2 * step, 8192)
    return found


def may_open(anchor: np.ndarray, low: np.ndarray, high: np.ndarray, distance: float, angle: float) -> np.ndarray:
    """Which boxes of poses (by rows) may hold one that is far enough; none that does is left out."""
    far = np.maximum(np.abs(low[:, :3] - anchor[:3]), np.abs(high[:, :3] - anchor[:3]))
    out = (far * far).sum(axis=1) * (1 + 1e-9) >= distance * distance
    if angle > 0:
        a, b = low[:, 3:] * anchor[3:], high[:, 3:] * anchor[3:]
        least, most = np.minimum(a, b).sum(axis=1), np.maximum(a, b).sum(axis=1)
        dot = np.where((least <= 0) & (most >= 0), 0.0, np.minimum(np.abs(least), np.abs(most)))
        out |= 2 * np.arccos(np.minimum(dot, 1.0)) + 1e-6 >= angle
    return out


def _walks(rows: DataFrame, nodes: DataFrame, distance: float, angle: float) -> DataFrame:
    """topic, stretch, enter, leave, pose when left, n: what each anchor (enter, with its pose) becomes in its stretch, and how many buckets begin."""

    def run(key: tuple, held: pd.DataFrame, entering: pd.DataFrame) -> pd.DataFrame:
        held = held.sort_values("seq")
        poses, seqs, out = held[POSE].to_numpy(float), held["seq"].to_numpy(), []
        for enter, *pose in entering[["enter", *POSE]].itertuples(index=False) if len(held) else []:
            anchor = None if enter == _NONE else np.array(pose, float)
            found = openings(anchor, poses, distance, angle)
            leave, last = (int(seqs[found[-1]]), poses[found[-1]]) if found else (int(enter), anchor)
            out.append((*key, int(enter), leave, *last.tolist(), len(found)))
        return pd.DataFrame(out, columns=["topic", "stretch", "enter", "leave", *POSE, "n"])

    touched = rows.join(nodes.select(F.col("topic").alias("_t"), F.col("stretch").alias("_s")).distinct(), F.col("topic").eqNullSafe(F.col("_t")) & (F.col("stretch") == F.col("_s")), "left_semi")
    both = touched.groupBy("topic", "stretch").cogroup(_own(nodes).groupBy("topic", "stretch"))
    return both.applyInPandas(run, f"topic string, stretch long, enter long, leave long, {_POSES}, n long")


def _followed(boxes: DataFrame, known: DataFrame, distance: float, angle: float) -> DataFrame:
    """topic, stretch, enter, pose, base, wanted: the way through each topic's stretches, or, where it is not known to the end, the anchors to work out next."""

    def run(key: tuple, b: pd.DataFrame, k: pd.DataFrame) -> pd.DataFrame:
        b = b.sort_values("stretch")
        stretches, low, high = b["stretch"].to_numpy(), b[[f"{c}_low" for c in POSE]].to_numpy(float), b[[f"{c}_high" for c in POSE]].to_numpy(float)
        place = {s: i for i, s in enumerate(stretches.tolist())}
        ends = {(s, e): (leave, n, np.array(pose, float)) for s, e, leave, n, *pose in k[["stretch", "enter", "leave", "n", *POSE]].itertuples(index=False)}

        def target(i: int, pose: np.ndarray) -> int:
            at, step = i + 1, 64
            while at < len(stretches):
                hit = may_open(pose, low[at : at + step], high[at : at + step], distance, angle)
                if hit.any():
                    return at + int(hit.argmax())
                at, step = at + step, min(2 * step, 65_536)
            return len(stretches)

        out, i, enter, pose, base = [], 0, _NONE, np.full(len(POSE), np.nan), 0
        while i < len(stretches) and (end := ends.get((stretches[i], enter))):
            out.append((*key, stretches[i], enter, *pose, base, False))
            enter, n, pose = end
            base, upto = base + n, target(i, pose)
            out += [(*key, stretches[j], enter, *pose, base, False) for j in range(i + 1, upto)]
            i = upto
        if i < len(stretches):
            wanted = {}
            for (s, _), (leave, _, at) in ends.items():
                j = target(place[s], at)
                if j < len(stretches) and (stretches[j], leave) not in ends:
                    wanted[stretches[j], leave] = at
            out = [(*key, s, leave, *at, 0, True) for (s, leave), at in wanted.items()]
        return pd.DataFrame(out, columns=["topic", "stretch", "enter", *POSE, "base", "wanted"])

    return boxes.groupBy("topic").cogroup(_own(known).groupBy("topic")).applyInPandas(run, f"topic string, stretch long, enter long, {_POSES}, base long, wanted boolean")


def _labelled(rows: DataFrame, path: DataFrame, distance: float, angle: float) -> DataFrame:
    def run(key: tuple, held: pd.DataFrame, entering: pd.DataFrame) -> pd.DataFrame:
        held = held.sort_values("seq")
        first = entering.iloc[0]
        anchor = None if first["enter"] == _NONE else first[POSE].to_numpy(float)
        new = np.zeros(len(held), np.int64)
        new[openings(anchor, held[POSE].to_numpy(float), distance, angle)] = 1
        return held[["topic", "seq"]].assign(bucket=int(first["base"]) + np.cumsum(new) - 1)

    return rows.groupBy("topic", "stretch").cogroup(_own(path).groupBy("topic", "stretch")).applyInPandas(run, "topic string, seq long, bucket long")


def keyframes(poses: DataFrame, distance: float, angle: float, stretch: int = 65_536) -> DataFrame:
    """topic, seq and bucket of every row of topic, seq and a pose; angle in radians."""
    whole = F.lit(True)
    for c in POSE:
        whole = whole & F.col(c).isNotNull()
    rows = poses.select("topic", F.col("seq").cast("long").alias("seq"), *[F.col(c).cast("double").alias(c) for c in POSE])
    without = rows.where(~whole).select("topic", "seq", F.lit(None).cast("long").alias("bucket"))
    rows = rows.where(whole)
    if distance <= 0:
        return order.numbered(rows, ["topic"], "seq", "bucket").select("topic", "seq", "bucket").unionByName(without)
    rows = rows.withColumn("stretch", F.floor(F.col("seq") / stretch))
    bounds = [f(c).alias(f"{c}_{n}") for c in POSE for f, n in ((F.min, "low"), (F.max, "high"))]
    boxes = rows.groupBy("topic", "stretch").agg(*bounds).checkpoint()
    begun = boxes.select("topic", "stretch", F.lit(_NONE).alias("enter"), *[F.lit(None).cast("double").alias(c) for c in POSE])
    known = _walks(rows, begun, distance, angle).checkpoint()
    while True:
        ways = _followed(boxes, known, distance, angle).checkpoint()
        wanted = ways.where("wanted")
        if wanted.isEmpty():
            break
        known = known.unionByName(_walks(rows, wanted.select("topic", "stretch", "enter", *POSE), distance, angle)).checkpoint()
    return _labelled(rows, ways, distance, angle).unionByName(without)
