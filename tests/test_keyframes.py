"""Keyframes over many tasks against a plain walk."""

import math
import random

import pytest

from chronolane.operators import colour, keyframes, stats

SCHEMA = "topic string, seq long, tx double, ty double, tz double, qx double, qy double, qz double, qw double, score double"


def plain(rows, distance, angle):
    out, anchors = {}, {}
    for topic, seq, *pose, _ in sorted(rows, key=lambda r: r[1]):
        if None in pose:
            out[topic, seq] = None
            continue
        anchor, bucket = anchors.get(topic, (None, -1))
        if anchor is None or distance <= 0:
            opened = True
        else:
            opened = sum((a - b) ** 2 for a, b in zip(pose[:3], anchor[:3], strict=True)) >= distance * distance
            dot = min(1.0, abs(sum(a * b for a, b in zip(pose[3:], anchor[3:], strict=True))))
            opened = opened or (angle > 0 and 2 * math.acos(dot) >= angle)
        if opened:
            anchor, bucket = pose, bucket + 1
        anchors[topic] = anchor, bucket
        out[topic, seq] = bucket
    return out


def turned(a):
    return 0.0, 0.0, math.sin(a / 2), math.cos(a / 2)


def made(seed):
    r = random.Random(seed)
    rows, x, a = [], 0.0, 0.0
    for k in range(900):  # a walk that rests and turns
        x += 0.0 if 300 < k < 600 else r.uniform(-1, 1.4)
        a += r.uniform(-0.2, 0.25) if k % 100 > 80 else 0.0
        q = turned(a)
        rows.append(("/walk", 3 * k + k % 2, x, r.uniform(-0.1, 0.1), 0.0, *(tuple(-c for c in q) if k % 7 == 0 else q), r.choice([1.0, 2.0, 3.0])))
    rows += [(None, k, k * 0.25, 0.0, 0.0, 0.0, 0.0, 0.0, 1.0, 1.0) for k in range(500)]  # even steps
    rows += [("/still", k, 1.0, 2.0, 3.0, 0.0, 0.0, 0.0, 1.0, 1.0) for k in range(400)]
    rows += [("/late", k, 0.0 if k < 390 else 9.0, 0.0, 0.0, 0.0, 0.0, 0.0, 1.0, 1.0) for k in range(400)]
    rows += [("/walk", 100_000 + k, None, 0.0, 0.0, 0.0, 0.0, 0.0, 1.0, 1.0) for k in range(3)]
    return rows


@pytest.mark.parametrize(("distance", "angle", "stretch"), [(2.0, 0.3, 16), (2.0, 0.0, 50), (1e9, 0.2, 16), (0.0, 0.3, 16), (2.0, 0.3, 1 << 16)])
def test_keyframes(spark, distance, angle, stretch):
    rows = made(1)
    got = keyframes.keyframes(spark.createDataFrame(rows, SCHEMA), distance, angle, stretch).collect()
    assert {(r["topic"], r["seq"]): r["bucket"] for r in got} == plain(rows, distance, angle)
    assert len(got) == len(rows)


def test_no_poses(spark):
    assert keyframes.keyframes(spark.createDataFrame([], SCHEMA), 1.0, 1.0).count() == 0


def test_best_of_bucket(spark):
    rows = made(2)
    df = spark.createDataFrame(rows, SCHEMA)
    found = plain(rows, 2.0, 0.3)
    best, free = {}, 0
    for topic, seq, *_, score in sorted(rows, key=lambda r: r[1]):
        b = found[topic, seq]
        free += b is None
        if b is not None and (topic, b) not in best or b is not None and score > best[topic, b][0]:
            best[topic, b] = (score, seq)
    b = keyframes.keyframes(df, 2.0, 0.3, 32).withColumnRenamed("topic", "t").withColumnRenamed("seq", "s")
    both = df.join(b, df["topic"].eqNullSafe(b["t"]) & (df["seq"] == b["s"])).select("topic", "bucket", "seq", "score")
    got = colour.best_of_bucket(both).collect()
    assert {(r["topic"], r["bucket"]): (r["score"], r["seq"]) for r in got if r["bucket"] is not None} == best
    assert sum(r["bucket"] is None for r in got) == free == 3


def test_planar_fit_far_from_the_origin(spark):
    r = random.Random(5)
    c, s = math.cos(0.9273), math.sin(0.9273)
    rows = []
    for _ in range(200):
        x, y = 5e6 + r.uniform(-50, 50), 4e6 + r.uniform(-50, 50)
        rows.append((x, y, 1.0, c * x - s * y + 7, s * x + c * y - 3, 1.5))
    got = stats.planar_fit(spark.createDataFrame(rows, "ax double, ay double, az double, bx double, by double, bz double")).first()
    assert abs(got["theta"] - 0.9273) < 1e-8 and abs(got["dx"] - 7) < 0.05 and abs(got["dy"] + 3) < 0.05 and abs(got["dz"] - 0.5) < 1e-9
