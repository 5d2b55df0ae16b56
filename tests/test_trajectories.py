"""Sampling through frames with reasons, static extrinsics, maps along trajectories, calibration files, topic choice."""

import json
import random

import pytest
from pyspark.sql import functions as F

from chronolane.operators import clouds, frames, select, stats
from chronolane.sources import calibration, files

EDGES = "topic string, parent string, child string, stamp_ns long, is_static boolean, seq long, tx double, ty double, tz double, qx double, qy double, qz double, qw double"
STILL = (0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 1.0)
POSES = "timestamp_ns long, tx double, ty double, tz double, qx double, qy double, qz double, qw double"


def _edge(parent, child, stamp, x, static=False, seq=0, topic="/tf"):
    return (topic, parent, child, stamp, static, seq, float(x), *STILL[1:])


def test_samples_and_reasons_equal_a_plain_walk(spark):
    rng = random.Random(5)
    moves = {c: sorted((t, rng.uniform(-9, 9)) for t in rng.sample(range(100), 12)) for c in ("b", "c", "x")}
    parent = {"b": "a", "c": "b", "x": "a", "y": "x"}
    rows = [_edge(parent[c], c, t, v) for c, s in moves.items() for t, v in s] + [_edge("x", "y", 3, 7, True), _edge("x", "y", 9, 8, True)]
    stamps = [*range(0, 100, 3), 42, 42, None]

    def at(child, t):
        s = moves[child]
        before, after = [e for e in s if e[0] <= t], [e for e in s if e[0] >= t]
        if not before:
            return "before the first transform"
        if not after:
            return "after the last transform"
        (t0, v0), (t1, v1) = before[-1], after[0]
        return v0 if t0 == t1 else v0 + (v1 - v0) * (t - t0) / (t1 - t0)

    want = []
    for t in stamps:
        if t is None:
            continue
        parts = [(c, at(c, t)) for c in ("c", "b", "x")]
        bad = next(((why, c) for c, why in parts if isinstance(why, str)), None)
        want.append((t, None, *bad) if bad else (t, round(parts[0][1] + parts[1][1] - parts[2][1] - 8, 6), None, None))
    asked = spark.createDataFrame([(t,) for t in stamps], "timestamp_ns long")
    got = frames.sampled(asked, spark.createDataFrame(rows, EDGES), "y", "c").select("timestamp_ns", F.round("tx", 6), "reason", "frame")
    key = lambda r: (r[0], str(r))
    assert sorted(map(tuple, got.collect()), key=key) == sorted(want, key=key)


def test_counts_of_skipped_samples(spark):
    edges = spark.createDataFrame([_edge("a", "b", t, t) for t in (10, 20)], EDGES)
    asked = spark.createDataFrame([(t,) for t in (1, 2, 15, 30)], "timestamp_ns long")
    got = {tuple(r) for r in frames.skipped(frames.sampled(asked, edges, "a", "b")).collect()}
    assert got == {("before the first transform", "b", 2, 1, 2), ("after the last transform", "b", 1, 30, 30)}
    assert frames.sampled(asked.limit(0), edges, "a", "b").count() == 0
    assert {tuple(r) for r in frames.sampled(asked, edges, "b", "b").select("tx", "qw", "reason").collect()} == {(0.0, 1.0, None)}


def test_equal_stamps_and_two_parents(spark):
    rows = [_edge("a", "b", 10, 1, seq=1), _edge("a", "b", 10, 3, seq=2), _edge("a", "b", 20, 5, seq=3), _edge("z", "b", 15, 99, seq=4)]
    asked = spark.createDataFrame([(15,)], "timestamp_ns long")
    assert frames.sampled(asked, spark.createDataFrame(rows, EDGES), "a", "b").first()["tx"] == 4.0


def test_static_extrinsic(spark):
    edges = spark.createDataFrame([_edge("base", "cam", 1, 2, True), _edge("base", "lidar", 1, 5, True), _edge("map", "base", 1, 9), _edge("other", "thing", 1, 0, True)], EDGES)
    assert frames.static_extrinsic(edges, "cam", "lidar")[:3] == (3.0, 0.0, 0.0)
    with pytest.raises(KeyError, match="map"):
        frames.static_extrinsic(edges, "map", "cam")
    with pytest.raises(ValueError):
        frames.static_extrinsic(edges, "cam", "thing")


def test_a_map_leaves_out_what_lies_outside_the_span(spark):
    track = spark.createDataFrame([(t, float(t), *STILL[1:]) for t in (10, 20)], POSES)
    pts = spark.createDataFrame([(0, 9, 0.0), (1, 10, 0.5), (2, 15, 0.5), (3, 20, 0.0), (4, 21, 0.0)], "idx int, timestamp_ns long, x double").select("idx", "timestamp_ns", "x", F.lit(0.5).alias("y"), F.lit(0.5).alias("z"))
    got = {r["vx"]: (r["n_points"], r["x"], r["first_idx"]) for r in clouds.mapped(pts, track, 5.0).collect()}
    assert got == {2: (1, 10.5, 1), 3: (1, 15.5, 2), 4: (1, 20.0, 3)}
    assert clouds.mapped(pts, track.limit(0), 5.0).count() == 0


K = [854.298157, 0.0, 320.5, 0.0, 854.25, 240.125, 0.0, 0.0, 1.0]
CALIBRATION = {"width": 640, "height": 480, "camera_name": "front: left", "distortion_model": "plumb_bob", "d": [-0.143768742681, 1e-15, 1e20], "k": K, "r": [1.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 1.0], "p": [*K[:3], 0.0, *K[3:6], 0.0, *K[6:], 0.0]}


@pytest.mark.parametrize("name", ["front: left", "plain", "yes", "12", "# no", "quote\"'\\", "über", None, ""])
def test_a_calibration_reads_back(name):
    c = CALIBRATION | {"camera_name": name}
    assert calibration.parsed(calibration.formatted(c)) == c


def _file(**changes):
    m = {"rows": 3, "cols": 3, "data": K}
    root = {"image_width": 640, "image_height": 480, "distortion_model": "plumb_bob", "distortion_coefficients": {"rows": 1, "cols": 2, "data": [0.1, 2]}, "camera_matrix": m, "rectification_matrix": m, "projection_matrix": {"rows": 3, "cols": 4, "data": [*K, 0, 0, 0]}}
    return json.dumps({k: v for k, v in (root | changes).items() if v != "gone"})


@pytest.mark.parametrize(
    ("changes", "said"),
    [
        ({"image_width": "gone"}, "image_width"),
        ({"image_height": "tall"}, "image_height"),
        ({"image_height": -1}, "image_height"),
        ({"distortion_model": "gone"}, "distortion_model"),
        ({"distortion_model": {"a": 1}}, "distortion_model"),
        ({"camera_name": [1]}, "camera_name"),
        ({"camera_matrix": "gone"}, "camera_matrix"),
        ({"camera_matrix": K}, "camera_matrix must be a mapping"),
        ({"camera_matrix": {"rows": 2, "cols": 3, "data": K}}, "2 x 3 but has 9"),
        ({"camera_matrix": {"rows": "a", "cols": 3, "data": K}}, "whole numbers"),
        ({"rectification_matrix": {"data": K[:8]}}, "must have 9 numbers, not 8"),
        ({"projection_matrix": {"data": [*K, 0, 0, "x"]}}, "no number"),
        ({"distortion_coefficients": {"data": []}}, "must have some numbers"),
    ],
)
def test_a_wrong_calibration_is_named(changes, said):
    with pytest.raises(ValueError, match=said):
        calibration.parsed(_file(**changes))


@pytest.mark.parametrize("raw", ["", "- 1", "a: [", "text"])
def test_no_mapping(raw):
    with pytest.raises(ValueError):
        calibration.parsed(raw)


def test_calibration_files(spark, tmp_path):
    kind = calibration.COLUMNS
    names = ["front/left", "front_left", "front"]
    infos = spark.createDataFrame([tuple((CALIBRATION | {"camera_name": n})[c.split()[0]] for c in kind.split(", ")) for n in names], kind.replace(", ", ","))
    assert calibration.write_calibrations(infos, str(tmp_path / "made")) == 3
    back = calibration.read_calibrations(spark, str(tmp_path / "made" / "*.yaml"))
    assert {r["camera_name"]: r["d"] for r in back.collect()} == dict.fromkeys(names, CALIBRATION["d"])
    with pytest.raises(ValueError, match="named"):
        calibration.write_calibrations(infos.unionByName(infos), str(tmp_path / "twice"))
    (tmp_path / "bad.yaml").write_text("image_width: 3\n")
    with pytest.raises(Exception, match=r"bad.yaml.*image_height"):
        calibration.read_calibrations(spark, str(tmp_path / "bad.yaml")).collect()


def test_a_static_tree_is_written_from_its_roots(spark, tmp_path):
    rows = [(0, "base", "cam"), (1, "map", "base"), (2, "base", "yes"), (3, "cam", "optical: 1"), (4, "loop", "pool"), (5, "pool", "loop")]
    edges = spark.createDataFrame([(*r, r[0] + 0.5, 1e-7, 0.0, 0.1, -0.2, 3.0) for r in rows], "seq int, parent string, child string, x double, y double, z double, roll double, pitch double, yaw double")
    calibration.write_static_tree(edges, str(tmp_path / "tree.yaml"))
    text = (tmp_path / "tree.yaml").read_text()
    assert [line for line in text.splitlines() if not line.startswith(" ")] == ["map:", "base:", "cam:", "loop:", "pool:"]
    back = files.read_static_tree(spark, str(tmp_path / "tree.yaml"))
    assert {tuple(r) for r in back.collect()} == {tuple(r)[1:] for r in edges.collect()}


def test_topic_choice(spark):
    kind = select.TRANSFORMS
    catalogue = spark.createDataFrame([("/tf", kind), ("/tf_static", kind), ("/a/tf_static", kind), ("/image", "other")], "topic string, type string")
    got = {tuple(r) for r in select.tree_topics(catalogue, ["/tf_static", "static", "dynamic"]).collect()}
    assert got == {("/tf_static", True, 0), ("/a/tf_static", True, 1), ("/tf", False, 2)}
    with pytest.raises(ValueError, match="/image, /none"):
        select.tree_topics(catalogue, ["/image", "/none", "static"])
    assert {tuple(r) for r in stats.topic_counts(catalogue.unionByName(catalogue), ["/tf", "/none"]).collect()} == {("/tf", 2)}
