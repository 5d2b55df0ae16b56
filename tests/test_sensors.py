"""Typed messages, inertial steps, trajectories and whole trees."""

import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronolane.functions import cdr, sensors
from chronolane.operators import frames, inertial

MESSAGES = "topic string, timestamp_ns long, seq long, payload binary"


def test_messages_compressed_one_by_one(spark):
    import zstandard

    known, unknown = (zstandard.ZstdCompressor(write_content_size=w) for w in (True, False))
    texts = [b"a" * 5000, b"b" * 300_000, b"", None, b""]
    data = [known.compress(texts[0]), unknown.compressobj().compress(b"") + b"", b"", None, known.compress(b"")]
    c = zstandard.ZstdCompressor(write_content_size=False).compressobj()
    data[1] = c.compress(texts[1]) + c.flush()
    df = spark.createDataFrame([("/t", k, k, d) for k, d in enumerate(data)], MESSAGES)
    assert [r["payload"] for r in cdr.decompressed(df).orderBy("seq").collect()] == texts
    with pytest.raises(ValueError):
        cdr.decompressed(df, "lz4")
    with pytest.raises(Exception, match="frame"):
        cdr.decompressed(spark.createDataFrame([("/t", 1, 1, b"nothing packed")], MESSAGES)).collect()


def test_only_the_named_topics_are_edited(spark):
    text = "int32 a\nstring b"
    rows = [("/x", 1, 0, cdr.encode(text, {"a": 1, "b": "q"})), ("/y", 2, 1, b"no payload")]
    df = spark.createDataFrame(rows, MESSAGES).withColumn("other", F.lit(5))
    out = cdr.edited(df, text, ["/x"], lambda m: m | {"a": m["a"] + 1}).orderBy("seq").collect()
    assert cdr.Reader(out[0]["payload"]).message(cdr.parse(text)) == {"a": 2, "b": "q"}
    assert out[1]["payload"] == b"no payload" and out[0]["other"] == 5
    with pytest.raises(ValueError):
        sensors.with_camera(df, ["/x"], {"frame": "x"})


def test_poses_and_odometry(spark):
    head = "===\nMSG: std_msgs/Header\nbuiltin_interfaces/Time stamp\nstring frame_id\n"
    geometry = "===\nMSG: geometry_msgs/Point\nfloat64 x\nfloat64 y\nfloat64 z\n===\nMSG: geometry_msgs/Quaternion\nfloat64 x\nfloat64 y\nfloat64 z\nfloat64 w\n===\nMSG: geometry_msgs/Pose\nPoint position\nQuaternion orientation\n"
    wide = "===\nMSG: geometry_msgs/PoseWithCovariance\nPose pose\nfloat64[36] covariance\n"
    pose = {"position": {"x": 1.0, "y": 2.0, "z": 3.0}, "orientation": {"x": 0.0, "y": 0.0, "z": 0.0, "w": 1.0}}
    header = {"stamp": {"sec": 2, "nanosec": 5}, "frame_id": "map"}
    forms = [
        ("std_msgs/Header header\nPose pose\n" + head + geometry, {"header": header, "pose": pose}, None, None),
        ("std_msgs/Header header\nPoseWithCovariance pose\n" + head + geometry + wide, {"header": header, "pose": {"pose": pose, "covariance": [0.5] * 36}}, None, 0.5),
        ("std_msgs/Header header\nstring child_frame_id\nPoseWithCovariance pose\n" + head + geometry + wide, {"header": header, "child_frame_id": "base", "pose": {"pose": pose, "covariance": [0.25] * 36}}, "base", 0.25),
    ]
    for text, value, child, spread in forms:
        df = spark.createDataFrame([("/p", 1, 0, cdr.encode(text, value)), ("/p", 2, 1, b"")], MESSAGES)
        decoded = cdr.decoded(df, text)
        (r,) = sensors.poses(decoded).collect()
        assert (r["stamp_ns"], r["parent"], r["child"], r["tx"], r["tz"], r["qw"]) == (2_000_000_005, "map", child, 1.0, 3.0, 1.0)
        assert (r["covariance"] and r["covariance"][35]) == spread
        assert [(u["topic"], u["n"]) for u in sensors.unreadable(decoded).collect()] == [("/p", 1)]


def test_rasters(spark):
    rows = [(1, 2, "rgb8", 8, bytes([1, 2, 3, 4, 5, 6, 0, 0])), (2, 1, "bgr8", 3, bytes(range(6))), (1, 1, "mono8", 1, b"a"), (2, 1, "bgr8", 3, b"cut"), (None, 1, "bgr8", 3, b"abc")]
    df = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "k int, height int, width int, encoding string, step int, data binary")
    assert [r["bgr"] for r in sensors.rasters(df).orderBy("k").collect()] == [bytes([3, 2, 1, 6, 5, 4]), bytes(range(6)), None, None, None]


def _matrix(phi):
    """Rodrigues' formula."""
    n = np.linalg.norm(phi)
    if n == 0:
        return np.eye(3)
    x, y, z = phi / n
    k = np.array([[0, -z, y], [z, 0, -x], [-y, x, 0]])
    return np.eye(3) + math.sin(n) * k + (1 - math.cos(n)) * k @ k


def _turn(q):
    x, y, z, w = q
    v = np.array([x, y, z])
    n = np.linalg.norm(v)
    return _matrix(v / n * 2 * math.atan2(n, w)) if n else np.eye(3)


def test_inertial_steps_against_a_walk(spark):
    rng = np.random.default_rng(3)
    gravity, bias = np.array([0.1, -0.2, -9.8]), rng.normal(size=6) / 10
    times = np.sort(rng.integers(0, 20_000_000_000, 300))
    times[50:53] = times[50]  # equal stamps on both sides
    times[200:202] = times[200]
    w, a = rng.normal(size=(300, 3)), rng.normal(size=(300, 3)) + [0, 0, 9.8]
    at = int(times[120])  # a sample at the boundary itself
    q = rng.normal(size=4)
    q /= np.linalg.norm(q)
    p0, v0 = rng.normal(size=3), rng.normal(size=3)
    want = {}
    for way in (1, -1):
        turn, p, v, t = _turn(q), p0, v0, at
        for k in range(300)[::way]:
            if (times[k] - t) * way <= 0:
                continue
            h = (times[k] - t) / 1e9
            after = turn @ _matrix((w[k] - bias[:3]) * h)
            acc = (turn if way > 0 else after) @ (a[k] - bias[3:]) + gravity
            p, v, turn, t = p + v * h + acc * h * h / 2, v + acc * h, after, times[k]
            want[k] = (p, v, turn)
    samples = spark.createDataFrame([("/imu", k, int(times[k]), *map(float, w[k]), *map(float, a[k])) for k in range(300)] + [("/imu", 999, 5, None, *[0.0] * 5), ("/none", 0, 5, *[0.0] * 6)], "topic string, seq long, timestamp_ns long, wx double, wy double, wz double, ax double, ay double, az double")
    names = [*inertial.STATE, "bwx", "bwy", "bwz", "bax", "bay", "baz"]
    boundary = spark.createDataFrame([("/imu", at, *map(float, [*p0, *q, *v0, *bias]))], "topic string, timestamp_ns long, " + ", ".join(f"{c} double" for c in names))
    for rows, stretch in ((10_000, 1_000_000_000), (7, 1_000_000_000), (3, 100_000_000_000)):  # stretches inside a batch and over many
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
        got = {r["seq"]: r for r in inertial.propagated(samples, boundary, tuple(gravity), stretch).collect()}
        assert set(got) == set(want) | {None}
        for k, (p, v, turn) in want.items():
            r = got[k]
            assert np.allclose([r["tx"], r["ty"], r["tz"]], p) and np.allclose([r["vx"], r["vy"], r["vz"]], v)
            assert np.allclose(_turn([r["qx"], r["qy"], r["qz"], r["qw"]]), turn)
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_stretches_stay_whole_when_a_join_turns_into_a_broadcast(spark):
    """At size the join with the stretches' ends is planned as a sorted one, and turned into a broadcast as it runs."""
    rows = [("/imu", k, k * 10_000_000, 0.0, 0.0, (k % 10 - 4.5) / 10, 0.001 * (k % 7), 0.0, 0.0) for k in range(1, 4001)]
    samples = spark.createDataFrame(rows, "topic string, seq long, timestamp_ns long, wx double, wy double, wz double, ax double, ay double, az double").repartition(8)
    names = [*inertial.STATE, "bwx", "bwy", "bwz", "bax", "bay", "baz"]
    boundary = spark.createDataFrame([("/imu", 0, *[0.0] * 6, 1.0, *[0.0] * 9)], "topic string, timestamp_ns long, " + ", ".join(f"{c} double" for c in names))
    conf = {"spark.sql.autoBroadcastJoinThreshold": "1000", "spark.sql.adaptive.autoBroadcastJoinThreshold": "10m", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        got = {r["seq"]: r["qz"] for r in inertial.propagated(samples, boundary, (0.0, 0.0, 0.0), 2_000_000_000).where("seq IS NOT NULL").collect()}
    finally:
        for k in conf:
            spark.conf.unset(k)
    turn = np.cumsum([r[5] * 0.01 for r in rows])
    assert np.allclose([got[r[1]] for r in rows], np.sin(turn / 2), atol=1e-12)


def test_turns_keep_their_length_over_many_steps():
    n = 200_000
    phi = np.zeros((n, 3))
    phi[:, 2] = 0.0021
    q = inertial.running(np.concatenate([inertial.exp(phi), np.zeros((n, 6)), np.full((n, 1), 0.05)], axis=1))[:, :4]
    assert np.abs((q**2).sum(axis=1) - 1).max() < 1e-14
    assert np.abs(q[:, 2] - np.sin(np.arange(1, n + 1) * np.longdouble(0.0021) / 2)).max() < 5e-13


EDGES = "topic string, parent string, child string, stamp_ns long, is_static boolean, tx double, ty double, tz double, qx double, qy double, qz double, qw double"


def test_trajectory_by_the_topics_stamps(spark):
    still = [0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 1.0]
    rows = [("/tf", "map", "base", t, False, float(t), *still[1:]) for t in (10, 20, 30)]
    rows += [("/tf", "map", "other", 25, False, *still), ("/arm", "base", "arm", 15, False, *still), ("/arm", "base", "arm", 25, False, 10.0, *still[1:]), ("/tf_static", "arm", "cam", 0, True, 1.0, *still[1:])]
    edges = spark.createDataFrame(rows, EDGES)
    got = {r["timestamp_ns"]: r["tx"] for r in frames.trajectory(edges, "/tf", "map", "cam").collect()}
    assert got == {10: None, 20: 26.0, 30: None}  # the arm is known from 15 to 25
    for topic, ref, of in (("/none", "map", "cam"), ("/tf", "arm", "cam"), ("/tf", "map", "nowhere")):
        with pytest.raises(ValueError):
            frames.trajectory(edges, topic, ref, of)


def test_edge_sets_and_whole_trees(spark):
    still = [0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 1.0]
    rows = [("/tf", "map", "base", 1, False, *still), ("/tf", "map", "base", 2, False, *still), ("/tf_static", "map", "base", 0, True, *still), ("/tf", "", "x", 1, False, *still), ("/tf", "base", "cam", 1, False, *still[:6], 2.0)]
    edges = spark.createDataFrame(rows, EDGES)
    sets = frames.edge_sets(edges)
    assert sets.count() == 3
    assert {tuple(r) for r in frames.union_tree(sets).collect()} == {("map", "base", "static"), ("base", "cam", "moving")}
    assert {tuple(r) for r in frames.tree_faults(edges).collect()} == {("empty frame", "x"), ("quaternion not of unit length", "cam")}


def test_transform_as_json(spark):
    half = math.sqrt(0.5)
    df = spark.createDataFrame([(1.0, 2.0, 3.0, 0.0, 0.0, half, half)], "tx double, ty double, tz double, qx double, qy double, qz double, qw double")
    got = json.loads(df.select(frames.transform_json("map", "cam")).first()[0])
    assert (got["of"], got["ref"], got["translation"]) == ("cam", "map", {"x": 1.0, "y": 2.0, "z": 3.0})
    assert math.isclose(got["rotation"]["rpy_deg"]["yaw"], 90.0) and math.isclose(got["rotation"]["rpy_rad"]["yaw"], math.pi / 2) and got["rotation"]["quaternion"]["w"] == half


def test_embedded_topics(spark, tmp_path):
    from chronolane.sources import recording

    recording.register(spark)
    old = spark.createDataFrame([("/x", k, k, b"x") for k in range(10)] + [("/tf", 4, 10, b"old")], "topic string, timestamp_ns long, seq long, payload binary")
    pose = "parent string, child string, stamp_ns long, seq long, tx double, ty double, tz double, qx double, qy double, qz double, qw double"
    track = spark.createDataFrame([("map", "base", t, k, float(k), 0.0, 0.0, 0.0, 0.0, 0.0, 1.0) for k, t in enumerate([3, 3, 7, 12, 1_500_000_000])], pose)
    made = sensors.moving_messages(track, "/tf")
    with pytest.raises(ValueError, match="/tf already"):
        recording.embed(old, made, str(tmp_path / "a"))
    recording.embed(old, made, str(tmp_path / "b"), replace=True)
    rows = spark.read.format("recording").load(str(tmp_path / "b")).orderBy("shard", "seq").collect()
    assert [(r["topic"], r["timestamp_ns"]) for r in rows] == [("/x", 0), ("/x", 1), ("/x", 2), ("/tf", 3), ("/tf", 3), *[("/x", t) for t in range(3, 7)], ("/tf", 7), *[("/x", t) for t in range(7, 10)], ("/tf", 12), ("/tf", 1_500_000_000)]
    back = spark.read.format("recording").load(str(tmp_path / "b")).where("topic = '/tf'")
    got = sensors.transforms(cdr.decoded(back, sensors.TF_MESSAGE)).orderBy("tx").collect()
    assert [(r["stamp_ns"], r["parent"], r["child"], r["tx"], r["is_static"]) for r in got] == [(t, "map", "base", float(k), False) for k, t in enumerate([3, 3, 7, 12, 1_500_000_000])]
    tree = sensors.static_message(track.withColumn("child", F.concat("child", F.col("seq"))), "/tf_static", 5)
    (one,) = tree.collect()
    assert (one["topic"], one["timestamp_ns"]) == ("/tf_static", 5)
    names = [r["child"] for r in sensors.transforms(cdr.decoded(tree, sensors.TF_MESSAGE)).orderBy("pos").collect()]
    assert names == [f"base{k}" for k in range(5)]
    assert sensors.static_message(track.where("false"), "/tf_static", 5).count() == 0
