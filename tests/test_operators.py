"""Operators on small tables whose results are plain."""

import math
import random
from statistics import median_high

import pytest
from pyspark.sql import functions as F

from chronolane.functions import geometry as G
from chronolane.functions import text
from chronolane.operators import asof, clouds, colour, frames, order, select, spatial, stats

T0, S = 1_000_000_000, 1_000_000_000


@pytest.fixture
def bag(spark):
    rows = [("/fast", T0 + k * S, k * 2) for k in range(5)] + [("/slow", T0 + S // 2, 1), ("/slow", T0 + 5 * S // 2, 5)]
    return spark.createDataFrame(rows, "topic string, timestamp_ns long, seq long")


def stamps(df):
    return sorted(r["timestamp_ns"] for r in df.collect())


def test_trim(bag):
    assert len(stamps(select.trim(bag, start="1s", end="4s"))) == 4
    assert stamps(select.trim(bag, start="1s", duration="3s")) == stamps(select.trim(bag, start="1s", end="4s"))
    assert stamps(select.trim(bag, both="1s")) == stamps(select.trim(bag, start="1s", end="3s"))
    assert stamps(select.trim(bag, start="2msg", end="4msg")) == [T0 + S, T0 + 2 * S]
    assert min(stamps(select.align(bag, ["*"]))) == T0 + S // 2
    for bad in ({"start": "9s"}, {"start": "2s", "end": "2s"}, {"both": "2s"}, {"start": "x"}, {"end": "1s", "duration": "1s"}, {"start": "-1s"}):
        with pytest.raises(ValueError):
            select.trim(bag, **bad)


def test_empty_recording(spark, bag):
    none = bag.where("false")
    with pytest.raises(ValueError):
        select.trim(none, start="1s")
    assert stats.topic_stats(none).count() == 0


def test_rename(bag):
    assert {r[0] for r in select.rename(bag, bag, {"/fast": "/quick"}).select("topic").distinct().collect()} == {"/quick", "/slow"}
    for bad in ({"/none": "/x"}, {"/fast": "/slow"}, {"": "/x"}, {"/fast": "/fast"}):
        with pytest.raises(ValueError):
            select.rename(bag, bag, bad)


def test_globs(bag):
    assert select.keep(bag, ["/f*"]).count() == 5
    assert select.keep(bag, ["*"]).count() == 7
    assert select.keep(bag, ["/f.st"]).count() == 0
    assert [r[0] for r in select.unmatched(bag, ["/fa*", "/no"]).collect()] == ["/no"]


@pytest.mark.parametrize("seed", range(4))
def test_nearest_within_brute_force(spark, seed):
    rng = random.Random(seed)
    draw = lambda n: [rng.randrange(0, 200) for _ in range(n)]
    ref, other, offset, tolerance = draw(60) * 2, draw((0, 5, 40, 200)[seed]), rng.randrange(-9, 9), (0, 1, 4, 30)[seed]
    left = spark.createDataFrame([(t,) for t in ref], "timestamp_ns long")
    right = spark.createDataFrame([(t, k) for k, t in enumerate(other)], "timestamp_ns long, seq long")
    out = asof.within(left, right, [], tolerance, offset_ns=offset, stretch_ns=17).collect()
    moved = [t + offset for t in other]
    near = lambda t: min(((abs(m - t), m) for m in moved if abs(m - t) <= tolerance), default=(0, None))[1]
    assert sorted((r["timestamp_ns"], str(r["match"] and r["match"]["timestamp_ns"])) for r in out) == sorted((t, str(near(t))) for t in ref)


def test_nearest_duplicates(spark):
    left = spark.createDataFrame([(100, 0)], "timestamp_ns long, seq long")
    right = spark.createDataFrame([(90, 1), (90, 2), (130, 3), (130, 4)], "timestamp_ns long, seq long")
    assert asof.nearest(left, right, []).first()["match"]["seq"] == 2
    assert asof.nearest(left.withColumn("timestamp_ns", F.lit(125)), right, []).first()["match"]["seq"] == 3


def test_neighbours_across_stretches(spark):
    left = spark.createDataFrame([(k * 10 + 5, k, "ab"[k % 2]) for k in range(200)], "timestamp_ns long, seq long, g string")
    right = spark.createDataFrame([(k * 97, k, "ab"[k % 3 % 2], float(k)) for k in range(20)], "timestamp_ns long, seq long, g string, v double")
    rows = right.collect()
    for r in asof.neighbours(left, right, ["v"], ["g"], stretch_ns=50).collect():
        own = [x for x in rows if x["g"] == r["g"]]
        before = max((x["timestamp_ns"] for x in own if x["timestamp_ns"] <= r["timestamp_ns"]), default=None)
        after = min((x["timestamp_ns"] for x in own if x["timestamp_ns"] >= r["timestamp_ns"]), default=None)
        assert (r["prev"] and r["prev"]["timestamp_ns"]) == before
        assert (r["next"] and r["next"]["timestamp_ns"]) == after


def test_quaternions(spark):
    one = spark.range(1)
    q = G.from_rpy(F.lit(0.1), F.lit(-0.4), F.lit(2.0))
    assert [round(v, 9) for v in one.select(*G.to_rpy(q)).first()] == [0.1, -0.4, 2.0]
    assert list(one.select(*G.to_rpy((F.lit(0.0),) * 4)).first()) == [0.0, 0.0, 0.0]
    a, b = (0.0, 0.0, 0.0, 1.0), (0.0, 0.0, math.sin(math.pi / 4), math.cos(math.pi / 4))
    half = one.select(*G.slerp(tuple(map(F.lit, a)), tuple(map(F.lit, b)), F.lit(0.5))).first()
    assert half[2] == pytest.approx(math.sin(math.pi / 8))
    back = G.compose(*G.inverse((F.lit(1.0), F.lit(2.0), F.lit(3.0)), q), (F.lit(1.0), F.lit(2.0), F.lit(3.0)), q)
    assert [abs(round(v, 9)) for v in one.select(*back[0]).first()] == [0, 0, 0]


def test_distortion_round_trip(spark):
    d = [-0.2, 0.05, 0.001, -0.002, 0.01]
    x, y = G.plumb_bob(F.lit(0.3), F.lit(-0.2), d)
    r = spark.range(1).select(G.undistorted(x, y, d, 40).alias("p")).first()["p"]
    assert (r["x"], r["y"]) == (pytest.approx(0.3, abs=1e-8), pytest.approx(-0.2, abs=1e-8))


def test_enu(spark):
    e, n, u = spark.range(1).select(*G.to_enu(F.lit(48.001), F.lit(11.0), F.lit(510.0), 48.0, 11.0, 500.0)).first()
    assert (e, n, u) == (pytest.approx(0, abs=1e-6), pytest.approx(111.2, abs=0.1), pytest.approx(10, abs=0.01))


def test_frames(spark):
    ident = (0.0, 0.0, 0.0, 1.0)
    rows = [("map", "base", False, 0, 0.0, 0.0, 0.0, *ident), ("map", "base", False, 100, 10.0, 0.0, 0.0, *ident), ("base", "cam", True, 0, 0.0, 1.0, 0.0, *ident), ("base", "lidar", True, 0, 0.0, 0.0, 2.0, *ident)]
    edges = spark.createDataFrame(rows, "parent string, child string, is_static boolean, stamp_ns long, tx double, ty double, tz double, qx double, qy double, qz double, qw double")
    assert frames.path_between(edges, "cam", "lidar") == (["lidar", "base"], ["cam", "base"])
    at = spark.createDataFrame([(50,), (500,)], "timestamp_ns long")
    (r,) = frames.looked_up(at, edges, "map", "cam").collect()
    assert (r["timestamp_ns"], r["tx"], r["ty"]) == (50, 5.0, 1.0)
    r = frames.looked_up(at, edges, "cam", "lidar").orderBy("timestamp_ns").first()
    assert (r["tx"], r["ty"], r["tz"]) == (0.0, -1.0, 2.0)
    with pytest.raises(ValueError):
        frames.path_between(edges, "cam", "nowhere")
    bad = edges.withColumn("qw", F.when(F.col("child") == "cam", 0.0).otherwise(F.col("qw"))).withColumn("tx", F.when(F.col("child") == "lidar", float("nan")).otherwise(F.col("tx")))
    assert {r["child"]: r["fault"] for r in frames.bad_values(bad).collect()} == {"cam": "zero quaternion", "lidar": "not finite"}


def test_knn_reaches_far(spark):
    p = spark.createDataFrame([(k, float(k * k), 0.0, 0.0) for k in range(8)], "idx long, x double, y double, z double")
    got = {(r["idx"], r["rank"]): r["other"] for r in spatial.nearest(p, p, 3, 0.5).collect()}
    assert got[7, 2] == 6 and got[7, 3] == 5 and got[0, 3] == 2 and len(got) == 24


def test_free_voxels(spark):
    r = spark.createDataFrame([(0.1, 0.1, 0.1, 3.5, 0.1, 0.1)], "ox double, oy double, oz double, x double, y double, z double")
    assert sorted(tuple(v) for v in spatial.free_voxels(r, 1.0).collect()) == [(0, 0, 0), (1, 0, 0), (2, 0, 0)]


def test_tum(spark):
    lines = spark.createDataFrame([("1700000000.5 1 2 3 0 0 0 1",), ("7 1 2 3 0 0 0 1",), ("1700000000.123456789 1e-3 2 3 0 0 0 1",), ("",), ("# x",), ("1e9 0 0 0 0 0 0 1",), ("1 2 3",)], "value string")
    assert stamps(text.parse_tum(lines)) == [7_000_000_000, 1_700_000_000_123_456_789, 1_700_000_000_500_000_000]


def test_deskew_moves_late_points(spark):
    ident = (0.0, 0.0, 0.0, 1.0)
    traj = spark.createDataFrame([(0, 0.0, 0.0, 0.0, *ident), (10 * S, 10.0, 0.0, 0.0, *ident)], "timestamp_ns long, tx double, ty double, tz double, qx double, qy double, qz double, qw double")
    pts = spark.createDataFrame([(0, S, 0, 1.0, 0.0, 0.0, None, 0.0), (0, S, 1, 1.0, 0.0, 0.0, None, 0.5), (0, S, 2, float("nan"), 0.0, 0.0, None, 0.5)], "cloud_seq long, header_stamp_ns long, point_idx long, x double, y double, z double, intensity double, t double")
    got = {r["point_idx"]: r["x"] for r in clouds.deskewed(pts, traj).collect()}
    assert got[0] == pytest.approx(1.0) and got[1] == pytest.approx(1.5) and math.isnan(got[2])


def test_deep_chains_are_walked_whole(spark):
    chain = [(f"f{k}", f"f{k + 1}") for k in range(70)] + [("f3", "side/a"), ("side/a", "a")]
    df = spark.createDataFrame(chain, "parent string, child string")
    got = {r["descendant"]: r for r in frames.closure(df).collect()}
    assert len(got) == 73 and all(got[f"f{k}"]["depth"] == k and got[f"f{k}"]["path"] == "/".join(f"f{j}" for j in range(k + 1)) for k in range(71))
    assert got["a"]["path"] == "f0/f1/f2/f3/side/a/a"
    assert frames.forest_faults(df).count() == 0
    cycle = spark.createDataFrame([*chain, ("x", "y"), ("y", "z"), ("z", "x")], "parent string, child string")
    assert sorted(r["frame"] for r in frames.forest_faults(cycle).collect()) == ["x", "y", "z"]
    assert frames.path_between(df, "f35", "a") == (["a", "side/a", "f3"], [f"f{k}" for k in range(35, 2, -1)])


@pytest.mark.parametrize("size", [1, 7, 10_000])
def test_order_in_stretches(spark, size):
    rng = random.Random(size)
    rows = [(rng.choice("abc"), s, rng.randrange(9)) for s in rng.sample(range(-50, 4000), 300)] + [(None, 5, 1), (None, 9, 2)]
    df = spark.createDataFrame(rows, "topic string, seq long, v int")
    by = {}
    for t, s, v in sorted(rows, key=lambda r: r[1]):
        by.setdefault(t, []).append((s, v))
    got = {(r["topic"], r["seq"]): r["n"] for r in order.numbered(df, ["topic"], "seq", "n", size).collect()}
    assert got == {(t, s): k for t, own in by.items() for k, (s, _) in enumerate(own)}
    got = {(r["topic"], r["seq"]): r["b"] for r in order.with_previous(df, ["topic"], "seq", "v", "b", size).collect()}
    assert got == {(t, s): own[k - 1][1] if k else None for t, own in by.items() for k, (s, _) in enumerate(own)}


def test_upper_median(spark):
    rng = random.Random(5)
    rows = [("ties", 3.0)] * 500 + [("ties", 4.0)] * 501 + [("two", 1.0), ("two", 9.0), ("none", None), (None, 2.0)] + [("many", rng.gauss(0, 9)) for _ in range(5000)] + [("tail", 10.0**k) for k in range(40)]
    df = spark.createDataFrame(rows, "k string, v double")
    own = {}
    for k, v in rows:
        if v is not None:
            own.setdefault(k, []).append(v)
    assert {r["k"]: r["median"] for r in order.upper_median(df, ["k"], "v").collect()} == {k: median_high(v) for k, v in own.items()}
    assert order.upper_median(df, [], "v").first()["median"] == median_high([v for _, v in rows if v is not None])
    assert order.upper_median(df.where("false"), ["k"], "v").count() == 0


def test_names_of_files_and_topics(spark):
    topics = ["/cam/image_raw", "/cam/image_raw/compressed", "/a/b/image_rect_color", "/image_rect_color/compressed", "/cam/image", "/cam/image_mono", "cam", "/x/image_raw/other"]
    df = spark.createDataFrame([(t,) for t in topics], "topic string")
    got = {r["topic"]: (r["f"], r["i"]) for r in df.select("topic", text.file_name(F.col("topic")).alias("f"), text.camera_info_topic(F.col("topic")).alias("i")).collect()}
    assert {t: i for t, (_, i) in got.items()} == dict(zip(topics, ["/cam/camera_info", "/cam/camera_info", "/a/b/camera_info", "/camera_info", None, None, None, None], strict=True))
    assert got["/a/b/image_rect_color"][0] == "__a__b__image_rect_color" and got["cam"][0] == "cam"


def test_nearest_points_without_all_pairs(spark, monkeypatch):
    """Many small leaves, crowded places, a far point and a row of points: as brute force, and never all pairs within a radius."""
    def refused(*_):
        raise AssertionError("all pairs within a radius")

    monkeypatch.setattr(spatial, "within", refused)
    monkeypatch.setattr(spatial, "LEAF", 20)
    monkeypatch.setattr(spatial, "SEARCHING", 50)
    rng = random.Random(5)
    at = [tuple(rng.gauss(0, 1) for _ in range(3)) for _ in range(250)] + [tuple(rng.gauss(9, 0.001) for _ in range(3)) for _ in range(100)]
    at += [(0.5, 0.5, 0.5)] * 60 + [(float(k), 0.0, 0.0) for k in range(60)] + [(1e9, -1e9, 0.0)]
    rows = [(k, *p) for k, p in enumerate(at)]
    p = spark.createDataFrame(rows, "idx long, x double, y double, z double")
    known = rows[::4]
    d2 = lambda a, b: (a[1] - b[1]) * (a[1] - b[1]) + (a[2] - b[2]) * (a[2] - b[2]) + (a[3] - b[3]) * (a[3] - b[3])
    got = {(r["idx"], r["rank"]): r["other"] for r in spatial.nearest(p, p, 4, 1.0).collect()}
    assert got == {(a[0], n + 1): b for a in rows for n, (_, b) in enumerate(sorted((d2(a, b), b[0]) for b in rows)[:4])}
    got = {r["idx"]: r["label"] for r in spatial.propagated(p, p.where("idx % 4 = 0").withColumn("label", F.col("idx") * 10), ["label"], 1.0).collect()}
    best = {a[0]: min((d2(a, b), b[0]) for b in known) for a in rows}
    assert got == {k: b * 10 if d <= 1 else None for k, (d, b) in best.items()}


def test_durations_need_a_unit(bag):
    assert select.duration_ns("1.5e3ms") == 1_500_000_000 and select.duration_ns(".5s") == 500_000_000
    for bad in ("864000", "1e3", "1 h", "e3s"):
        with pytest.raises(ValueError):
            select.trim(bag, end=bad)


def test_observation_weight(spark):
    c = lambda n: F.col(n)
    df = spark.createDataFrame([(2.0, -0.5, 30.0, 5.0), (20.0, None, 10.0, 50.0), (20.0, 1.0, 10.0, -3.0)], "z double, i double, g double, b double")
    got = [r[0] for r in df.select(G.observation_weight(c("z"), c("i"), c("g"), c("b"), 10.0, 10.0, 10.0)).collect()]
    assert got == pytest.approx([1.0 * 0.5 * 0.75 * 0.5, 0.25 * 1.0 * 0.5 * 1.0, 0.0])
    assert df.select(G.observation_weight(c("z"), F.lit(1.0), c("g"), c("b"), 10.0, 0.0, 0.0)).first()[0] == 1.0


def test_equal_luminance_goes_by_camera(spark):
    """Both colours come to 22,386 thousandths, which sums of fractions tell apart."""
    rows = [(1, 1, 0, 60, 0, 39, 1.0), (1, 0, 1, 0, 36, 11, 1.0)]
    df = spark.createDataFrame(rows, "point_idx int, camera int, image_seq long, r long, g long, b long, weight double")
    assert colour.robust(df).select("r", "g", "b").first() == (60, 0, 39)


def test_gains_against_the_first_camera(spark):
    rows = [(p, k, 2 * v if k else v, v, v, 1.0) for p in range(100) for k, v in ((0, 40 + p), (1, 40 + p))]
    rows += [(p, 2, 200, 200, 200, 1.0) for p in range(10)] + [(500, 1, 100, 100, 100, 2.0), (501, 1, 7, 7, 7, 0.0)]
    df = spark.createDataFrame(rows, "point_idx int, camera int, r int, g int, b int, weight double")
    got = {r["camera"]: r for r in colour.gains(colour.per_camera(df)).collect()}
    assert got[0]["gain_r"] == got[2]["gain_r"] == got[1]["gain_g"] == 1.0 and 0.2 < got[1]["gain_r"] < 0.3
    out = {r["point_idx"]: r for r in colour.blended(df).collect()}
    assert 501 not in out and abs(out[50]["r"] - 90) <= 2 and out[500]["g"] == 100


def test_stamped_skips_times_that_are_not_finite(spark):
    rows = [(1, 10, 0.5), (1, 10, float("nan")), (1, 10, None), (2, 10, 2e6), (2, 10, float("nan")), (3, 10, float("nan"))]
    df = spark.createDataFrame(rows, "cloud_seq long, header_stamp_ns long, t double")
    got = [r["timestamp_ns"] for r in clouds.stamped(df).where("t IS NOT NULL AND NOT isnan(t)").orderBy("cloud_seq").collect()]
    assert sorted(got) == [500_000_010, 2_000_000_000_000_000]


def test_pairs_are_the_nearest(spark):
    from chronolane.streaming import grouping

    make = lambda v: spark.createDataFrame([(t * 10**6,) for t in v], "stamp_ns long")
    got = grouping.paired(make([1000, 2000, 9000]), make([900, 990, 1010, 2040, 5000]), 50).collect()
    assert sorted((r["image_ns"] // 10**6, r["scan_ns"] // 10**6) for r in got) == [(1000, 990), (2000, 2040)]
