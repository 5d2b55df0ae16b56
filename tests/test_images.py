"""Image kernels, lenses and discs against plain loops, and on odd images."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronolane.functions import geometry
from chronolane.operators import images, splats

R = random.Random(11)
IMAGES = "image string, height int, width int, bgr binary"


def made(h, w):
    return bytes(R.randrange(256) for _ in range(3 * h * w))


ROWS = [("a", 7, 9, made(7, 9)), ("b", 3, 3, made(3, 3)), ("thin", 2, 5, made(2, 5)), ("short", 4, 4, made(4, 3)), ("none", 4, 4, None), ("size", None, 4, made(1, 4)), ("empty", 0, 0, b""), ("dot", 1, 1, made(1, 1)), (None, 4, 6, made(4, 6))]
GOOD = {r[0]: r for r in ROWS if r[3] is not None and r[1] and len(r[3]) == 3 * r[1] * r[2]}


def value(row, u, v, c):
    return row[3][3 * (v * row[2] + u) + c]


def grey(row, u, v):
    return 0.114 * value(row, u, v, 0) + 0.587 * value(row, u, v, 1) + 0.299 * value(row, u, v, 2)


def gradient(row, u, v, kind=np.float32):
    if row[1] < 3 or row[2] < 3:
        return 0.0
    u, v = min(max(u, 1), row[2] - 2), min(max(v, 1), row[1] - 2)
    g = lambda du, dv: kind(grey(row, u + du, v + dv))
    gx = (g(1, -1) + 2 * g(1, 0) + g(1, 1)) - (g(-1, -1) + 2 * g(-1, 0) + g(-1, 1))
    gy = (g(-1, 1) + 2 * g(0, 1) + g(1, 1)) - (g(-1, -1) + 2 * g(0, -1) + g(1, -1))
    return float(abs(gx) + abs(gy))


@pytest.fixture(scope="module")
def df(spark):
    return spark.createDataFrame(ROWS, IMAGES)


def test_pixels_gradients_sharpness(df):
    got = {(r["image"], r["u"], r["v"]): (r["b"], r["g"], r["r"]) for r in images.pixels(df, "image").collect()}
    assert got == {(k, u, v): tuple(value(row, u, v, c) for c in range(3)) for k, row in GOOD.items() for v in range(row[1]) for u in range(row[2])}
    found = {(r["image"], r["u"], r["v"]): r["gradient"] for r in images.gradients(df, "image").collect()}
    assert found == {k: gradient(GOOD[k[0]], k[1], k[2]) for k in got}
    score = {r["image"]: r["s"] for r in df.select("image", images.sharpness(F.col("height"), F.col("width"), F.col("bgr")).alias("s")).collect()}
    for k, s in score.items():
        row = GOOD.get(k)
        at = [gradient(row, u, v, float) for v in range(1, row[1] - 1, 3) for u in range(1, row[2] - 1, 3)] if row else []
        assert s == pytest.approx(np.mean(at) if at else 0.0)


def test_samples_of_one_hot_image(spark, df):
    nan = float("nan")
    places = [("a", k, R.uniform(-2, 10), R.uniform(-2, 8)) for k in range(300)] + [("a", 300, nan, 1.0), ("thin", 301, 0.5, 0.5), ("none", 302, 1.0, 1.0), ("missing", 303, 1.0, 1.0), ("b", 304, 2.0, 2.0)]
    s = spark.createDataFrame(places, "image string, n int, u double, v double")
    got = {r["n"]: r for r in images.sampled(df, s, "image", linear=False, chunk=50).collect()}
    assert set(got) == set(range(303)) | {304}
    for image, n, u, v in places:
        if n not in got:
            continue
        r, row = got[n], GOOD.get(image)
        if row is None or math.isnan(u):
            assert (r["b"], r["g"], r["r"], r["gradient"]) == (0, 0, 0, 0)
            continue
        u, v = min(max(u, 0), row[2] - 1), min(max(v, 0), row[1] - 1)
        u0, v0 = int(u), int(v)
        at = [(x, y, (u - u0 if x > u0 else 1 - (u - u0)) * (v - v0 if y > v0 else 1 - (v - v0))) for x in (u0, u0 + 1) for y in (v0, v0 + 1)]
        mix = lambda f: sum(w * f(min(x, row[2] - 1), min(y, row[1] - 1)) for x, y, w in at)  # noqa: B023, E731
        assert [r["b"], r["g"], r["r"]] == pytest.approx([mix(lambda x, y, c=c: value(row, x, y, c)) for c in range(3)])
        assert r["gradient"] == pytest.approx(mix(lambda x, y: gradient(row, x, y)))


def test_straightened(df):
    camera = {"width": 18, "height": 14, "k": [18.0, 0, 9.0, 0, 18.0, 7.0, 0, 0, 1], "d": [-0.2, 0.05, 0.001, -0.002], "r": [1.0, 0, 0, 0, 1, 0, 0, 0, 1], "p": [17.0, 0, 9.0, 0, 0, 17.0, 7.0, 0, 0, 0, 1, 0]}
    got = {r["image"]: r["bgr"] for r in images.straightened(df, camera).collect()}
    assert {k for k, v in got.items() if v is None} == {"short", "none", "size", "empty"}
    for k, row in GOOD.items():
        sx, sy, out = row[2] / 18, row[1] / 14, []
        for v in range(row[1]):
            for u in range(row[2]):
                x, y = (u - 9 * sx) / (17 * sx), (v - 7 * sy) / (17 * sy)
                r2 = x * x + y * y
                f = 1 + r2 * (-0.2 + r2 * 0.05)
                mu = np.float32(18 * sx * (x * f + 2 * 0.001 * x * y - 0.002 * (r2 + 2 * x * x)) + 9 * sx)
                mv = np.float32(18 * sy * (y * f + 0.001 * (r2 + 2 * y * y) - 2 * 0.002 * x * y) + 7 * sy)
                su, sv = int(np.rint(mu * 32)), int(np.rint(mv * 32))
                for c in range(3):
                    total = 0
                    for dv in (0, 1):
                        for du in (0, 1):
                            pu, pv = (su >> 5) + du, (sv >> 5) + dv
                            if 0 <= pu < row[2] and 0 <= pv < row[1]:
                                total += ((su & 31) if du else 32 - (su & 31)) * ((sv & 31) if dv else 32 - (sv & 31)) * value(row, pu, pv, c)
                    out.append((total + 512) >> 10)
        assert list(got[k]) == out


def test_a_lens_without_distortion_changes_nothing(df):
    k = [5.0, 0, 4.0, 0, 5.0, 3.0, 0, 0, 1]
    camera = {"width": 0, "height": 0, "k": k, "d": [], "r": [float("nan")] * 9, "p": [5.0, 0, 4.0, 0, 0, 5.0, 3.0, 0, 0, 0, 1, 0]}
    got = {r["image"]: r["bgr"] for r in images.straightened(df, camera).collect()}
    assert all(bytes(got[n]) == row[3] for n, row in GOOD.items())


CAMERA = {"width": 640, "height": 480, "distortion_model": "plumb_bob", "d": [-0.3, 0.1, 0.0, 0.0, 0.0], "k": [500.0, 0, 320.0, 0, 500.0, 240.0, 0, 0, 1], "r": [0.0] * 9, "p": [0.0] * 12}


def test_projections_that_are_refused(spark):
    inf, turned = float("inf"), [0.0, -1.0, 0.0, 1.0, 0.0, 0.0, 0.0, 0.0, 1.0]
    wrong = [({"width": 0}, "size"), ({"k": [inf] * 9}, "finite"), ({"k": [0.0] * 9}, "focal"), ({"r": turned}, "stereo"), ({"r": [inf] * 9}, "stereo"), ({"p": [0.0] * 3 + [-50.0] + [0.0] * 8}, "baseline"), ({"p": [0.0] * 7 + [1.0] + [0.0] * 4}, "baseline"), ({"distortion_model": "fisheye", "d": [0.0]}, "fisheye"), ({"distortion_model": "other"}, "supported"), ({"d": [inf]}, "finite")]
    for change, says in wrong:
        p, why = images.projection_of(CAMERA | change, 0.5)
        assert p is None and says in why
    assert "alpha" in images.projection_of(CAMERA, 1.5)[1] and "alpha" in images.projection_of(CAMERA, float("nan"))[1]
    plain = [500.0, 0, 320, 0, 0, 500, 240, 0, 0, 0, 1, 0]
    for change in ({"distortion_model": ""}, {"distortion_model": None}, {"distortion_model": "none"}, {"d": []}, {"d": None}, {"d": [0.0, 0.0]}):
        assert images.projection_of(CAMERA | change, 0.5) == (plain, None)
    inner, outer = (images.projection_of(CAMERA, a)[0] for a in (0.0, 1.0))
    assert inner[0] > outer[0] > 300 and images.projection_of(CAMERA, 0.5)[0][0] == pytest.approx((inner[0] + outer[0]) / 2)
    schema = "width int, height int, distortion_model string, d array<double>, k array<double>, r array<double>, p array<double>, name string"
    real = CAMERA | {"k": list(map(float, CAMERA["k"]))}
    rows = [(*(real | c).values(), n) for n, c in (("good", {}), ("bad", {"width": 0}))]
    got = {r["name"]: r for r in images.projections(spark.createDataFrame(rows, schema), 0.0).collect()}
    assert got["good"]["projection"] == pytest.approx(inner) and got["good"]["refused"] is None and got["bad"]["projection"] is None


def test_cameras_together_as_one_by_one():
    many = [CAMERA | {"width": 300 + 7 * k, "height": 200 + 3 * k, "distortion_model": "equidistant" if k % 5 == 3 else CAMERA["distortion_model"]} for k in range(40)]
    assert images.projections_of(many, 0.25) == [images.projection_of(c, 0.25) for c in many]


def test_lens_inverse_and_fold_back(spark):
    rays = spark.createDataFrame([(k * 0.1, k * 0.05) for k in range(-40, 41)], "x double, y double")
    x, y = F.col("x"), F.col("y")
    wide = rays.select("x", "y", geometry.on_raw_image(x, y, "fisheye", [0.01, -0.002], 100.0, 100.0).alias("p"))
    back = wide.where("p IS NOT NULL").select("x", "y", geometry.equidistant_inverse(F.col("p.x"), F.col("p.y"), [0.01, -0.002]).alias("b")).collect()
    assert len(back) > 20 and all(abs(r["b"]["x"] - r["x"]) < 0.01 and abs(r["b"]["y"] - r["y"]) < 0.01 for r in back)
    got = {round(r["x"], 1): r["p"] for r in rays.select("x", geometry.on_raw_image(x, y, "plumb_bob", [-0.3], 100.0, 100.0).alias("p")).collect()}
    assert got[0.5] is not None and got[0.0]["x"] == 0.0 and got[3.9] is None and got[-3.9] is None


def test_rays_next_to_the_image_plane_as_in_sql(spark, tmp_path):
    import duckdb

    from chronolane import registry

    # far rays, where the tangent of the angle makes pixels of its last digits, and places whose rounding leaves a zero with a sign
    r = random.Random(5)
    rays = [(r.uniform(-0.4, 0.4), r.uniform(-0.4, 0.4), 10 ** r.uniform(-9, -3)) for _ in range(400)]
    rays += [(0.07509117, 0.3643301, 2.23e-06), (-1e-9, 0.1, 0.1), (0.1, -1e-9, 0.1), (1e-9, -1e-9, 0.1), (0.0, 0.0, 0.1)]
    spark.createDataFrame([(k, [*ray, 0.0], 0) for k, ray in enumerate(rays)], "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    want = {r[0]: r for r in duck.execute(registry.oracle_sql()["lens_places"]).fetchall()}
    got = {r["idx"]: (r["idx"], r["x"], r["y"], r["wide_x"]) for r in registry.queries()["lens_places"](spark, str(tmp_path)).collect()}
    assert {k: repr(r) for k, r in got.items()} == {k: repr(r) for k, r in want.items()}
    assert got[400][3] is not None and math.copysign(1, got[401][1]) == -1


def test_discs(spark):
    shape = lambda n, most=50.0, p=(0.0, 0.0, 2.0), radius=0.5: spark.range(1).select(splats.footprint(tuple(map(F.lit, p)), tuple(map(F.lit, n)), F.lit(radius), 10.0, 10.0, most).alias("s")).first()["s"]
    assert tuple(shape((0.0, 0.0, 1.0))) == pytest.approx((6.25, 0, 6.25))  # faces the camera: radius 2.5
    assert tuple(shape((1.0, 0.0, 0.0))) == pytest.approx((0, 0, 6.25))  # on edge: a line
    assert tuple(shape((0.0, 0.0, 0.0))) == tuple(shape((None, None, None))) == pytest.approx((6.25, 0, 6.25))
    assert tuple(shape((0.0, 0.0, 1.0), 1.0)) == pytest.approx((1, 0, 1))
    assert tuple(shape((0.0, 0.0, 1.0), 0.0)) == tuple(shape((0.0, 0.0, 1.0), 1.0, (0.0, 0.0, -2.0))) == tuple(shape((0.0, 0.0, 1.0), 1.0, radius=0.0)) == (0, 0, 0)
    rows = [("i", k, 0.0, 0.0, 5.0 + k % 7, 0.0, 0.0, 1.0, 0.6) for k in range(500)] + [("i", 900, 0.1, 0.1, 9.0, 0.0, 0.0, 1.0, 0.01), ("j", 901, 0.1, 0.1, 9.0, 1.0, 0.0, 0.0, 0.0)]
    p = spark.createDataFrame(rows, "image string, idx long, x double, y double, z double, nx double, ny double, nz double, radius double")
    discs = splats.projected(p, [10.0, 0, 8.0, 0, 10.0, 8.0, 0, 0, 1], 16, 16, 50.0)
    front = {(r["image"], r["pu"], r["pv"]): r["front"] for r in splats.depth_buffer(discs, ["image"], 16, 16).collect()}
    assert {k[1:] for k in front if k[0] == "i"} == {(8 + a, 8 + b) for a in (-1, 0, 1) for b in (-1, 0, 1) if abs(a) + abs(b) < 2} and all(v == 5.0 for k, v in front.items() if k[0] == "i")
    assert {k: v for k, v in front.items() if k[0] == "j"} == {("j", 8, 8): 9.0}
    assert {r["idx"] for r in splats.visible(discs, ["image"], 16, 16, 0.5).collect()} == {k for k in range(500) if k % 7 == 0} | {901}
    assert splats.depth_buffer(discs.where("false"), ["image"], 16, 16).count() == 0
