"""Queries over rasters, lenses and discs made from the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronolane.functions import geometry
from chronolane.operators import images, splats
from chronolane.plans.recording import P, points, query

_WIDTH = 21


def rasters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """image, height, width, bgr: every ten embeddings are the rows of an image, their numbers the bytes of 21 pixels."""
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    byte = lambda x: F.lpad(F.hex(F.floor(F.abs(x.cast("double") * 1000)) % 256), 2, "0")
    row = F.array_join(F.transform(F.slice("embedding", 1, 3 * _WIDTH), byte), "")
    rows = e.select(F.floor(F.col("vec_id") / 10).alias("image"), F.struct("vec_id", row.alias("row")).alias("r"))
    made = rows.groupBy("image").agg(F.sort_array(F.collect_list("r")).alias("r"))
    return made.select("image", F.size("r").alias("height"), F.lit(_WIDTH).alias("width"), F.unhex(F.array_join(F.transform("r", lambda x: x["row"]), "")).alias("bgr"))


_X = (
    "v AS (SELECT vec_id // 10 AS image, row_number() OVER (PARTITION BY vec_id // 10 ORDER BY vec_id) - 1 AS v, embedding AS e FROM embeddings), "
    "h AS (SELECT image, count(*) AS height FROM v GROUP BY image), "
    f"px AS (SELECT image, u, v, " + ", ".join(f"floor(abs(e[3 * u + {k}]::DOUBLE * 1000))::BIGINT % 256 AS {c}" for k, c in ((1, "b"), (2, "g"), (3, "r"))) + f" FROM v, (SELECT unnest(range({_WIDTH})) AS u))"
)
_GREY = "0.114::DOUBLE * b + 0.587::DOUBLE * g + 0.299::DOUBLE * r"


def _sobel(kind: str) -> str:
    """gx and gy of the pixels inside, from grey values of the kind."""
    at = {(du, dv): f"max(CASE WHEN n.u = p.u + {du} AND n.v = p.v + {dv} THEN n.l END)" for du in (-1, 0, 1) for dv in (-1, 0, 1)}
    two = f"2::{kind}"
    gx = f"({at[1, -1]} + {two} * {at[1, 0]} + {at[1, 1]}) - ({at[-1, -1]} + {two} * {at[-1, 0]} + {at[-1, 1]})"
    gy = f"({at[-1, 1]} + {two} * {at[0, 1]} + {at[1, 1]}) - ({at[-1, -1]} + {two} * {at[0, -1]} + {at[1, -1]})"
    return f"l AS (SELECT image, u, v, ({_GREY})::{kind} AS l FROM px), s AS (SELECT p.image, p.u, p.v, abs({gx}) + abs({gy}) AS s FROM l p JOIN h USING (image) JOIN l n ON n.image = p.image AND abs(n.u - p.u) <= 1 AND abs(n.v - p.v) <= 1 WHERE p.u BETWEEN 1 AND {_WIDTH - 2} AND p.v BETWEEN 1 AND height - 2 GROUP BY p.image, p.u, p.v)"


_EDGE = f"f AS (SELECT px.image, px.u, px.v, coalesce(s.s, 0)::DOUBLE AS gradient FROM px JOIN h USING (image) LEFT JOIN s ON s.image = px.image AND s.u = greatest(1, least(px.u, {_WIDTH - 2})) AND s.v = greatest(1, least(px.v, height - 2)))"


@query(f"WITH {_X} SELECT * FROM px")
def image_pixels(spark, sf_dir):
    return images.pixels(rasters(spark, sf_dir), "image")


@query(f"WITH {_X}, {_sobel('FLOAT')}, {_EDGE} SELECT * FROM f")
def image_gradients(spark, sf_dir):
    return images.gradients(rasters(spark, sf_dir), "image")


@query(f"WITH {_X}, {_sobel('DOUBLE')} SELECT h.image, round(coalesce(avg(s.s), 0), 6) AS score FROM h LEFT JOIN s ON s.image = h.image AND s.u % 3 = 1 AND s.v % 3 = 1 GROUP BY h.image")
def image_sharpness(spark, sf_dir):
    score = images.sharpness(F.col("height"), F.col("width"), F.col("bgr"))
    return rasters(spark, sf_dir).select("image", F.round(score, 6).alias("score"))


_LIN = "CASE WHEN {0} / 255.0::DOUBLE <= 0.04045 THEN {0} / 255.0::DOUBLE / 12.92 ELSE pow(({0} / 255.0::DOUBLE + 0.055) / 1.055, 2.4) END"
_MIX = lambda c: f"round(sum({c} * (CASE WHEN f.u = u0 THEN 1 - fu ELSE 0 END + CASE WHEN f.u = u1 THEN fu ELSE 0 END) * (CASE WHEN f.v = v0 THEN 1 - fv ELSE 0 END + CASE WHEN f.v = v1 THEN fv ELSE 0 END)), 6)"


@query(
    f"WITH {_X}, {_sobel('FLOAT')}, {_EDGE}, q AS (SELECT vec_id, vec_id // 10 AS image, (vec_id * 37 % 2300) / 100.0::DOUBLE - 1 AS u, (vec_id * 53 % 1200) / 100.0::DOUBLE - 1 AS v FROM embeddings), "
    f"c AS (SELECT vec_id, image, height, greatest(0, least(u, {_WIDTH - 1})) AS u, greatest(0, least(v, height - 1)) AS v FROM q JOIN h USING (image)), k AS (SELECT vec_id, image, floor(u) AS u0, least(floor(u) + 1, {_WIDTH - 1}) AS u1, floor(v) AS v0, least(floor(v) + 1, height - 1) AS v1, u - floor(u) AS fu, v - floor(v) AS fv FROM c), "
    f"f2 AS (SELECT f.*, {_LIN.format('b')} AS b, {_LIN.format('g')} AS g, {_LIN.format('r')} AS r FROM f JOIN px USING (image, u, v)) "
    f"SELECT vec_id, " + ", ".join(f"{_MIX(c)} AS {c}" for c in ("b", "g", "r", "gradient")) + " FROM k JOIN f2 f ON f.image = k.image AND f.u IN (u0, u1) AND f.v IN (v0, v1) GROUP BY vec_id"
)
def image_samples(spark, sf_dir):
    """A place of each embedding's image, some beyond its border, in linear light."""
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", F.floor(F.col("vec_id") / 10).alias("image"))
    s = e.withColumn("u", (F.col("vec_id") * 37 % 2300) / 100.0 - 1).withColumn("v", (F.col("vec_id") * 53 % 1200) / 100.0 - 1)
    found = images.sampled(rasters(spark, sf_dir), s, "image", chunk=4)
    return found.select("vec_id", *[F.round(c, 6).alias(c) for c in ("b", "g", "r", "gradient")])


_CAMERA = {"width": 0, "height": 0, "k": [20.0, 0, 10.25, 0, 20.0, 5.0, 0, 0, 1], "d": [-0.2, 0.05, 0.001, -0.002], "r": [0.0] * 9, "p": [18.0, 0, 10.0, 0, 0, 18.0, 5.0, 0, 0, 0, 1, 0]}


@query(
    f"WITH {_X}, t AS (SELECT u, v, (u - 10) / 18.0::DOUBLE AS x, (v - 5) / 18.0::DOUBLE AS y FROM (SELECT DISTINCT u, v FROM px)), k AS (SELECT *, x * x + y * y AS r2 FROM t), "
    "m AS (SELECT u, v, round_even((20 * (x * (1 + r2 * (-0.2 + r2 * 0.05)) + 2 * 0.001 * x * y - 0.002 * (r2 + 2 * x * x)) + 10.25)::FLOAT * 32, 0)::BIGINT AS su, round_even((20 * (y * (1 + r2 * (-0.2 + r2 * 0.05)) + 0.001 * (r2 + 2 * y * y) - 2 * 0.002 * x * y) + 5)::FLOAT * 32, 0)::BIGINT AS sv FROM k), "
    "w AS (SELECT u, v, floor(su / 32)::BIGINT + du AS pu, floor(sv / 32)::BIGINT + dv AS pv, (CASE WHEN du = 0 THEN 32 - (su & 31) ELSE su & 31 END) * (CASE WHEN dv = 0 THEN 32 - (sv & 31) ELSE sv & 31 END) AS wt FROM m, (SELECT unnest([0, 1]) AS du), (SELECT unnest([0, 1]) AS dv)) "
    "SELECT px.image, px.u, px.v, " + ", ".join(f"((coalesce(sum(wt * o.{c}), 0) + 512) // 1024)::BIGINT AS {c}" for c in "bgr") + " FROM px JOIN w ON w.u = px.u AND w.v = px.v LEFT JOIN px o ON o.image = px.image AND o.u = pu AND o.v = pv GROUP BY ALL"
)
def image_straightened(spark, sf_dir):
    return images.pixels(images.straightened(rasters(spark, sf_dir), _CAMERA), "image")


_D = [-0.3, 0.06, 0.001, -0.002, 0.0]
_W = [0.05, -0.02, 0.001, 0.0]


@query(
    f"WITH RECURSIVE {P}, a AS (SELECT idx, x / z AS x, y / z AS y FROM p WHERE z > 0), k AS (SELECT *, x * x + y * y AS r2, atan(sqrt(x * x + y * y)) AS t FROM a), "
    f"d AS (SELECT idx, x, y, x * (1 + r2 * ({_D[0]} + r2 * {_D[1]})) + 2 * {_D[2]} * x * y + {_D[3]} * (r2 + 2 * x * x) AS xd, y * (1 + r2 * ({_D[0]} + r2 * {_D[1]})) + {_D[2]} * (r2 + 2 * y * y) + 2 * {_D[3]} * x * y AS yd, "
    f"CASE WHEN sqrt(r2) < 1e-8 THEN 1 ELSE t * (1 + t*t * ({_W[0]} + t*t * ({_W[1]} + t*t * {_W[2]}))) / sqrt(r2) END AS s FROM k), "
    "i AS (SELECT idx, 0 AS n, xd, yd, xd AS ux, yd AS uy, sqrt(x*x + y*y) * s AS wr, sqrt(x*x + y*y) * s AS wt FROM d "
    f"UNION ALL SELECT idx, n + 1, xd, yd, (xd - 2 * {_D[2]} * ux * uy - {_D[3]} * (r2 + 2 * ux * ux)) / (1 + r2 * ({_D[0]} + r2 * {_D[1]})), (yd - {_D[2]} * (r2 + 2 * uy * uy) - 2 * {_D[3]} * ux * uy) / (1 + r2 * ({_D[0]} + r2 * {_D[1]})), wr, wr / (1 + wt*wt * ({_W[0]} + wt*wt * ({_W[1]} + wt*wt * {_W[2]}))) FROM (SELECT *, ux * ux + uy * uy AS r2 FROM i) WHERE n < 20), "
    "e AS (SELECT d.idx, d.x, d.y, d.xd, d.yd, d.s, sqrt((ux - x) * (ux - x) + (uy - y) * (uy - y)) * 20 AS err, CASE WHEN wr < 1e-9 THEN 0 ELSE abs(tan(wt) - sqrt(x*x + y*y)) * 20 END AS werr FROM d JOIN i ON i.idx = d.idx AND n = 20) "
    "SELECT idx, CASE WHEN isfinite(err) AND err <= 1 THEN round(xd, 6) END AS x, CASE WHEN isfinite(err) AND err <= 1 THEN round(yd, 6) END AS y, CASE WHEN isfinite(werr) AND werr <= 1 THEN round(x * s, 6) END AS wide_x FROM e"
)
def lens_places(spark, sf_dir):
    """Rays through two lenses, null where the lens folds back."""
    p = points(spark, sf_dir).where("z > 0").withColumn("x", F.col("x") / F.col("z")).withColumn("y", F.col("y") / F.col("z"))
    x, y = F.col("x"), F.col("y")
    out = p.select("idx", geometry.on_raw_image(x, y, "plumb_bob", _D, 20.0, 20.0).alias("a"), geometry.on_raw_image(x, y, "equidistant", _W, 20.0, 20.0).alias("w"))
    # SQL's round keeps the sign of what comes to zero
    six = lambda c: F.when(F.round(c, 6) == 0, F.col(c) * 0.0).otherwise(F.round(c, 6))
    return out.select("idx", six("a.x").alias("x"), six("a.y").alias("y"), six("w.x").alias("wide_x"))


_B = [-0.1, 0.01, 0.001, -0.001]


@query(
    "WITH RECURSIVE c AS (SELECT p_partkey, p_partkey % 5 AS kind, p_size * 10::DOUBLE AS fx, p_size * 5::DOUBLE AS cx, p_size * 11::DOUBLE AS fy, p_size * 4::DOUBLE AS cy, p_size * 10 + 3 AS w, p_size * 8 + 1 AS h FROM part), "
    "g AS (SELECT unnest(range(9)) AS i), q AS (SELECT p_partkey, a.i AS iu, b.i AS iv, (a.i * (w - 1) / 8.0::DOUBLE - cx) / fx AS xd, (b.i * (h - 1) / 8.0::DOUBLE - cy) / fy AS yd FROM c, g a, g b WHERE kind IN (0, 1)), "
    f"r AS (SELECT *, 0 AS n, xd AS x, yd AS y FROM q UNION ALL SELECT p_partkey, iu, iv, xd, yd, n + 1, (xd - 2 * {_B[2]} * x * y - {_B[3]} * (r2 + 2 * x * x)) / (1 + r2 * ({_B[0]} + r2 * {_B[1]})), (yd - {_B[2]} * (r2 + 2 * y * y) - 2 * {_B[3]} * x * y) / (1 + r2 * ({_B[0]} + r2 * {_B[1]})) FROM (SELECT *, x * x + y * y AS r2 FROM r) WHERE n < 5), "
    "e AS (SELECT p_partkey, max(x) FILTER (iu = 0) AS l, min(x) FILTER (iu = 8) AS rt, max(y) FILTER (iv = 0) AS t, min(y) FILTER (iv = 8) AS b, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM r WHERE n = 5 GROUP BY p_partkey), "
    "m AS (SELECT c.*, e.* EXCLUDE (p_partkey), 0.75 * (w - 1) / (rt - l) AS a, 0.25 * (w - 1) / (x1 - x0) AS o, 0.75 * (h - 1) / (b - t) AS a2, 0.25 * (h - 1) / (y1 - y0) AS o2 FROM c LEFT JOIN e USING (p_partkey)) "
    "SELECT p_partkey, CASE WHEN kind IN (0, 1) THEN round(a + o, 6) WHEN kind = 2 THEN fx END AS fx, CASE WHEN kind IN (0, 1) THEN round(-a * l - o * x0, 6) WHEN kind = 2 THEN cx END AS cx, CASE WHEN kind IN (0, 1) THEN round(a2 + o2, 6) WHEN kind = 2 THEN fy END AS fy, CASE WHEN kind IN (0, 1) THEN round(-a2 * t - o2 * y0, 6) WHEN kind = 2 THEN cy END AS cy, kind > 2 AS refused FROM m"
)
def camera_projections(spark, sf_dir):
    """A camera for each part: two kinds with a distorted lens, one without, a fisheye and one of a stereo pair."""
    s, kind = F.col("p_size").cast("double"), F.col("p_partkey") % 5
    zero, one = F.lit(0.0), F.lit(1.0)
    model = F.when(kind == 2, "none").when(kind == 3, "equidistant").otherwise("plumb_bob")
    cameras = spark.read.parquet(f"{sf_dir}/part.parquet").select(
        "p_partkey", (F.col("p_size") * 10 + 3).alias("width"), (F.col("p_size") * 8 + 1).alias("height"), model.alias("distortion_model"), F.array(*map(F.lit, _B)).alias("d"),
        F.array(s * 10, zero, s * 5, zero, s * 11, s * 4, zero, zero, one).alias("k"), F.array_repeat(zero, 9).alias("r"),
        F.array(s, zero, s, F.when(kind == 4, one).otherwise(zero), zero, s, s, zero, zero, zero, one, zero).alias("p"),
    )
    found = images.projections(cameras, 0.25)
    at = lambda k, name: F.round(F.get("projection", F.lit(k)), 6).alias(name)
    return found.select("p_partkey", at(0, "fx"), at(2, "cx"), at(5, "fy"), at(6, "cy"), F.col("refused").isNotNull().alias("refused"))


_MOST = 3.0
_DISC = (
    "s0 AS (SELECT idx, x, y, z, intensity AS nx, 0.3::DOUBLE AS ny, 0.4::DOUBLE AS nz, 0.25::DOUBLE AS radius, 20 * x / z + 16 AS u, 20 * y / z + 12 AS v FROM p WHERE z > 0), s1 AS (SELECT *, x / z AS a, y / z AS b, radius / z AS s FROM s0 WHERE u >= 0 AND u < 32 AND v >= 0 AND v < 24), "
    "s2 AS (SELECT *, nx - a * nz AS ku, ny - b * nz AS kv FROM s1), s3 AS (SELECT *, s * s * 400 * (1 + a * a - ku * ku) AS uu, s * s * 400 * (a * b - ku * kv) AS uv, s * s * 400 * (1 + b * b - kv * kv) AS vv FROM s2), "
    f"s4 AS (SELECT *, 0.5 * (uu + vv) + sqrt(0.25 * (uu - vv) * (uu - vv) + uv * uv) AS long FROM s3), s5 AS (SELECT idx, z, u, v, uu * f AS uu, uv * f AS uv, vv * f AS vv FROM (SELECT *, CASE WHEN long > {_MOST * _MOST} THEN {_MOST * _MOST} / long ELSE 1 END AS f FROM s4)), "
    "g AS (SELECT unnest(range(32)) AS pu), k AS (SELECT unnest(range(24)) AS pv), "
    "c AS (SELECT idx, z, pu, pv FROM s5, g, k WHERE (uu > 0 OR vv > 0) AND abs(pu - u) <= sqrt(greatest(0, uu)) AND abs(pv - v) <= sqrt(greatest(0, vv)) AND (pu - u) * (pu - u) + (pv - v) * (pv - v) <= uu + vv AND vv * (pu - u) * (pu - u) - 2 * uv * (pu - u) * (pv - v) + uu * (pv - v) * (pv - v) <= uu * vv - uv * uv UNION ALL SELECT idx, z, floor(u)::INT, floor(v)::INT FROM s5), "
    "b AS (SELECT pu, pv, min(z) AS front FROM c GROUP BY pu, pv)"
)


def _discs(spark, sf_dir) -> DataFrame:
    p = points(spark, sf_dir).select("idx", "x", "y", "z", F.col("intensity").alias("nx"), F.lit(0.3).alias("ny"), F.lit(0.4).alias("nz"), F.lit(0.25).alias("radius"))
    return splats.projected(p, [20.0, 0.0, 16.0, 0.0, 20.0, 12.0, 0.0, 0.0, 1.0], 32, 24, _MOST)


@query(f"WITH {P}, {_DISC} SELECT pu::INT AS pu, pv::INT AS pv, round(front, 6) AS front FROM b")
def splat_depths(spark, sf_dir):
    return splats.depth_buffer(_discs(spark, sf_dir), [], 32, 24).select("pu", "pv", F.round("front", 6).alias("front"))


@query(f"WITH {P}, {_DISC} SELECT idx FROM s5 JOIN b ON pu = floor(u) AND pv = floor(v) WHERE z <= front + 0.2")
def splat_visible(spark, sf_dir):
    return splats.visible(_discs(spark, sf_dir), [], 32, 24, 0.2).select("idx")
