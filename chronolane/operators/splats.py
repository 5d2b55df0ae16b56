"""Points as small discs on an image: which pixels they cover, and what hides what.

A disc with a normal is an ellipse on the image. Its pixels come by exploding the
ranges of its box, so a depth buffer is a minimum over (image, u, v): tasks keep one
row for each pixel before anything is shuffled, however many points crowd one spot.
`most_px` bounds the ellipse's longer half axis and with it the rows of a point.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def footprint(p: tuple[Column, Column, Column], n: tuple[Column, Column, Column], radius: Column, fx: float, fy: float, most_px: float) -> Column:
    """struct(uu, uv, vv): the covariance-like form of the ellipse; zeros where there is none.

    It is the disc's, projected to first order; without a normal (all zeros or
    null) a circle; shrunk as a whole to the longest half axis.
    """
    x, y, z = p
    n = tuple(F.coalesce(c, F.lit(0.0)) for c in n)
    lit = F.lit
    ok = (z > 0) & (radius > 0) & (lit(most_px) > 0)
    depth = F.when(ok, z).otherwise(1.0)
    flat = n[0] * n[0] + n[1] * n[1] + n[2] * n[2] > 0
    a, b, s = x / depth, y / depth, radius / depth
    ku, kv = n[0] - a * n[2], n[1] - b * n[2]
    circle = (0.5 * (fx + fy) * s) * (0.5 * (fx + fy) * s)
    uu = F.when(flat, s * s * (fx * fx) * (1 + a * a - ku * ku)).otherwise(circle)
    uv = F.when(flat, s * s * (fx * fy) * (a * b - ku * kv)).otherwise(0.0)
    vv = F.when(flat, s * s * (fy * fy) * (1 + b * b - kv * kv)).otherwise(circle)
    mean, half = 0.5 * (uu + vv), 0.5 * (uu - vv)
    long = mean + F.sqrt(half * half + uv * uv)
    shrink = F.when(long > most_px * most_px, most_px * most_px / long).otherwise(1.0)
    made = lambda c: F.coalesce(F.when(ok, c * shrink), lit(0.0))
    return F.struct(made(uu).alias("uu"), made(uv).alias("uv"), made(vv).alias("vv"))


def covers(shape: Column, du: Column, dv: Column) -> Column:
    """Whether the ellipse covers a place off its middle; one that has collapsed to a line is bounded by its length."""
    uu, uv, vv = shape["uu"], shape["uv"], shape["vv"]
    return (du * du + dv * dv <= uu + vv) & (vv * du * du - 2 * uv * du * dv + uu * dv * dv <= uu * vv - uv * uv)


def projected(points: DataFrame, k: list[float], width: int, height: int, most_px: float) -> DataFrame:
    """The points (x, y, z in the camera, nx, ny, nz, radius) in front that fall on the image, with u and v (not whole), depth and shape."""
    u, v = k[0] * F.col("x") / F.col("z") + k[2], k[4] * F.col("y") / F.col("z") + k[5]
    shape = footprint(tuple(map(F.col, ("x", "y", "z"))), tuple(map(F.col, ("nx", "ny", "nz"))), F.col("radius"), k[0], k[4], most_px)
    out = points.where("z > 0").withColumns({"u": u, "v": v, "depth": F.col("z"), "shape": shape})
    return out.where((F.col("u") >= 0) & (F.col("u") < width) & (F.col("v") >= 0) & (F.col("v") < height))


def depth_buffer(discs: DataFrame, keys: list[str], width: int, height: int) -> DataFrame:
    """keys, pu, pv and the least depth of each pixel that a disc covers. The pixel of a disc's middle is always covered."""
    middle = discs.select(*keys, F.floor("u").cast("int").alias("pu"), F.floor("v").cast("int").alias("pv"), "depth")
    half = {c: F.sqrt(F.greatest(F.lit(0.0), F.col(f"shape.{c}{c}"))) for c in "uv"}
    low = {c: F.greatest(F.lit(0), F.ceil(F.col(c) - half[c]).cast("int")) for c in "uv"}
    high = {c: F.least(F.lit(n - 1), F.floor(F.col(c) + half[c]).cast("int")) for c, n in (("u", width), ("v", height))}
    box = discs.select(*keys, "u", "v", "depth", "shape", *[f[c].alias(f"{n}_{c}") for c in "uv" for n, f in (("low", low), ("high", high))])
    box = box.where("low_u <= high_u AND low_v <= high_v AND (shape.uu > 0 OR shape.vv > 0)")
    rows = box.withColumn("pv", F.explode(F.sequence("low_v", "high_v"))).withColumn("pu", F.explode(F.sequence("low_u", "high_u")))
    rows = rows.where(covers(F.col("shape"), F.col("pu") - F.col("u"), F.col("pv") - F.col("v"))).select(*keys, "pu", "pv", "depth")
    return middle.unionByName(rows).groupBy(*keys, "pu", "pv").agg(F.min("depth").alias("front"))


def visible(discs: DataFrame, keys: list[str], width: int, height: int, tolerance: float) -> DataFrame:
    """The discs whose middle is no deeper than its pixel's nearest by more than the tolerance."""
    front = depth_buffer(discs, keys, width, height)
    at = discs.withColumn("pu", F.floor("u").cast("int")).withColumn("pv", F.floor("v").cast("int"))
    return at.join(front, [*keys, "pu", "pv"]).where(F.col("depth") <= F.col("front") + tolerance).select(*discs.columns)
