"""Satellite fixes against a map's submaps: placing, alignment and the priors that follow."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronolane.functions import geometry as G
from chronolane.operators import asof

AXES = ("x", "y", "z")


def constrained(submaps: DataFrame, fixes: DataFrame, lever: tuple[float, float, float] = (0.0, 0.0, 0.0), **options) -> DataFrame:
    """Submaps wholly inside the time span of the fixes, with the lever arm in the world (lx, ly, lz), the fix at mid_ns (gx, gy, gz) and the nearest fix's covariance.

    submaps: id, start_ns, mid_ns, end_ns, tx .. qw. fixes: timestamp_ns, seq, x, y,
    z and covariance. The fix is interpolated, the covariance is of the fix nearest
    in time, of two equally near the earlier. Without fixes there are no rows.
    """
    span = fixes.agg(F.min("timestamp_ns").alias("_lo"), F.max("timestamp_ns").alias("_hi"))  # one row
    inside = submaps.join(F.broadcast(span), (F.col("start_ns") >= F.col("_lo")) & (F.col("end_ns") <= F.col("_hi"))).drop("_lo", "_hi")
    met = asof.neighbours(inside.withColumn("timestamp_ns", F.col("mid_ns")), fixes, [*AXES, "covariance"], **options)
    zero = (F.lit(0.0),) * 3
    arm = G.transform(tuple(F.lit(float(v)) for v in lever), zero, tuple(F.col(f"q{a}") for a in "xyzw"))
    out = met.withColumns({f"l{a}": v for a, v in zip(AXES, arm, strict=True)} | {f"g{a}": asof.blend(a) for a in AXES} | {"covariance": asof.closer()["covariance"]})
    return out.drop("prev", "next", "timestamp_ns")


def aligned(met: DataFrame) -> DataFrame:
    """What `constrained` gives with wx, wy, wz: each submap's place by its fix, in the world, and the turn from fixes to the world (c, s).

    The turn about z and the shift that bring the antennas (origin and lever arm)
    next to the fixes, in the least squares; z is shifted only. Points that all
    coincide are not turned. The lever arm is taken off again.
    """
    e = {a: F.col(f"t{a}") + F.col(f"l{a}") for a in AXES}
    g = {a: F.col(f"g{a}") for a in AXES}
    s = lambda a, b: F.coalesce(F.covar_pop(g[a], e[b]), F.lit(0.0))
    fit = met.agg(F.atan2(s("y", "x") - s("x", "y"), s("x", "x") + s("y", "y")).alias("_turn"), *[F.avg(e[a]).alias(f"_e{a}") for a in AXES], *[F.avg(g[a]).alias(f"_g{a}") for a in AXES])
    out = met.join(F.broadcast(fit)).withColumn("c", F.cos("_turn")).withColumn("s", F.sin("_turn"))  # one row
    x, y = F.col("gx") - F.col("_gx"), F.col("gy") - F.col("_gy")
    c, n = F.col("c"), F.col("s")
    world = (F.col("_ex") + c * x + n * y, F.col("_ey") - n * x + c * y, F.col("gz") - F.col("_gz") + F.col("_ez"))
    out = out.withColumns({f"w{a}": v - F.col(f"l{a}") for a, v in zip(AXES, world, strict=True)})
    return out.drop("_turn", *[f"_{k}{a}" for k in "eg" for a in AXES])


def prior_covariance(covariance: Column, c: Column, s: Column, floor: float, inflation: float, z_variance: float) -> Column:
    """Nine numbers: the horizontal part of a covariance (of nine) turned into the world, times inflation squared, with floor squared on its diagonal; z stands alone."""
    a, d = F.get(covariance, F.lit(0)), F.get(covariance, F.lit(4))
    b = (F.get(covariance, F.lit(1)) + F.get(covariance, F.lit(3))) / 2
    k, zero = inflation * inflation, F.lit(0.0)
    xx = (c * c * a + 2 * c * s * b + s * s * d) * k + floor * floor
    yy = (s * s * a - 2 * c * s * b + c * c * d) * k + floor * floor
    xy = ((c * c - s * s) * b + c * s * (d - a)) * k
    return F.array(xx, xy, zero, xy, yy, zero, zero, zero, F.lit(float(z_variance)))
