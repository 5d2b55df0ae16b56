"""Voxels, neighbours and projections over point tables (idx, x, y, z, ...)."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

AXES = ("x", "y", "z")


def cell(size: float, prefix: str = "v") -> list[Column]:
    return [F.floor(F.col(a) / size).cast("long").alias(f"{prefix}{a}") for a in AXES]


def around(reach: int) -> Column:
    """An array of the moves to the cells within the reach on each axis."""
    return F.array(*[F.struct(*[F.lit(d).alias(f"d{a}") for a, d in zip(AXES, m, strict=True)]) for m in product(range(-reach, reach + 1), repeat=3)])


def voxels(points: DataFrame, size: float, means: tuple[str, ...] = ("x", "y", "z")) -> DataFrame:
    """A row for each occupied voxel: cell, means, number of points and the first point's idx."""
    v = points.select("*", *cell(size))
    return v.groupBy("vx", "vy", "vz").agg(*[F.avg(m).alias(m) for m in means], F.count("*").alias("n_points"), F.min("idx").alias("first_idx"))


def merged(maps: list[DataFrame]) -> DataFrame:
    """Voxel tables as one: means weighted by their points."""
    every = maps[0]
    for m in maps[1:]:
        every = every.unionByName(m)
    mean = lambda a: (F.sum(F.col(a) * F.col("n_points")) / F.sum("n_points")).alias(a)
    return every.groupBy("vx", "vy", "vz").agg(*[mean(a) for a in AXES], F.sum("n_points").alias("n_points"), F.min("first_idx").alias("first_idx"))


def within(left: DataFrame, right: DataFrame, radius: float) -> DataFrame:
    """idx, other and d2 of all pairs within the radius: each left point meets the points of its own cell and the 26 around."""
    l = left.select("idx", *AXES, *cell(radius), F.explode(around(1)).alias("m"))  # noqa: E741
    l = l.select("idx", *AXES, *[(F.col(f"v{a}") + F.col(f"m.d{a}")).alias(f"v{a}") for a in AXES])  # noqa: E741
    r = right.select(F.col("idx").alias("other"), *[F.col(a).alias(f"r{a}") for a in AXES], *cell(radius))
    d2 = sum(((F.col(a) - F.col(f"r{a}")) * (F.col(a) - F.col(f"r{a}")) for a in AXES[1:]), (F.col("x") - F.col("rx")) * (F.col("x") - F.col("rx")))
    return l.join(r, ["vx", "vy", "vz"]).withColumn("d2", d2).where(F.col("d2") <= radius * radius).select("idx", "other", "d2")


#: A leaf of the tree holds at most so many places (points with the same coordinates are one place); a task takes at most so many searching points of a leaf at once.
LEAF, SEARCHING, WAYS = 2048, 8192, 8


def _finite(points: DataFrame) -> DataFrame:
    return points.where(" AND ".join(f"{a} IS NOT NULL AND NOT isnan({a}) AND abs({a}) < double('Infinity')" for a in AXES))


def _dealt(nodes: dict, x: np.ndarray) -> np.ndarray:
    """The leaf of each row of x."""
    out, todo = np.zeros(len(x), np.int64), [(0, np.arange(len(x)))]
    while todo:
        at, rows = todo.pop()
        if "cuts" not in nodes[at]:
            out[rows] = at
            continue
        k = np.searchsorted(nodes[at]["cuts"], x[rows, nodes[at]["axis"]], side="right")
        todo += [(c, rows[k == j]) for j, c in enumerate(nodes[at]["children"]) if (k == j).any()]
    return out


def _apart(x: np.ndarray, low: np.ndarray, high: np.ndarray, most: bool = False) -> np.ndarray:
    """The least (or the largest) squared distance to points of a box: summed up like a distance, so rounding keeps it a bound."""
    d = np.maximum(np.abs(x - low), np.abs(x - high)) if most else np.maximum(np.maximum(low - x, x - high), 0)
    return (d[:, 0] * d[:, 0] + d[:, 1] * d[:, 1]) + d[:, 2] * d[:, 2]


def _homes(nodes: dict, x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """A leaf near each row of x, and a squared distance within which k points lie for sure."""
    home, bound, todo = np.zeros(len(x), np.int64), np.full(len(x), np.inf), [(0, np.arange(len(x)))]
    while todo:
        at, rows = todo.pop()
        n = nodes[at]
        if n["n"] >= k:
            bound[rows] = np.minimum(bound[rows], _apart(x[rows], n["low"], n["high"], True))
        if "cuts" not in n:
            home[rows] = at
            continue
        best = np.argmin([_apart(x[rows], nodes[c]["low"], nodes[c]["high"]) for c in n["children"]], axis=0)
        todo += [(c, rows[best == j]) for j, c in enumerate(n["children"]) if (best == j).any()]
    return home, bound


def _reached(nodes: dict, x: np.ndarray, bound: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Leaves with the rows of x that may have a point there within their bound."""
    todo = [(0, np.arange(len(x)))]
    while todo:
        at, rows = todo.pop()
        rows = rows[_apart(x[rows], nodes[at]["low"], nodes[at]["high"]) <= bound[rows]]
        if len(rows) and "cuts" in nodes[at]:
            todo += [(c, rows) for c in nodes[at]["children"]]
        elif len(rows):
            yield at, rows


def _tree(points: DataFrame) -> tuple[dict, DataFrame]:
    """A tree over the points by rounds of approximate quantiles along the longest axis, and the points with their leaf; empty without points.

    A node knows the number of its points and their box: a row for each node comes to the driver. Cuts decide only how
    evenly points are dealt, never what is found.
    """
    from pyspark.sql import types as T

    nodes: dict = {}
    names = points.columns

    def leaves(tree: dict) -> DataFrame:
        at = F.pandas_udf(lambda x, y, z: pd.Series(_dealt(tree, np.column_stack([x, y, z]).astype(float))), T.LongType())
        return points.select(*names, at(*[F.col(a).cast("double") for a in AXES]).alias("_at"))

    open_, found = [0], points.select(*names, F.lit(0).cast("long").alias("_at"))
    while open_:
        quantiles = lambda a: F.percentile_approx(a, [k / WAYS for k in range(1, WAYS)], 1000).alias(f"q{a}")
        stats = found.where(F.col("_at").isin(open_)).groupBy("_at").agg(F.count("*").alias("n"), F.sum(F.col("_first").cast("long")).alias("places"), *[f(a).alias(f"{f.__name__}{a}") for a in AXES for f in (F.min, F.max)], *[quantiles(a) for a in AXES])
        open_ = []
        for r in stats.collect():
            low, high = (np.array([float(r[f"{f}{a}"]) for a in AXES]) for f in ("min", "max"))
            node = nodes[r["_at"]] = {"n": r["n"], "low": low, "high": high}
            wide = int(np.argmax(high / 2 - low / 2))
            if r["places"] <= LEAF or not high[wide] > low[wide]:
                continue
            cuts = sorted({float(c) for c in r[f"q{AXES[wide]}"] if c > low[wide]})
            middle = low[wide] / 2 + high[wide] / 2
            node |= {"axis": wide, "cuts": np.array(cuts or [middle if middle > low[wide] else high[wide]])}
            open_.append(r["_at"])
        grown, given = [], max(nodes, default=0) + 1
        for at in open_:
            node = nodes[at]
            node["children"] = list(range(given, given + len(node["cuts"]) + 1))
            given += len(node["children"])
            grown += node["children"]
            for c in node["children"]:
                nodes[c] = {"n": 0, "low": np.full(3, np.inf), "high": np.full(3, -np.inf)}
        open_ = grown
        if open_:
            found = leaves(nodes)
    return nodes, found


def _meet(searching: DataFrame, found: DataFrame, k: int, places: bool = False) -> DataFrame:
    """idx, other and d2 of the k best points in the leaf that each searching point (idx, x, y, z, bound, _at) names, within its bound; with places, also the other's ox, oy, oz."""
    carried = [f"o{a}" for a in AXES] if places else []
    many = {r["_at"]: -(-r["count"] // SEARCHING) for r in searching.groupBy("_at").count().where(F.col("count") > SEARCHING).collect()}  # crowded leaves only
    parts = F.coalesce(F.element_at(F.create_map(*[F.lit(v).cast("long") for p in many.items() for v in p]), F.col("_at")), F.lit(1)) if many else F.lit(1)
    left = searching.withColumn("_part", F.pmod(F.xxhash64("idx", *AXES), parts))
    right = found.withColumn("_part", F.explode(F.sequence(F.lit(0).cast("long"), parts.cast("long") - 1)))

    def best(l: pd.DataFrame, r: pd.DataFrame) -> pd.DataFrame:  # noqa: E741
        r = r.sort_values("other", kind="stable")
        other, at, out = r["other"].to_numpy(), r[list(AXES)].to_numpy(float), []
        step = max(1, 2_000_000 // max(1, len(r)))
        for start in range(0, len(l) if len(r) else 0, step):
            some = l.iloc[start : start + step]
            x = some[list(AXES)].to_numpy(float)
            dx, dy, dz = (x[:, j, None] - at[:, j] for j in range(3))
            d2 = (dx * dx + dy * dy) + dz * dz
            reach = some["bound"].to_numpy()
            if len(r) > k:
                reach = np.minimum(reach, np.partition(d2, k - 1, axis=1)[:, k - 1])
            row, col = np.nonzero(d2 <= reach[:, None])  # by row, then by other
            near = d2[row, col]
            by = np.lexsort((col, near, row))
            row, col, near = row[by], col[by], near[by]
            keep = np.arange(len(row)) - np.searchsorted(row, row) < k
            out.append(pd.DataFrame({"idx": some["idx"].to_numpy()[row[keep]], "other": other[col[keep]], "d2": near[keep], **{c: at[col[keep], j] for j, c in enumerate(carried)}}))
        return pd.concat(out) if out else pd.DataFrame({c: [] for c in ("idx", "other", "d2", *carried)})

    schema = ", ".join(["idx long, other long, d2 double", *[f"{c} double" for c in carried]])
    return left.groupBy("_at", "_part").cogroup(right.groupBy("_at", "_part")).applyInPandas(best, schema)


def _search(left: DataFrame, right: DataFrame, k: int, radius: float | None = None, places: bool = False) -> DataFrame:
    """idx, other, d2 and rank of the k nearest right points (all of them, if fewer) within the radius of each finite left point, by (distance, idx); with places, also the other's ox, oy, oz.

    Each left point first meets one leaf of a tree over the right points, and then
    the leaves that may hold nearer ones, so what is shuffled grows with the
    points, however dense they lie. Of one place the k lowest right idx are enough.
    """
    place = Window.partitionBy(*AXES).orderBy("other")
    r = _finite(right).select(F.col("idx").cast("long").alias("other"), *[F.col(a).cast("double").alias(a) for a in AXES])
    r = r.withColumn("_n", F.row_number().over(place)).where(F.col("_n") <= k).withColumn("_first", F.col("_n") == 1).drop("_n").checkpoint()
    l = _finite(left).select(F.col("idx").cast("long").alias("idx"), *[F.col(a).cast("double").alias(a) for a in AXES])  # noqa: E741
    nodes, found = _tree(r)
    found = found.drop("_first")
    limit = float("inf") if radius is None else radius * radius
    columns = "idx long, x double, y double, z double, bound double, _at long"
    if not nodes:
        empty = [F.lit(None).cast("double").alias(c) for c in ("d2", *[f"o{a}" for a in AXES if places])]
        return l.limit(0).select("idx", F.lit(None).cast("long").alias("other"), *empty, F.lit(1).alias("rank"))

    def starts(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            home, bound = _homes(nodes, pdf[list(AXES)].to_numpy(float), k)
            yield pdf.assign(bound=np.minimum(bound, limit), _at=home)

    def onward(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            x, home = pdf[list(AXES)].to_numpy(float), pdf["_at"].to_numpy()
            for at, rows in _reached(nodes, x, pdf["bound"].to_numpy()):
                rows = rows[home[rows] != at]
                yield pdf.iloc[rows].assign(_at=at)

    first = l.mapInPandas(starts, columns).checkpoint()
    near = _meet(first, found, k, places).checkpoint()
    kth = near.groupBy("idx").agg(F.count("*").alias("_n"), F.max("d2").alias("_kth"))
    closer = first.join(kth, "idx", "left").withColumn("bound", F.when(F.col("_n") >= k, F.least("bound", "_kth")).otherwise(F.col("bound"))).drop("_n", "_kth")
    rest = _meet(closer.mapInPandas(onward, columns).checkpoint(), found, k, places)
    rank = F.row_number().over(Window.partitionBy("idx").orderBy("d2", "other"))
    return near.unionByName(rest).withColumn("rank", rank).where(F.col("rank") <= k)


def nearest(left: DataFrame, right: DataFrame, k: int, radius: float | None = None, places: bool = False) -> DataFrame:
    """idx, other, d2 and rank of the k nearest right points of each left point, by (distance, idx); with places, also the other's ox, oy, oz; `radius` is no longer needed.

    Left points that are not finite, or fewer finite right points than min(k, all), are an error.
    """
    want = min(k, right.count())
    if want and (left.count() > _finite(left).count() or _finite(right).count() < want):
        raise ValueError("some points lack neighbours: not all are finite")
    return _search(left, right, max(want, 1), places=places)


def inliers(points: DataFrame, radius: float, least: int) -> DataFrame:
    """The points with at least `least` others within the radius."""
    n = within(points, points, radius).where("idx <> other").groupBy("idx").count().where(F.col("count") >= least)
    return points.join(n.select("idx"), "idx", "left_semi")


def propagated(points: DataFrame, known: DataFrame, columns: list[str], radius: float) -> DataFrame:
    """idx and the columns of the nearest known point within the radius (of equally near the lowest idx), else null."""
    best = _search(points, known, 1, radius).select("idx", "other")
    value = known.select(F.col("idx").alias("other"), *columns)
    return points.select("idx").join(best.join(value, "other"), "idx", "left").select("idx", *columns)


def void(free: DataFrame, reach: int) -> DataFrame:
    """The free voxels whose whole neighbourhood is free."""
    near = free.select("vx", "vy", "vz").distinct().withColumn("m", F.explode(around(reach)))
    near = near.select(*[(F.col(f"v{a}") + F.col(f"m.d{a}")).alias(f"v{a}") for a in AXES])
    return near.groupBy("vx", "vy", "vz").count().where(F.col("count") == (2 * reach + 1) ** 3).drop("count")


def outside(points: DataFrame, voxels_: DataFrame, size: float) -> DataFrame:
    """The points that lie in none of the voxels."""
    return points.select("*", *cell(size)).join(voxels_, ["vx", "vy", "vz"], "left_anti").select(*points.columns)


def supported(points: DataFrame, occupied: DataFrame, size: float, key: str) -> DataFrame:
    """The points beside an occupied voxel of one of their keys."""
    near = points.select("idx", key, *cell(size), F.explode(around(1)).alias("m"))
    near = near.select("idx", key, *[(F.col(f"v{a}") + F.col(f"m.d{a}")).alias(f"v{a}") for a in AXES])
    hit = near.join(occupied.select(key, "vx", "vy", "vz"), [key, "vx", "vy", "vz"], "left_semi")
    return points.join(hit.select("idx").distinct(), "idx", "left_semi")


def free_voxels(rays: DataFrame, size: float) -> DataFrame:
    """Voxels that rays (ox, oy, oz to x, y, z) pass, their last one left out: samples every half voxel."""
    d = [F.col(a) - F.col(f"o{a}") for a in AXES]
    length = F.sqrt(d[0] * d[0] + d[1] * d[1] + d[2] * d[2])
    n = F.greatest(F.ceil(length / (size / 2)).cast("int"), F.lit(1))
    r = rays.withColumn("_n", n).withColumn("_k", F.explode(F.sequence(F.lit(0), n)))
    at = [F.floor((F.col(f"o{a}") + d[i] * F.col("_k") / F.col("_n")) / size).cast("long").alias(f"v{a}") for i, a in enumerate(AXES)]
    end = [F.floor(F.col(a) / size).cast("long").alias(f"e{a}") for a in AXES]
    return r.select(*at, *end).where("NOT (vx = ex AND vy = ey AND vz = ez)").select("vx", "vy", "vz").distinct()


def projected(points: DataFrame, k: list[float], width: int, height: int) -> DataFrame:
    """The points in front of the camera that fall on the image, with u, v and depth."""
    from chronolane.functions.geometry import pinhole

    u, v = pinhole((F.col("x"), F.col("y"), F.col("z")), k)
    out = points.where("z > 0").withColumns({"u": F.floor(u).cast("int"), "v": F.floor(v).cast("int"), "depth": F.col("z")})
    return out.where((F.col("u") >= 0) & (F.col("u") < width) & (F.col("v") >= 0) & (F.col("v") < height))


def visible(pixels: DataFrame, tolerance: float) -> DataFrame:
    """The projected points that are no deeper than their pixel's nearest by more than the tolerance."""
    front = pixels.groupBy("u", "v").agg(F.min("depth").alias("front"))
    return pixels.join(front, ["u", "v"]).where(F.col("depth") <= F.col("front") + tolerance)


def overlay(pixels: DataFrame, value: str) -> DataFrame:
    """The value that shows at each pixel: points are drawn by rising depth, so the farthest stays."""
    return pixels.groupBy("u", "v").agg(F.max_by(value, F.struct("depth", "idx")).alias(value))


def normals(points: DataFrame, k: int, radius: float) -> DataFrame:
    """idx, normal (nx, ny, nz), mean spacing from each point's k nearest others."""
    near = nearest(points, points, k + 1, radius, places=True).where("idx <> other")  # dealt by idx already: no shuffle follows
    pairs = [("x", "x"), ("x", "y"), ("x", "z"), ("y", "y"), ("y", "z"), ("z", "z")]
    by = near.groupBy("idx").agg(F.avg(F.sqrt("d2")).alias("spacing"), F.array(*[F.covar_pop(f"o{a}", f"o{b}") for a, b in pairs]).alias("c"))

    @F.pandas_udf("array<double>")
    def smallest(c: pd.Series) -> pd.Series:
        import numpy as np

        m = np.array(c.tolist())
        full = m[:, [0, 1, 2, 1, 3, 4, 2, 4, 5]].reshape(-1, 3, 3)
        v = np.linalg.eigh(full)[1][:, :, 0]
        lead = v[np.arange(len(v)), np.abs(v).argmax(axis=1)]
        return pd.Series((v * np.where(lead < 0, -1, 1)[:, None]).tolist())

    out = by.withColumn("n", smallest("c"))
    return out.select("idx", *[F.col("n")[i].alias(f"n{a}") for i, a in enumerate(AXES)], "spacing")
