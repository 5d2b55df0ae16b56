"""Kernels over rasters: rows of height, width and bgr (packed blue, green, red bytes, as `sensors.rasters` gives).

Arrow batches of whole images go through numpy; nothing runs by pixel in Python. An
image whose bytes do not fit its size, or are null, has no pixels, no gradient and
a sharpness of 0, and samples of it are 0.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The weights of blue, green and red in the grey value, and the grid that sharpness looks at.
GREY, GRID = (0.114, 0.587, 0.299), 3
#: Fixed value: the steps between two pixels that a remap tells apart.
STEPS = 32


def raster(height: object, width: object, data: bytes | None) -> np.ndarray | None:
    """An image as an array of (height, width, 3), or None if its bytes do not fit."""
    if data is None or height is None or width is None or height <= 0 or width <= 0 or len(data) != 3 * height * width:
        return None
    return np.frombuffer(data, np.uint8).reshape(int(height), int(width), 3)


def _grey(image: np.ndarray, kind: type) -> np.ndarray:
    b, g, r = (image[:, :, k].astype(float) for k in range(3))
    return (GREY[0] * b + GREY[1] * g + GREY[2] * r).astype(kind)


def _sobel(grey: np.ndarray, rows: slice, columns: slice) -> np.ndarray:
    """|gx| + |gy| of the pixels of the given rows and columns, which are not at the border."""
    shifted = lambda dv, du: grey[rows.start + dv : rows.stop + dv : rows.step, columns.start + du : columns.stop + du : columns.step]
    gx = (shifted(-1, 1) + 2 * shifted(0, 1) + shifted(1, 1)) - (shifted(-1, -1) + 2 * shifted(0, -1) + shifted(1, -1))
    gy = (shifted(1, -1) + 2 * shifted(1, 0) + shifted(1, 1)) - (shifted(-1, -1) + 2 * shifted(-1, 0) + shifted(-1, 1))
    return np.abs(gx) + np.abs(gy)


def sobel(image: np.ndarray) -> np.ndarray:
    """The gradient of every pixel in 32-bit floats; border pixels have that of their neighbour inside; without any inside all are 0."""
    height, width, _ = image.shape
    if height < 3 or width < 3:
        return np.zeros((height, width), np.float32)
    return np.pad(_sobel(_grey(image, np.float32), slice(1, height - 1, 1), slice(1, width - 1, 1)), 1, mode="edge")


def sharpness_of(image: np.ndarray | None) -> float:
    """The mean gradient of every third pixel of every third row inside."""
    if image is None or image.shape[0] < 3 or image.shape[1] < 3:
        return 0.0
    return float(_sobel(_grey(image, float), slice(1, image.shape[0] - 1, GRID), slice(1, image.shape[1] - 1, GRID)).mean())


def sharpness(height: Column, width: Column, bgr: Column) -> Column:
    """`sharpness_of` as a column: the score by which `colour.best_of_bucket` picks frames."""

    @F.pandas_udf("double")
    def score(h: pd.Series, w: pd.Series, d: pd.Series) -> pd.Series:
        return pd.Series([sharpness_of(raster(a, b, c)) for a, b, c in zip(h, w, d, strict=True)], dtype=float)

    return score(height, width, bgr)


def _exploded(images: DataFrame, key: str, columns: dict[str, str], values) -> DataFrame:
    """key, u, v and columns: a row for each pixel. values: gives a flat array for each column."""
    kind = images.schema[key].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, h, w, d in zip(batch.column(0), *(c.to_pylist() for c in batch.columns[1:]), strict=True):
                image = raster(h, w, d)
                if image is None:
                    continue
                v, u = np.indices(image.shape[:2]).reshape(2, -1)
                made = [pa.array(x) for x in (u.astype(np.int32), v.astype(np.int32), *values(image))]
                yield pa.RecordBatch.from_arrays([pa.repeat(k, len(u)), *made], [key, "u", "v", *columns])

    schema = T.StructType([T.StructField(key, kind), T.StructField("u", T.IntegerType()), T.StructField("v", T.IntegerType())])
    for name, t in columns.items():
        schema = schema.add(name, t)
    return images.select(key, "height", "width", "bgr").mapInArrow(run, schema)


def pixels(images: DataFrame, key: str) -> DataFrame:
    """key, u, v, b, g, r of every pixel."""
    return _exploded(images, key, {"b": "integer", "g": "integer", "r": "integer"}, lambda i: [i[:, :, k].ravel().astype(np.int32) for k in range(3)])


def gradients(images: DataFrame, key: str) -> DataFrame:
    """key, u, v and the gradient of every pixel."""
    return _exploded(images, key, {"gradient": "double"}, lambda i: [sobel(i).ravel().astype(float)])


def bilinear(values: np.ndarray, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Samples of an array (height, width, channels) at places, which are clamped to it; not-a-number gives 0."""
    height, width, _ = values.shape
    bad = np.isnan(u) | np.isnan(v)
    cu, cv = (np.clip(np.where(bad, 0.0, x), 0, n - 1) for x, n in ((u, width), (v, height)))
    u0, v0 = cu.astype(int), cv.astype(int)
    u1, v1 = np.minimum(u0 + 1, width - 1), np.minimum(v0 + 1, height - 1)
    fu, fv = (cu - u0)[:, None], (cv - v0)[:, None]
    out = (1 - fu) * (1 - fv) * values[v0, u0] + fu * (1 - fv) * values[v0, u1] + (1 - fu) * fv * values[v1, u0] + fu * fv * values[v1, u1]
    return np.where(bad[:, None], 0.0, out)


def linear_table() -> np.ndarray:
    """The linear light of each code value."""
    s = np.arange(256) / 255.0
    return np.where(s <= 0.04045, s / 12.92, ((s + 0.055) / 1.055) ** 2.4)


def sampled(images: DataFrame, samples: DataFrame, key: str, linear: bool = True, chunk: int = 100_000) -> DataFrame:
    """The samples (key, u, v, more) with b, g, r (in linear light, or as code values) and gradient, each between the four pixels around.

    Samples meet their image in chunks of about `chunk`, dealt by a hash of the
    sample: an image that holds most samples goes to as many tasks as it has chunks.
    Samples without an image are left out.
    """
    rest = [c for c in samples.columns if c not in ("b", "g", "r", "gradient")]
    counts = samples.groupBy(key).agg(F.ceil(F.count("*") / F.lit(chunk)).alias("_chunks"))
    held = samples.select(F.struct(*rest).alias("_s"), key)
    dealt = held.join(counts, key).withColumn("_c", F.pmod(F.xxhash64("_s"), F.col("_chunks")))
    lists = dealt.groupBy(key, "_c").agg(F.collect_list("_s").alias("_s"))
    met = lists.join(images.select(key, "height", "width", "bgr"), key).select("height", "width", "bgr", "_s")
    table = linear_table() if linear else np.arange(256.0)
    found = T.StructType([T.StructField("s", met.schema["_s"].dataType), *[T.StructField(c, T.ArrayType(T.DoubleType())) for c in ("b", "g", "r", "gradient")]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for k, (h, w, d) in enumerate(zip(*(c.to_pylist() for c in batch.columns[:3]), strict=True)):
                own = batch.column(3)[k].values
                u, v = (np.array(own.field(c).to_pylist(), float) for c in ("u", "v"))
                image = raster(h, w, d)
                if image is None:
                    got = np.zeros((len(u), 4))
                else:
                    got = np.concatenate([bilinear(table[image], u, v), bilinear(sobel(image).astype(float)[:, :, None], u, v)], axis=1)
                out.append([got[:, c].tolist() for c in range(4)])
            columns = [pa.array([o[c] for o in out], pa.list_(pa.float64())) for c in range(4)]
            yield pa.RecordBatch.from_arrays([batch.column(3), *columns], ["s", "b", "g", "r", "gradient"])

    made = met.mapInArrow(run, found)
    each = made.select(F.explode(F.arrays_zip("s", "b", "g", "r", "gradient")).alias("e"))
    return each.select(*[F.col("e.s")[c].alias(c) for c in rest], *[F.col("e")[c].alias(c) for c in ("b", "g", "r", "gradient")])


# ---- lenses ----


def distorted(x: np.ndarray, y: np.ndarray, d: Sequence[float]) -> tuple[np.ndarray, np.ndarray]:
    """Distorted normalised coordinates by the radial and tangential terms k1 k2 p1 p2 k3 k4 k5 k6."""
    k1, k2, p1, p2, k3, k4, k5, k6 = [*d, *[0.0] * (8 - len(d))][:8]
    r2 = x * x + y * y
    radial = (1 + r2 * (k1 + r2 * (k2 + r2 * k3))) / (1 + r2 * (k4 + r2 * (k5 + r2 * k6)))
    return x * radial + 2 * p1 * x * y + p2 * (r2 + 2 * x * x), y * radial + p1 * (r2 + 2 * y * y) + 2 * p2 * x * y


def undistort_map(camera: dict, height: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Where each pixel of the straightened image lies in the raw one: u and v, of (height, width).

    camera: width, height, k, d, r, p. Where its size is another one, k and p are
    scaled to the image's. r counts only if it is finite and not all zero.
    """
    k, p = np.array(camera["k"], float).reshape(3, 3), np.array(camera["p"], float).reshape(3, 4).copy()
    if camera["width"] and camera["height"] and (camera["width"], camera["height"]) != (width, height):
        scale = np.array([[width / camera["width"]], [height / camera["height"]], [1.0]])
        k, p = k * scale, p * scale
    r = np.array(camera["r"], float).reshape(3, 3)
    if not np.isfinite(r).all() or not r.any():
        r = np.eye(3)
    back = np.linalg.inv(p[:, :3] @ r)
    v, u = np.indices((height, width)).astype(float)
    x, y, w = (back[i, 0] * u + back[i, 1] * v + back[i, 2] for i in range(3))
    x, y = distorted(x / w, y / w, camera["d"])
    return k[0, 0] * x + k[0, 2], k[1, 1] * y + k[1, 2]


def remap(image: np.ndarray, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """The image's values at the places of a map, between pixels in steps of 1 / 32, rounded; 0 beyond its border."""
    height, width, _ = image.shape
    # places far outside, or none at all, are beyond the border
    su, sv = (np.rint(np.clip(np.nan_to_num(m.astype(np.float32), nan=-1e6), -1e6, 1e6) * STEPS).astype(np.int64) for m in (u, v))
    u0, v0, fu, fv = su // STEPS, sv // STEPS, su % STEPS, sv % STEPS
    total = np.zeros((*u.shape, 3), np.int64)
    for dv, wv in ((0, STEPS - fv), (1, fv)):
        for du, wu in ((0, STEPS - fu), (1, fu)):
            at_u, at_v = u0 + du, v0 + dv
            inside = (at_u >= 0) & (at_u < width) & (at_v >= 0) & (at_v < height)
            value = image[np.clip(at_v, 0, height - 1), np.clip(at_u, 0, width - 1)].astype(np.int64)
            total += np.where(inside, wu * wv, 0)[:, :, None] * value
    return ((total + STEPS * STEPS // 2) // (STEPS * STEPS)).astype(np.uint8)


def straightened(images: DataFrame, camera: dict) -> DataFrame:
    """The images of one camera with bgr without its distortion; a task makes the map once for each size. Images that do not fit their bytes have null."""
    names = images.columns
    at = [names.index(c) for c in ("height", "width", "bgr")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        maps: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            out = []
            for h, w, d in zip(*(batch.column(i).to_pylist() for i in at), strict=True):
                image = raster(h, w, d)
                if image is None:
                    out.append(None)
                    continue
                if (h, w) not in maps:
                    maps[h, w] = undistort_map(camera, h, w)
                out.append(remap(image, *maps[h, w]).tobytes())
            columns = list(batch.columns)
            columns[at[2]] = pa.array(out, pa.binary())
            yield pa.RecordBatch.from_arrays(columns, names)

    return images.mapInArrow(run, images.schema)


#: Points along each side from which the rectangles of a straightened image are found, and rounds of the inverse.
SIDE, ROUNDS = 9, 5


def _rectangles(k: np.ndarray, d: np.ndarray, width: np.ndarray, height: np.ndarray) -> tuple[tuple[np.ndarray, ...], tuple[np.ndarray, ...]]:
    """x, y, width, height of the largest rectangle inside the straightened border, and of the smallest around it, in normalised coordinates.

    Of many cameras at once: k is (n, 9), d (n, 8), width and height are (n,).
    """
    k1, k2, p1, p2, k3, k4, k5, k6 = (d[:, j, None, None] for j in range(8))
    k, width, height = k[:, :, None, None], width[:, None, None], height[:, None, None]
    v, u = np.indices((SIDE, SIDE)).astype(float)
    xd, yd = (u * (width - 1) / (SIDE - 1) - k[:, 2]) / k[:, 0], (v * (height - 1) / (SIDE - 1) - k[:, 5]) / k[:, 4]
    x, y = xd, yd
    for _ in range(ROUNDS):
        r2 = x * x + y * y
        back = (1 + r2 * (k4 + r2 * (k5 + r2 * k6))) / (1 + r2 * (k1 + r2 * (k2 + r2 * k3)))
        x, y = (xd - 2 * p1 * x * y - p2 * (r2 + 2 * x * x)) * back, (yd - p1 * (r2 + 2 * y * y) - 2 * p2 * x * y) * back
    left, right, top, bottom = x[:, :, 0].max(axis=1), x[:, :, -1].min(axis=1), y[:, 0].max(axis=1), y[:, -1].min(axis=1)
    low, high = [a.min(axis=(1, 2)) for a in (x, y)], [a.max(axis=(1, 2)) for a in (x, y)]
    return (left, top, right - left, bottom - top), (*low, high[0] - low[0], high[1] - low[1])


def projection_of(camera: dict, alpha: float) -> tuple[list[float] | None, str | None]:
    """The projection matrix that shows a straightened image, or why there is none.

    alpha 0 shows only what the raw image covers, 1 all of it; between, the two are
    blended. A camera that is one of a stereo pair, or a fisheye, has none.
    """
    return projections_of([camera], alpha)[0]


def projections_of(cameras: Sequence[dict], alpha: float) -> list[tuple[list[float] | None, str | None]]:
    """`projection_of` for many cameras: those with a distorted lens are worked out together."""
    out = [_plain_projection(c, alpha) for c in cameras]
    bent = [n for n, found in enumerate(out) if found is None]
    for start in range(0, len(bent), 4096):
        rows = bent[start : start + 4096]
        k = np.array([cameras[n]["k"] for n in rows], float)
        d = np.array([[*map(float, cameras[n]["d"]), *[0.0] * 8][:8] for n in rows])
        width, height = (np.array([cameras[n][c] for n in rows]) for c in ("width", "height"))
        blended = []
        for x, y, w, h in _rectangles(k, d, width, height):
            fx, fy = (width - 1) / w, (height - 1) / h
            blended.append((fx, -fx * x, fy, -fy * y))
        made = np.column_stack([(1 - alpha) * a + alpha * b for a, b in zip(*blended, strict=True)])
        for n, (fx, cx, fy, cy) in zip(rows, made.tolist(), strict=True):
            m = [fx, 0.0, cx, 0.0, 0.0, fy, cy, 0.0, 0.0, 0.0, 1.0, 0.0]
            out[n] = (m, None) if np.isfinite(m).all() else (None, "the matrix is not finite")
    return out


def _plain_projection(camera: dict, alpha: float) -> tuple[list[float] | None, str | None] | None:
    """What needs no lens: the plain matrix or why there is none; None for a distorted lens."""
    k, model = [float(v) for v in camera["k"]], camera["distortion_model"] or ""
    plain = [k[0], k[1], k[2], 0.0, k[3], k[4], k[5], 0.0, k[6], k[7], k[8], 0.0]
    r, d = np.array(camera["r"], float), [float(v) for v in (camera["d"] if camera["d"] is not None else [])]
    if not 0 <= alpha <= 1:
        return None, f"alpha must be from 0 to 1, not {alpha}"
    if not camera["width"] or not camera["height"]:
        return None, f"the image size is {camera['width']} x {camera['height']}"
    if not np.isfinite(k).all():
        return None, "k is not finite"
    if k[0] <= 0 or k[4] <= 0:
        return None, "k has no focal length"
    if r.any() and not (np.isfinite(r).all() and (np.abs(r - np.eye(3).ravel()) <= 1e-9).all()):
        return None, "r is not the identity: the camera is one of a stereo pair"
    if camera["p"][3] != 0 or camera["p"][7] != 0:
        return None, "p holds the baseline of a stereo pair"
    if model in ("equidistant", "fisheye"):
        return None, f"{model} is a fisheye model"
    if model in ("", "none"):
        return plain, None
    if model not in ("plumb_bob", "rational_polynomial"):
        return None, f"{model} is not supported"
    if not any(d):
        return plain, None
    if not np.isfinite(d).all():
        return None, "d is not finite"
    return None


def projections(cameras: DataFrame, alpha: float) -> DataFrame:
    """Camera infos (width, height, distortion_model, d, k, r, p) with `projection`, null where `refused` says why."""

    @F.pandas_udf("projection array<double>, refused string")
    def made(w: pd.Series, h: pd.Series, m: pd.Series, d: pd.Series, k: pd.Series, r: pd.Series, p: pd.Series) -> pd.DataFrame:
        names = ("width", "height", "distortion_model", "d", "k", "r", "p")
        with np.errstate(all="ignore"):
            rows = projections_of([dict(zip(names, row, strict=True)) for row in zip(w, h, m, d, k, r, p, strict=True)], alpha)
        return pd.DataFrame(rows, columns=["projection", "refused"])

    found = cameras.withColumn("_p", made("width", "height", "distortion_model", "d", "k", "r", "p"))
    return found.select(*cameras.columns, "_p.projection", "_p.refused")
