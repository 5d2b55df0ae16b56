"""Packed point clouds: to points and back, motion correction, concatenation.

`merged` joins whole packed clouds, `assembled` does so for groups of messages that
picks name; `chronolane.streaming.assembly` does the same as messages arrive.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronolane.functions import cdr
from chronolane.functions import geometry as G
from chronolane.operators import asof, spatial
from chronolane.operators.frames import POSE, pose

#: Point field kinds of the message format: fixed values.
KINDS = {1: "i1", 2: "u1", 3: "i2", 4: "u2", 5: "i4", 6: "u4", 7: "f4", 8: "f8"}
#: Names of the time field, the first of them first, and the kinds it may have (whole nanoseconds, seconds): fixed values.
TIME_FIELDS, TIME_KINDS = ("t", "time", "time_stamp", "timestamp"), (6, 7, 8)
#: Fixed value: the public message definition, for recordings that carry none.
POINT_CLOUD = "===\n".join(
    [
        "std_msgs/Header header\nuint32 height\nuint32 width\nsensor_msgs/PointField[] fields\nbool is_bigendian\nuint32 point_step\nuint32 row_step\nuint8[] data\nbool is_dense\n",
        "MSG: std_msgs/Header\nbuiltin_interfaces/Time stamp\nstring frame_id\n",
        "MSG: sensor_msgs/PointField\nstring name\nuint32 offset\nuint8 datatype\nuint32 count\n",
    ]
)
_DEFINITIONS = cdr.parse(POINT_CLOUD)
#: What `assembled` gives of a group.
ASSEMBLED = "group_id long, stamp_ns long, payload binary, merged int, wanted int, failed array<int>, error string"


def unpack(cloud: dict) -> dict[str, np.ndarray]:
    """The columns of a cloud: fields (name, offset, datatype), data, width, height, point_step, row_step, is_bigendian."""
    if cloud["is_bigendian"]:
        raise ValueError("big-endian clouds are not read")
    step, row, w, h = (cloud[k] for k in ("point_step", "row_step", "width", "height"))
    if row < step * w:
        raise ValueError("rows are shorter than their points")
    if any(f["offset"] + np.dtype(KINDS[f["datatype"]]).itemsize > step for f in cloud["fields"]):
        raise ValueError("a field reaches past its point")
    dtype = np.dtype({"names": [f["name"] for f in cloud["fields"]], "formats": ["<" + KINDS[f["datatype"]] for f in cloud["fields"]], "offsets": [f["offset"] for f in cloud["fields"]], "itemsize": step})
    lines = [np.frombuffer(cloud["data"], dtype, w, r * row) for r in range(h)]
    p = np.concatenate(lines) if lines else np.zeros(0, dtype)
    return {n: p[n] for n in dtype.names}


def seconds(values: np.ndarray, kind: int) -> np.ndarray:
    """Point times in seconds: whole numbers are nanoseconds."""
    return values.astype(float) if kind in (7, 8) else values.astype(float) / 1e9


def points(clouds: DataFrame) -> DataFrame:
    """cloud_seq, header_stamp_ns, point_idx, x, y, z, intensity and t (seconds; null without a time field) of packed clouds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for c in batch.to_pylist():
                p = unpack(c)
                n = len(p["x"])
                named = {f["name"]: f for f in c["fields"] if f["datatype"] in TIME_KINDS and f.get("count", 1) == 1}
                field = next((named[n] for n in TIME_FIELDS if n in named), None)
                t = pa.array(seconds(p[field["name"]], field["datatype"])) if field else pa.nulls(n, pa.float64())
                strength = pa.array(p["intensity"].astype(float)) if "intensity" in p else pa.nulls(n, pa.float64())
                full = lambda v: pa.array(np.full(n, v, np.int64))  # noqa: E731, B023
                yield pa.RecordBatch.from_arrays([full(c["cloud_seq"]), full(c["header_stamp_ns"]), pa.array(np.arange(n)), *(pa.array(p[a].astype(float)) for a in "xyz"), strength, t], ["cloud_seq", "header_stamp_ns", "point_idx", "x", "y", "z", "intensity", "t"])

    return clouds.mapInArrow(run, "cloud_seq long, header_stamp_ns long, point_idx long, x double, y double, z double, intensity double, t double")


def stamped(exploded: DataFrame) -> DataFrame:
    """Adds timestamp_ns of each point: its time is counted from the header where no time of the cloud reaches a million seconds."""
    finite = F.when(~F.isnan("t") & (F.abs("t") < float("inf")), F.abs("t"))
    most = exploded.groupBy("cloud_seq").agg(F.coalesce(F.max(finite) < 1e6, F.lit(True)).alias("relative"))
    whole = F.round(F.col("t") * 1e9).cast("long")
    return exploded.join(most, "cloud_seq").withColumn("timestamp_ns", F.when(F.col("relative"), F.col("header_stamp_ns") + whole).otherwise(whole)).drop("relative")


def at_poses(exploded: DataFrame, trajectory: DataFrame) -> DataFrame:
    """Adds the interpolated pose (pt.., pq..) at each point's timestamp_ns, clamped to the trajectory's ends."""
    found = asof.neighbours(exploded, trajectory.select("timestamp_ns", F.col("timestamp_ns").alias("seq"), *POSE), list(POSE))
    prev, ahead = F.coalesce("prev", "next"), F.coalesce("next", "prev")
    found = found.withColumn("prev", prev).withColumn("next", ahead)
    gap = F.col("next.timestamp_ns") - F.col("prev.timestamp_ns")
    f = F.when(gap == 0, F.lit(0.0)).otherwise((F.col("timestamp_ns") - F.col("prev.timestamp_ns")) / gap)
    (ta, qa), (tb, qb) = pose("prev."), pose("next.")
    t, q = [a + (b - a) * f for a, b in zip(ta, tb, strict=True)], G.slerp(qa, qb, f)
    return found.withColumns({f"p{c}": v for c, v in zip(POSE, [*t, *q], strict=True)}).drop("prev", "next")


def world(exploded: DataFrame, trajectory: DataFrame) -> DataFrame:
    """Points carried into the trajectory's frame."""
    out = at_poses(exploded, trajectory)
    moved = G.transform((F.col("x"), F.col("y"), F.col("z")), *pose("p"))
    return out.withColumns(dict(zip("xyz", moved, strict=True))).drop(*[f"p{c}" for c in POSE])


def mapped(exploded: DataFrame, trajectory: DataFrame, size: float) -> DataFrame:
    """A voxel map (`spatial.voxels`) of the points carried into the trajectory's frame; points outside its span, ends included, go.

    Points meet poses stretch by stretch, and a voxel's sums are made before the
    shuffle, so neither a topic nor a crowded voxel lies in one task. A trajectory
    without poses gives no voxels.
    """
    span = trajectory.agg(F.min("timestamp_ns").alias("_low"), F.max("timestamp_ns").alias("_high"))  # one row
    names = exploded.columns
    inside = exploded.join(F.broadcast(span), F.col("timestamp_ns").between(F.col("_low"), F.col("_high"))).select(*names)
    return spatial.voxels(world(inside, trajectory), size)


def deskewed(exploded: DataFrame, trajectory: DataFrame, extrinsic: tuple[float, ...] = (0, 0, 0, 0, 0, 0, 1)) -> DataFrame:
    """Points as if all were taken at the header stamp: E^-1 (T_ref^-1 T_i) E p; points without a time or a finite place stay."""
    timed = stamped(exploded)
    at = at_poses(timed.where("t IS NOT NULL AND NOT isnan(x) AND NOT isnan(y) AND NOT isnan(z)"), trajectory)
    ref = timed.select("cloud_seq", F.col("header_stamp_ns").alias("timestamp_ns")).distinct()
    ref = at_poses(ref, trajectory).select("cloud_seq", *[F.col(f"p{c}").alias(f"r{c}") for c in POSE])
    e = [F.lit(float(v)) for v in extrinsic]
    te, qe = tuple(e[:3]), tuple(e[3:])
    p = G.transform((F.col("x"), F.col("y"), F.col("z")), te, qe)
    p = G.transform(p, *pose("p"))
    both = at.join(ref, "cloud_seq")
    both = both.withColumns(dict(zip(("_x", "_y", "_z"), p, strict=True)))
    p = G.transform((F.col("_x"), F.col("_y"), F.col("_z")), *G.inverse(*pose("r")))
    p = G.transform(p, *G.inverse(te, qe))
    fixed = both.withColumns(dict(zip("xyz", p, strict=True))).select(*exploded.columns)
    rest = timed.where("t IS NULL OR isnan(x) OR isnan(y) OR isnan(z)").select(*exploded.columns)
    return fixed.unionByName(rest)


def concatenated(parts: list[DataFrame], stamp_ns: int) -> DataFrame:
    """Clouds' points as one cloud in the order given: relative times are counted from the new stamp, idx is (part, point_idx)."""
    out = None
    for k, p in enumerate(parts):
        moved = p.withColumn("part", F.lit(k)).withColumn("t", F.col("t") + (F.col("header_stamp_ns") - stamp_ns) / 1e9).withColumn("header_stamp_ns", F.lit(stamp_ns))
        out = moved if out is None else out.unionByName(moved)
    return out


# ---- whole clouds ----


def parsed(payload: bytes) -> dict:
    """A cloud message; ValueError says what is wrong with it."""
    try:
        return cdr.Reader(payload).message(_DEFINITIONS)
    except struct.error as e:
        raise ValueError(str(e)) from e


def stamp_of(cloud: Mapping) -> int:
    t = cloud["header"]["stamp"]
    return t["sec"] * 1_000_000_000 + t["nanosec"]


def _block(cloud: Mapping) -> np.ndarray:
    """A copy of the points' bytes, a row for each point; what pads the data goes."""
    n, step = cloud["height"] * cloud["width"], cloud["point_step"]
    if len(cloud["data"]) < n * step:
        raise ValueError("the data is shorter than its points")
    return np.frombuffer(cloud["data"], np.uint8, n * step).reshape(n, step).copy()


def _column(block: np.ndarray, field: Mapping) -> np.ndarray:
    """A field of a block as a view that writes through."""
    kind = np.dtype("<" + KINDS[field["datatype"]])
    if field["offset"] + kind.itemsize > block.shape[1]:
        raise ValueError(f"the field {field['name']} reaches past its point")
    return np.ndarray((len(block),), kind, block, field["offset"], (block.shape[1],))


def moved(cloud: Mapping, pose_: Sequence[float]) -> dict:
    """The cloud carried by a pose (tx .. qw): fields x, y and z, floating, all finite places moved."""
    by = {f["name"]: f for f in cloud["fields"]}
    if cloud["is_bigendian"] or any(a not in by or by[a]["datatype"] not in (7, 8) for a in "xyz"):
        raise ValueError("a cloud without floating little-endian x, y and z cannot be moved")
    block = _block(cloud)
    if len(block):
        q = np.array(pose_[3:], float) / np.linalg.norm(pose_[3:])
        views = [_column(block, by[a]) for a in "xyz"]
        p = np.stack([v.astype(float) for v in views], axis=1)
        u, w = q[:3], q[3]
        there = p + 2 * np.cross(u, np.cross(u, p) + w * p) + np.array(pose_[:3], float)
        fine = np.isfinite(p).all(axis=1)
        for k, v in enumerate(views):
            v[fine] = there[fine, k]
    return {**cloud, "data": block.tobytes()}


def _time_field(cloud: Mapping) -> Mapping | None:
    named = {f["name"]: f for f in cloud["fields"] if f["datatype"] in TIME_KINDS and f["count"] == 1}
    return next((named[n] for n in TIME_FIELDS if n in named), None)


def merged(clouds_: Sequence[Mapping], stamp_ns: int, frame: str) -> dict:
    """One flat cloud of all the clouds' points, in order, with the stamp.

    All must have the same fields and point_step, as points are copied whole.
    Times that count from the header are counted from the new stamp: seconds in
    place; whole nanoseconds, which cannot be negative, become 32-bit seconds.
    Seconds count from the header unless the first finite one lies nearer to its
    cloud's stamp than to zero; without a finite one they stay.
    """
    if not clouds_:
        raise ValueError("there is no cloud")
    first = clouds_[0]
    if any(c["is_bigendian"] for c in clouds_):
        raise ValueError("big-endian clouds are not read")
    if first["point_step"] == 0:
        raise ValueError("points have no size")
    if any(c["point_step"] != first["point_step"] or c["fields"] != first["fields"] for c in clouds_):
        raise ValueError("the clouds' fields differ")
    blocks, field, fields = [_block(c) for c in clouds_], _time_field(first), first["fields"]
    if field:
        times = [_column(b, field) for b in blocks]
        shifts = [(stamp_of(c) - stamp_ns) * 1e-9 for c in clouds_]
        if field["datatype"] == 6:
            fields = [{**f, "datatype": 7} if f["offset"] == field["offset"] else f for f in fields]
            for b, t, shift in zip(blocks, times, shifts, strict=True):
                _column(b, {**field, "datatype": 7})[:] = (t.astype(float) * 1e-9 + shift).astype(np.float32)
        else:
            sample = next(((float(t[np.isfinite(t)][0]), stamp_of(c) * 1e-9) for t, c in zip(times, clouds_, strict=True) if np.isfinite(t).any()), None)
            if sample and abs(sample[0] - sample[1]) >= abs(sample[0]):
                for t, shift in zip(times, shifts, strict=True):
                    fine = np.isfinite(t)
                    t[fine] = t[fine].astype(float) + shift
    n = sum(map(len, blocks))
    header = {"stamp": {"sec": stamp_ns // 1_000_000_000, "nanosec": stamp_ns % 1_000_000_000}, "frame_id": frame}
    return {
        "header": header, "height": 1, "width": n, "fields": fields, "is_bigendian": False, "point_step": first["point_step"],
        "row_step": n * first["point_step"], "data": b"".join(b.tobytes() for b in blocks), "is_dense": all(c["is_dense"] for c in clouds_),
    }


def joined(picks: Sequence[tuple[int, bytes]], group: int, stamp_ns: int, wanted: int, frame: str, poses: Mapping[int, Sequence[float]]) -> tuple:
    """A row of ASSEMBLED from a group's picks (part, payload), taken in order of the parts.

    A payload that cannot be read or moved fails and is left out; without any that
    can there is no payload; clouds that do not fit together are an error.
    """
    read, failed = [], []
    for part, payload in sorted(picks):
        try:
            cloud = parsed(payload)
            read.append(moved(cloud, poses[part]) if part in poses else cloud)
        except ValueError:
            failed.append(part)
    try:
        payload = cdr.encode(POINT_CLOUD, merged(read, stamp_ns, frame)) if read else None
    except ValueError as e:
        return group, stamp_ns, None, 0, wanted, failed, str(e)
    return group, stamp_ns, payload, len(read), wanted, failed, None


def assembled(messages: DataFrame, picks: DataFrame, frame: str, poses: Mapping[int, Sequence[float]] | None = None) -> DataFrame:
    """ASSEMBLED for each group of picks (group_id, stamp_ns, part, topic, seq): the picked messages' clouds as one message.

    A message may be picked by several groups. A group of which a message is
    missing stays without a payload. poses: of each part's frame in `frame`. A
    task holds the clouds of one group, a few.
    """
    held = messages.select(F.col("topic").alias("_t"), F.col("seq").alias("_s"), "payload")
    found = picks.join(held, (F.col("topic") == F.col("_t")) & (F.col("seq") == F.col("_s")), "left").select("group_id", "stamp_ns", "part", "payload")
    at = dict(poses or {})

    def run(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        stamp, wanted, here = int(group["stamp_ns"].iloc[0]), len(group), group["payload"].notna()
        if here.all():
            row = joined(list(zip(group["part"].tolist(), group["payload"], strict=True)), key[0], stamp, wanted, frame, at)
        else:
            row = (key[0], stamp, None, 0, wanted, [], f"{int((~here).sum())} of {wanted} messages are missing")
        return pd.DataFrame([row], columns=[c.split()[0] for c in ASSEMBLED.split(", ")])

    return found.groupBy("group_id").applyInPandas(run, ASSEMBLED)


def packed(points_: DataFrame, frame: str) -> DataFrame:
    """cloud_seq, header_stamp_ns and payload: a cloud message for each cloud_seq of the points (point_idx, x, y, z, intensity, t), fields of four bytes, t left out where the cloud has none."""

    def run(key: tuple, p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values("point_idx")
        names = [*"xyz", "intensity"] + ([] if p["t"].isna().all() else ["t"])
        data, stamp = p[names].to_numpy("<f4").tobytes(), int(p["header_stamp_ns"].iloc[0])
        cloud = {"header": {"stamp": {"sec": 0, "nanosec": 0}, "frame_id": frame}, "height": 1, "width": len(p), "is_bigendian": False, "is_dense": True, "data": data}
        cloud |= {"fields": [{"name": n, "offset": 4 * k, "datatype": 7, "count": 1} for k, n in enumerate(names)], "point_step": 4 * len(names), "row_step": len(data)}
        cloud["header"]["stamp"] = {"sec": stamp // 1_000_000_000, "nanosec": stamp % 1_000_000_000}
        return pd.DataFrame([(key[0], stamp, cdr.encode(POINT_CLOUD, cloud))], columns=["cloud_seq", "header_stamp_ns", "payload"])

    return points_.groupBy("cloud_seq").applyInPandas(run, "cloud_seq long, header_stamp_ns long, payload binary")


def unpacked(messages: DataFrame) -> DataFrame:
    """`points` of cloud messages (cloud_seq, payload); the header's stamp is the message's own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for seq, payload in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                c = parsed(payload)
                rows.append({"cloud_seq": seq, "header_stamp_ns": stamp_of(c), **{k: c[k] for k in ("fields", "data", "width", "height", "point_step", "row_step", "is_bigendian")}})
            yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    field = pa.struct([("name", pa.string()), ("offset", pa.int64()), ("datatype", pa.int32()), ("count", pa.int64())])
    arrow = pa.schema([("cloud_seq", pa.int64()), ("header_stamp_ns", pa.int64()), ("fields", pa.list_(field)), ("data", pa.binary()), *[(k, pa.int64()) for k in ("width", "height", "point_step", "row_step")], ("is_bigendian", pa.bool_())])
    schema = "cloud_seq long, header_stamp_ns long, fields array<struct<name string, offset long, datatype int, count long>>, data binary, width long, height long, point_step long, row_step long, is_bigendian boolean"
    return points(messages.where("payload IS NOT NULL").select("cloud_seq", "payload").mapInArrow(run, schema))
