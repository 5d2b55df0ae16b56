"""Sensor messages as typed columns, from what `cdr.decoded` gives (topic, timestamp_ns, seq, message, error).

Messages that could not be read are left out; `unreadable` counts them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chronolane.functions import cdr

#: Public message definitions, for recordings that carry none.
_HEADER = "MSG: std_msgs/Header\nbuiltin_interfaces/Time stamp\nstring frame_id\n"
_VECTOR = "MSG: geometry_msgs/Vector3\nfloat64 x\nfloat64 y\nfloat64 z\n"
_QUATERNION = "MSG: geometry_msgs/Quaternion\nfloat64 x\nfloat64 y\nfloat64 z\nfloat64 w\n"
_TRANSFORM = "MSG: geometry_msgs/Transform\ngeometry_msgs/Vector3 translation\ngeometry_msgs/Quaternion rotation\n"
_STAMPED = "MSG: geometry_msgs/TransformStamped\nstd_msgs/Header header\nstring child_frame_id\ngeometry_msgs/Transform transform\n"
_ROI = "MSG: sensor_msgs/RegionOfInterest\nuint32 x_offset\nuint32 y_offset\nuint32 height\nuint32 width\nbool do_rectify\n"
_STATUS = "MSG: sensor_msgs/NavSatStatus\nint8 status\nuint16 service\n"
IMU = "===\n".join(
    [
        "std_msgs/Header header\ngeometry_msgs/Quaternion orientation\nfloat64[9] orientation_covariance\ngeometry_msgs/Vector3 angular_velocity\nfloat64[9] angular_velocity_covariance\ngeometry_msgs/Vector3 linear_acceleration\nfloat64[9] linear_acceleration_covariance\n",
        _HEADER,
        _VECTOR,
        _QUATERNION,
    ]
)
NAV_SAT_FIX = "===\n".join(["std_msgs/Header header\nsensor_msgs/NavSatStatus status\nfloat64 latitude\nfloat64 longitude\nfloat64 altitude\nfloat64[9] position_covariance\nuint8 position_covariance_type\n", _HEADER, _STATUS])
TF_MESSAGE = "===\n".join(["geometry_msgs/TransformStamped[] transforms\n", _HEADER, _VECTOR, _QUATERNION, _TRANSFORM, _STAMPED])
CAMERA_INFO = "===\n".join(["std_msgs/Header header\nuint32 height\nuint32 width\nstring distortion_model\nfloat64[] d\nfloat64[9] k\nfloat64[9] r\nfloat64[12] p\nuint32 binning_x\nuint32 binning_y\nsensor_msgs/RegionOfInterest roi\n", _HEADER, _ROI])

_ROW = ("topic", "timestamp_ns", "seq")


def stamp(header: Column) -> Column:
    """A header's stamp in nanoseconds."""
    t = header["stamp"]
    return t["sec"].cast("long") * 1_000_000_000 + t["nanosec"]


def _read(decoded: DataFrame) -> DataFrame:
    return decoded.where("message IS NOT NULL")


def _xyz(v: Column, prefix: str) -> list[Column]:
    return [v[a].alias(f"{prefix}{a}") for a in "xyz"]


def _pose(position: Column, orientation: Column) -> list[Column]:
    return [*_xyz(position, "t"), *[orientation[a].alias(f"q{a}") for a in "xyzw"]]


def unreadable(decoded: DataFrame) -> DataFrame:
    """topic, n and one of the errors, for topics with payloads that could not be read."""
    return decoded.where("message IS NULL").groupBy("topic").agg(F.count("*").alias("n"), F.min("error").alias("error"))


def transforms(decoded: DataFrame, static: list[str] = ("/tf_static",)) -> DataFrame:
    """A row for each transform of a message, in their order (pos): parent, child, stamp_ns, is_static and the pose."""
    e = _read(decoded).select(*_ROW, F.posexplode("message.transforms").alias("pos", "_t"))
    t = F.col("_t")
    at = [t["header"]["frame_id"].alias("parent"), t["child_frame_id"].alias("child"), stamp(t["header"]).alias("stamp_ns")]
    moved = t["transform"]
    return e.select(*_ROW, "pos", *at, F.col("topic").isin(*static).alias("is_static"), *_pose(moved["translation"], moved["rotation"]))


def _transform_struct() -> Column:
    """A row's transform (parent, child, stamp_ns and a pose) as the message has it."""
    header = F.struct(F.struct(F.floor(F.col("stamp_ns") / 1_000_000_000).cast("int").alias("sec"), F.pmod("stamp_ns", F.lit(1_000_000_000)).alias("nanosec")).alias("stamp"), F.col("parent").alias("frame_id"))
    vector = lambda prefix, axes: F.struct(*[F.col(f"{prefix}{a}").cast("double").alias(a) for a in axes])
    return F.struct(header.alias("header"), F.col("child").alias("child_frame_id"), F.struct(vector("t", "xyz").alias("translation"), vector("q", "xyzw").alias("rotation")).alias("transform"))


def moving_messages(rows: DataFrame, topic: str) -> DataFrame:
    """topic, timestamp_ns, seq and payload: a transform message for each row (parent, child, stamp_ns, a pose, seq) of a trajectory, at its stamp."""
    m = F.struct(F.array(_transform_struct()).alias("transforms"))
    made = rows.select(F.lit(topic).alias("topic"), F.col("stamp_ns").alias("timestamp_ns"), F.col("seq").cast("long").alias("seq"), m.alias("message"))
    return cdr.encoded(made, TF_MESSAGE)


def static_message(edges: DataFrame, topic: str, at_ns: int) -> DataFrame:
    """topic, timestamp_ns, seq and payload: one transform message with all edges of a static tree, by parent and child; none without edges."""
    t = F.struct(F.col("parent").alias("a"), F.col("child").alias("b"), _transform_struct().alias("t"))
    tree = edges.groupBy().agg(F.array_sort(F.collect_list(t), lambda x, y: F.when(F.struct(x["a"], x["b"]) < F.struct(y["a"], y["b"]), -1).when(F.struct(x["a"], x["b"]) > F.struct(y["a"], y["b"]), 1).otherwise(0)).alias("e")).where("size(e) > 0")
    m = F.struct(F.transform("e", lambda x: x["t"]).alias("transforms"))
    made = tree.select(F.lit(topic).alias("topic"), F.lit(at_ns).cast("long").alias("timestamp_ns"), F.lit(0).cast("long").alias("seq"), m.alias("message"))
    return cdr.encoded(made, TF_MESSAGE)


def poses(decoded: DataFrame) -> DataFrame:
    """stamp_ns, parent, child and the pose of stamped poses, with covariance or without, and of odometry; child and covariance are null where the message has none."""
    kind = decoded.schema["message"].dataType
    m = F.col("message")
    wide = "pose" in kind["pose"].dataType.names
    inner = m["pose"]["pose"] if wide else m["pose"]
    child = m["child_frame_id"] if "child_frame_id" in kind.names else F.lit(None).cast("string")
    spread = m["pose"]["covariance"] if wide else F.lit(None).cast("array<double>")
    return _read(decoded).select(*_ROW, stamp(m["header"]).alias("stamp_ns"), m["header"]["frame_id"].alias("parent"), child.alias("child"), *_pose(inner["position"], inner["orientation"]), spread.alias("covariance"))


def imu(decoded: DataFrame) -> DataFrame:
    """stamp_ns, frame_id, angular velocity (wx, wy, wz) and linear acceleration (ax, ay, az)."""
    m = F.col("message")
    return _read(decoded).select(*_ROW, stamp(m["header"]).alias("stamp_ns"), m["header"]["frame_id"].alias("frame_id"), *_xyz(m["angular_velocity"], "w"), *_xyz(m["linear_acceleration"], "a"))


def fixes(decoded: DataFrame) -> DataFrame:
    """stamp_ns, frame_id, status, latitude, longitude, altitude, covariance (nine numbers) and covariance_type."""
    m = F.col("message")
    place = [m[c].alias(c) for c in ("latitude", "longitude", "altitude")]
    return _read(decoded).select(*_ROW, stamp(m["header"]).alias("stamp_ns"), m["header"]["frame_id"].alias("frame_id"), m["status"]["status"].alias("status"), *place, m["position_covariance"].alias("covariance"), m["position_covariance_type"].alias("covariance_type"))


def camera_infos(decoded: DataFrame) -> DataFrame:
    """frame_id, height, width, distortion_model, d, k, r and p."""
    m = F.col("message")
    return _read(decoded).select(*_ROW, m["header"]["frame_id"].alias("frame_id"), *[m[c].alias(c) for c in ("height", "width", "distortion_model", "d", "k", "r", "p")])


def scaled(infos: DataFrame, x: float, y: float | None = None) -> DataFrame:
    """Camera infos of images resized by x and y (or x alike): sizes rounded half away from zero, the first two rows of k and p."""
    y = x if y is None else y

    def rows(name: str, wide: int, first: int) -> Column:
        factor = lambda i: F.when(i < wide, x).when((i >= first) & (i < 2 * wide), y).otherwise(1.0)
        return F.transform(name, lambda v, i: v * factor(i))

    size = lambda c, s: F.round(F.col(c).cast("double") * s).cast("long")
    return infos.withColumns({"width": size("width", x), "height": size("height", y), "k": rows("k", 3, 4), "p": rows("p", 4, 4)})


def with_camera(messages: DataFrame, topics: list[str], values: dict, schema_text: str = CAMERA_INFO) -> DataFrame:
    """The messages with these fields of the topics' camera infos replaced; header, binning, region and all else stay."""
    unknown = set(values) - {"height", "width", "distortion_model", "d", "k", "r", "p"}
    if unknown:
        raise ValueError(f"not of a calibration: {sorted(unknown)}")
    return cdr.edited(messages, schema_text, topics, lambda m: m | values)


def rasters(images: DataFrame) -> DataFrame:
    """Images (height, width, encoding, step, data) with `bgr`: rows of packed blue, green, red bytes.

    bgr8 and rgb8 are read, with padding at the ends of rows left out; other
    encodings, and data shorter than its rows, give null.
    """
    names = images.columns
    at = {c: names.index(c) for c in ("height", "width", "encoding", "step", "data")}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for height, width, encoding, step, data in zip(*(batch.column(at[c]).to_pylist() for c in at), strict=True):
                if encoding not in ("bgr8", "rgb8") or None in (height, width, step, data) or step < 3 * width or len(data) < step * height:
                    out.append(None)
                    continue
                pixels = np.frombuffer(data, np.uint8, step * height).reshape(height, step)[:, : 3 * width].reshape(height, width, 3)
                out.append((pixels if encoding == "bgr8" else pixels[:, :, ::-1]).tobytes())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.binary())], [*names, "bgr"])

    return images.mapInArrow(run, T.StructType([*images.schema.fields, T.StructField("bgr", T.BinaryType())]))
