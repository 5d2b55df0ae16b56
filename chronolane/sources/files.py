"""Point clouds, trajectories and static trees as files."""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronolane.functions import text
from chronolane.sources.calibration import mapping

TREE_KEYS = ("x", "y", "z", "roll", "pitch", "yaw")


def read_tum(spark: SparkSession, path: str) -> DataFrame:
    return text.parse_tum(spark.read.text(path))


def write_tum(poses: DataFrame, path: str) -> None:
    """Trajectory lines, sorted in time; a part file for each range of time."""
    line = text.tum_line(F.col("timestamp_ns"), [F.col(c) for c in ("tx", "ty", "tz", "qx", "qy", "qz", "qw")])
    poses.orderBy("timestamp_ns").select(line.alias("value")).write.text(path)


def parse_pcd(data: bytes) -> np.ndarray:
    """The points of a binary or text PCD file as a structured array."""
    head, at = {}, 0
    while True:
        end = data.index(b"\n", at)
        line, at = data[at:end].decode().strip(), end + 1
        if line and not line.startswith("#"):
            key, *rest = line.split()
            head[key] = rest
            if key == "DATA":
                break
    kinds = {("F", "4"): "<f4", ("F", "8"): "<f8", ("U", "1"): "u1", ("U", "2"): "<u2", ("U", "4"): "<u4", ("I", "1"): "i1", ("I", "2"): "<i2", ("I", "4"): "<i4"}
    dtype = np.dtype([(f, kinds[t, s]) for f, t, s in zip(head["FIELDS"], head["TYPE"], head["SIZE"], strict=True)])
    n = int(head["POINTS"][0])
    if head["DATA"] == ["binary"]:
        return np.frombuffer(data, dtype, n, at)
    if head["DATA"] == ["ascii"]:
        rows = [tuple(line.split()) for line in data[at:].decode().splitlines() if line.strip()][:n]
        return np.array(rows, dtype)
    raise ValueError(f"unknown PCD data {head['DATA']}")


def format_pcd(points: np.ndarray) -> bytes:
    """A binary PCD file of a structured array."""
    kind = {"f": "F", "u": "U", "i": "I"}
    names = points.dtype.names
    types = [points.dtype[n] for n in names]
    lines = ["# .PCD v0.7 - Point Cloud Data file format", "VERSION 0.7", "FIELDS " + " ".join(names), "SIZE " + " ".join(str(t.itemsize) for t in types), "TYPE " + " ".join(kind[t.kind] for t in types), "COUNT " + " ".join("1" for _ in names), f"WIDTH {len(points)}", "HEIGHT 1", "VIEWPOINT 0 0 0 1 0 0 0", f"POINTS {len(points)}", "DATA binary"]
    return "\n".join(lines).encode() + b"\n" + np.ascontiguousarray(points).tobytes()


def read_pcd(spark: SparkSession, path: str) -> DataFrame:
    """path, idx, x, y, z and intensity (null where there is none) of PCD files: a task reads a file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0), batch.column(1), strict=True):
                p = parse_pcd(content.as_py())
                for at in range(0, len(p), 1 << 16):
                    part = p[at : at + (1 << 16)]
                    n = len(part)
                    strength = pa.array(part["intensity"].astype(float)) if "intensity" in p.dtype.names else pa.nulls(n, pa.float64())
                    yield pa.RecordBatch.from_arrays([pa.array([name.as_py()] * n), pa.array(np.arange(at, at + n)), *(pa.array(part[a].astype(float)) for a in "xyz"), strength], ["path", "idx", "x", "y", "z", "intensity"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, "path string, idx long, x double, y double, z double, intensity double")


def write_pcd(points: DataFrame, path: str, parts: int) -> None:
    """A PCD file for each of `parts` hash parts of the points (x, y, z and, if there, intensity), in a folder the executors share."""
    names = [c for c in ("x", "y", "z", "intensity") if c in points.columns]
    os.makedirs(path, exist_ok=True)

    def run(t: pa.Table) -> pa.Table:
        out = np.empty(t.num_rows, [(c, "<f4") for c in names])
        for c in names:
            out[c] = t.column(c).to_numpy()
        part = t.column("part")[0].as_py()
        temp, last = os.path.join(path, f".{part}-{os.getpid()}.tmp"), os.path.join(path, f"part-{part:05d}.pcd")
        with open(temp, "wb") as f:
            f.write(format_pcd(out))
        os.replace(temp, last)  # a task that runs twice leaves one file
        return pa.table({"n": [t.num_rows]})

    dealt = points.select(*names, F.pmod(F.xxhash64("idx"), F.lit(parts)).cast("int").alias("part"))
    dealt.groupBy("part").applyInArrow(run, "n long").agg(F.sum("n")).collect()


def static_tree(value: dict, depth: int = 32) -> list[tuple[str, str, float, float, float, float, float, float]]:
    """Edges (parent, child, x, y, z, roll, pitch, yaw) of a nested mapping.

    A mapping with exactly the six keys is a transform; the name right above it
    is the parent, higher ones are headings.
    """
    out = []

    def walk(node: object, name: str | None, level: int) -> None:
        if level > depth:
            raise ValueError("nested too deeply")
        if not isinstance(node, dict):
            raise ValueError(f"{name!r} is no mapping")
        for key, below in node.items():
            if not isinstance(below, dict):
                raise ValueError(f"unknown key {key!r}")
            if set(below) & set(TREE_KEYS):
                if set(below) != set(TREE_KEYS):
                    raise ValueError(f"{key!r} must have the keys {', '.join(TREE_KEYS)}")
                if name is None:
                    raise ValueError(f"{key!r} has no parent")
                out.append((name, str(key), *(float(below[k]) for k in TREE_KEYS)))
            else:
                walk(below, str(key), level + 1)

    walk(value, None, 0)
    return out


def read_static_tree(spark: SparkSession, path: str) -> DataFrame:
    """Edges of a calibration file (YAML, or JSON where no YAML library is there)."""
    with open(path) as f:
        value = mapping(f.read())
    return spark.createDataFrame(static_tree(value), "parent string, child string, x double, y double, z double, roll double, pitch double, yaw double")
