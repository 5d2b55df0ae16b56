"""Camera calibrations and static trees as YAML files."""

from __future__ import annotations

import importlib.util
import json
import os
import re
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

COLUMNS = "width long, height long, camera_name string, distortion_model string, d array<double>, k array<double>, r array<double>, p array<double>"
#: The keys of a calibration file's matrices, the column each fills, and its rows and columns (None: any number).
MATRICES = (("camera_matrix", "k", 3, 3), ("distortion_coefficients", "d", 1, None), ("rectification_matrix", "r", 3, 3), ("projection_matrix", "p", 3, 4))
#: More edges than any calibrated vehicle has; a static tree of more is refused.
MOST_EDGES = 100_000


def mapping(raw: str) -> dict:
    """The mapping that a YAML text holds (JSON, which is YAML too, where no YAML library is there)."""
    if importlib.util.find_spec("yaml"):
        import yaml

        try:
            value = yaml.safe_load(raw)
        except yaml.YAMLError as e:
            raise ValueError(f"no YAML: {e}") from e
    else:
        value = json.loads(raw)
    if not isinstance(value, dict):
        raise ValueError("no mapping at the top")
    return value


def _number(key: str, value: object) -> float:
    if isinstance(value, bool):
        raise ValueError(f"{key} holds {value!r}, which is no number")
    try:
        return float(value)  # a YAML reader leaves 1e-3 a string
    except (TypeError, ValueError) as e:
        raise ValueError(f"{key} holds {value!r}, which is no number") from e


def _matrix(root: dict, key: str, rows: int, columns: int | None) -> list[float]:
    block = root.get(key)
    if not isinstance(block, dict) or not isinstance(block.get("data"), list):
        raise ValueError(f"{key} must be a mapping with rows, cols and a list data")
    data = [_number(key, v) for v in block["data"]]
    if "rows" in block and "cols" in block:
        shape = [block[c] for c in ("rows", "cols")]
        if any(isinstance(n, bool) or not isinstance(n, int) for n in shape):
            raise ValueError(f"rows and cols of {key} must be whole numbers")
        if shape[0] * shape[1] != len(data):
            raise ValueError(f"{key} says {shape[0]} x {shape[1]} but has {len(data)} numbers")
    if not data or (columns and len(data) != rows * columns):
        raise ValueError(f"{key} must have {rows * columns if columns else 'some'} numbers, not {len(data)}")
    return data


def parsed(raw: str) -> dict:
    """A calibration's columns; ValueError says which key is missing or wrong."""
    root = mapping(raw)
    out = {}
    for name in ("width", "height"):
        size = root.get(f"image_{name}")
        if isinstance(size, bool) or not isinstance(size, int) or not 0 <= size < 2**32:
            raise ValueError(f"image_{name} must be a whole number")
        out[name] = size
    for name in ("distortion_model", "camera_name"):
        if name == "distortion_model" and name not in root:
            raise ValueError(f"{name} is missing")
        value = root.get(name)
        if isinstance(value, dict | list):
            raise ValueError(f"{name} must be plain text")
        out[name] = None if value is None else str(value)
    for key, column, rows, columns in MATRICES:
        out[column] = _matrix(root, key, rows, columns)
    return out


def _plain(text: str) -> str:
    """A text as YAML: bare where no reader can take it for something else, else as a JSON string, which YAML reads alike."""
    words = ("true", "false", "yes", "no", "on", "off", "null", "y", "n")
    return text if re.fullmatch(r"[A-Za-z_][A-Za-z0-9_/]*", text) and text.lower() not in words else json.dumps(text)


def _value(v: float) -> str:
    """Twelve significant digits, always with a point, so that readers of either YAML version see a number."""
    out = f"{v:.12g}"
    if out in ("inf", "-inf", "nan"):
        return {"inf": ".inf", "-inf": "-.inf", "nan": ".nan"}[out]
    head, e, tail = out.partition("e")
    return head + ("" if "." in head else ".0") + e + tail


def formatted(c: dict) -> str:
    """A calibration's columns as the file's text."""
    lines = [f"image_width: {c['width']}", f"image_height: {c['height']}"]
    if c["camera_name"] is not None:
        lines.append(f"camera_name: {_plain(c['camera_name'])}")
    for at, (key, column, rows, columns) in enumerate(MATRICES):
        if at == 1:
            lines.append(f"distortion_model: {_plain(c['distortion_model'] or '')}")
        data = c[column]
        lines += [f"{key}:", f"  rows: {rows}", f"  cols: {columns or len(data)}", f"  data: [{', '.join(map(_value, data))}]"]
    return "\n".join(lines) + "\n"


def read_calibrations(spark: SparkSession, path: str) -> DataFrame:
    """path and a calibration's columns for each file of a path or pattern; a file that is none raises with its path."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                try:
                    rows.append({"path": name} | parsed(content.decode()))
                except ValueError as e:
                    raise ValueError(f"{name}: {e}") from e
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    lists = [(c, pa.list_(pa.float64())) for c in "dkrp"]
    schema = pa.schema([("path", pa.string()), ("width", pa.int64()), ("height", pa.int64()), ("camera_name", pa.string()), ("distortion_model", pa.string()), *lists])
    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, f"path string, {COLUMNS}")


def write_calibrations(infos: DataFrame, path: str) -> int:
    """A file for each row, named by its camera_name, in a folder that executors share; the number of files.

    Columns as `read_calibrations` gives them. Rows with an equal or no name raise, as one file would hide the other.
    """
    names = infos.groupBy("camera_name").agg(F.count("*").alias("n")).where("n > 1 OR coalesce(camera_name, '') = ''")
    if r := names.first():
        raise ValueError(f"{r['n']} calibrations are named {r['camera_name']!r}")
    os.makedirs(path, exist_ok=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for c in batch.to_pylist():
                # any other character as its code, so that two names never share a file
                name = re.sub(r"[^A-Za-z0-9-]", lambda m: f"_{ord(m[0]):x}_", c["camera_name"])
                temp = os.path.join(path, f".{name}-{os.getpid()}.tmp")
                with open(temp, "w") as f:
                    f.write(formatted(c))
                os.replace(temp, os.path.join(path, f"{name}.yaml"))  # a task that runs twice leaves one file
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows])], ["n"])

    slim = infos.select("width", "height", "camera_name", "distortion_model", *"dkrp")
    return slim.mapInArrow(run, "n long").agg(F.sum("n")).first()[0] or 0


def tree_text(edges: Sequence[tuple]) -> str:
    """A static tree's file of edges (parent, child, x, y, z, roll, pitch, yaw): parents level by level from the roots, in the order they come in.

    Parents on a cycle, which no root leads to, come last; none is lost.
    """
    below: dict[str, list[tuple]] = {}
    for e in edges:
        below.setdefault(e[0], []).append(e)
    children = {e[1] for e in edges}
    queue, done = [p for p in below if p not in children], {}
    for name in queue:  # grows as it goes
        if name in below and name not in done:
            done[name] = True
            queue += [e[1] for e in below[name]]
    lines = []
    for parent in [*done, *(p for p in below if p not in done)]:
        lines.append(f"{_plain(parent)}:")
        for _, child, *values in below[parent]:
            lines.append(f"  {_plain(child)}:")
            lines += [f"    {k}: {_value(v)}" for k, v in zip(("x", "y", "z", "roll", "pitch", "yaw"), values, strict=True)]
    return "\n".join(lines) + "\n"


def write_static_tree(edges: DataFrame, path: str) -> None:
    """A static tree (parent, child, x, y, z, roll, pitch, yaw and, if there, seq for the order) as one file, at most MOST_EDGES edges."""
    order = ["seq"] if "seq" in edges.columns else []
    rows = edges.orderBy(*order, "parent", "child").select("parent", "child", "x", "y", "z", "roll", "pitch", "yaw").limit(MOST_EDGES + 1).collect()
    if len(rows) > MOST_EDGES:
        raise ValueError(f"a static tree has at most {MOST_EDGES} edges")
    with open(path, "w") as f:
        f.write(tree_text([tuple(r) for r in rows]))
