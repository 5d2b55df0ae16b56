"""Message schemas and payloads: schema text to Spark types, payloads to typed rows and back."""

from __future__ import annotations

import re
import struct
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Wire types: struct code, bytes, Spark type. Unsigned ones are one size wider in Spark; char is signed.
PRIMITIVES = {
    "bool": ("?", 1, T.BooleanType()),
    "byte": ("B", 1, T.ShortType()),
    "uint8": ("B", 1, T.ShortType()),
    "char": ("b", 1, T.ByteType()),
    "int8": ("b", 1, T.ByteType()),
    "int16": ("h", 2, T.ShortType()),
    "uint16": ("H", 2, T.IntegerType()),
    "int32": ("i", 4, T.IntegerType()),
    "uint32": ("I", 4, T.LongType()),
    "int64": ("q", 8, T.LongType()),
    "uint64": ("Q", 8, T.DecimalType(20, 0)),
    "float32": ("f", 4, T.FloatType()),
    "float64": ("d", 8, T.DoubleType()),
}
_STAMP = "int32 sec\nuint32 nanosec"
_FIELD = re.compile(r"^([A-Za-z][A-Za-z0-9_/]*)(<=\d+)?(\[(<=)?(\d*)\])?\s+([A-Za-z][A-Za-z0-9_]*)\s*(=?)(.*)$")


@dataclass(frozen=True)
class Field:
    name: str
    base: str
    array: str  # "", "fixed" or "sequence"
    size: int  # of a fixed array, or the bound of a sequence (0: none)


def parse(text: str) -> dict[str, list[Field]]:
    """Definitions by name ("" is the first): fields without comments and constants. Blocks of other messages follow lines of ===."""
    out: dict[str, list[Field]] = {}
    for k, block in enumerate(re.split(r"^=+\s*$", text, flags=re.MULTILINE)):
        lines = [x for line in block.splitlines() if (x := line.split("#", 1)[0].strip())]
        name = ""
        if k:
            if not lines or not lines[0].startswith("MSG:"):
                raise ValueError("a block without a name")
            name = lines.pop(0)[4:].strip()
        fields = []
        for line in lines:
            m = _FIELD.match(line)
            if not m:
                raise ValueError(f"not a field: {line!r}")
            if m[7] == "=":
                continue  # a constant
            array = "" if m[3] is None else "fixed" if m[5] and not m[4] else "sequence"
            fields.append(Field(m[6], m[1], array, int(m[5] or 0)))
        out[name] = fields
    for name in ("builtin_interfaces/Time", "builtin_interfaces/Duration"):
        out.setdefault(name, parse_fields(_STAMP))
    for fields in list(out.values()):
        for f in fields:
            if f.base not in PRIMITIVES and f.base != "string":
                resolve(out, f.base)
    return out


def parse_fields(text: str) -> list[Field]:
    return [Field(n, b, "", 0) for b, n in (line.split() for line in text.splitlines())]


def resolve(defs: dict[str, list[Field]], base: str) -> str:
    """The name under which a type is defined: in full, with msg left out, or by its last part."""
    wanted = base.replace("/msg/", "/")
    wanted = {"time": "builtin_interfaces/Time", "duration": "builtin_interfaces/Duration", "Header": "std_msgs/Header"}.get(wanted, wanted)
    for name in defs:
        if name and (name.replace("/msg/", "/") == wanted or ("/" not in wanted and name.rsplit("/", 1)[-1] == wanted)):
            return name
    raise ValueError(f"no definition of {base!r}")


def spark_type(defs: dict[str, list[Field]], name: str = "") -> T.StructType:
    fields = []
    for f in defs[name]:
        kind = PRIMITIVES[f.base][2] if f.base in PRIMITIVES else T.StringType() if f.base == "string" else spark_type(defs, resolve(defs, f.base))
        if f.array:
            kind = T.BinaryType() if f.base in ("byte", "uint8") else T.ArrayType(kind)
        fields.append(T.StructField(f.name, kind))
    return T.StructType(fields or [T.StructField("empty", T.BooleanType())])


class Reader:
    """Reads values with the alignment that counts from the end of the four-byte head."""

    def __init__(self, data: bytes) -> None:
        if len(data) < 4 or data[0] != 0 or data[1] > 1:
            raise ValueError("not a plain CDR payload")
        self.data, self.at, self.order = data, 4, "<" if data[1] & 1 else ">"

    def align(self, n: int) -> None:
        self.at += -(self.at - 4) % n

    def value(self, base: str):
        code, n, _ = PRIMITIVES[base]
        self.align(n)
        (v,) = struct.unpack_from(self.order + code, self.data, self.at)
        self.at += n
        return v

    def count(self, least: int) -> int:
        n = self.value("uint32")
        if n * least > len(self.data) - self.at:
            raise ValueError("cut off")
        return n

    def string(self) -> str:
        n = self.count(1)
        raw = self.data[self.at : self.at + n]
        self.at += n
        return raw[:-1].decode(errors="replace") if n else ""

    def message(self, defs: dict[str, list[Field]], name: str = "") -> dict:
        if not defs[name]:
            self.at += 1  # an empty message takes a byte
            return {"empty": None}
        return {f.name: self.field(defs, f) for f in defs[name]}

    def field(self, defs: dict[str, list[Field]], f: Field):
        if f.base in PRIMITIVES:
            one = lambda: self.value(f.base)
        elif f.base == "string":
            one = self.string
        else:
            name = resolve(defs, f.base)
            one = lambda: self.message(defs, name)
        if not f.array:
            return one()
        n = f.size if f.array == "fixed" else self.count(1 if f.base not in PRIMITIVES else PRIMITIVES[f.base][1])
        if f.base in PRIMITIVES:
            code, size, _ = PRIMITIVES[f.base]
            if n:
                self.align(size)
            if f.base in ("byte", "uint8"):
                out = self.data[self.at : self.at + n]
            else:
                out = list(struct.unpack_from(f"{self.order}{n}{code}", self.data, self.at))
            self.at += n * size
            return out
        return [one() for _ in range(n)]


class Writer:
    """The little-endian counterpart of the reader."""

    def __init__(self) -> None:
        self.out = bytearray(b"\0\1\0\0")

    def align(self, n: int) -> None:
        self.out += bytes(-(len(self.out) - 4) % n)

    def value(self, base: str, v) -> None:
        code, n, _ = PRIMITIVES[base]
        self.align(n)
        self.out += struct.pack("<" + code, v if code in "?fd" else int(v))

    def string(self, v: str) -> None:
        raw = v.encode() + b"\0"
        self.value("uint32", len(raw))
        self.out += raw

    def message(self, defs: dict[str, list[Field]], value: dict, name: str = "") -> None:
        if not defs[name]:
            self.out += b"\0"
        for f in defs[name]:
            v = value[f.name]
            if f.array:
                if f.array == "sequence":
                    if f.size and len(v) > f.size:
                        raise ValueError(f"{f.name} holds more than {f.size}")
                    self.value("uint32", len(v))
                elif len(v) != f.size:
                    raise ValueError(f"{f.name} must hold {f.size}")
            for x in v if f.array else [v]:
                if f.base in PRIMITIVES:
                    self.value(f.base, x)
                elif f.base == "string":
                    self.string(x)
                else:
                    self.message(defs, x, resolve(defs, f.base))


def encode(schema_text: str, value: dict) -> bytes:
    w = Writer()
    w.message(parse(schema_text), value)
    return bytes(w.out)


def read(payloads: pa.Array, defs: dict[str, list[Field]], kind: T.StructType, arrow: pa.StructType) -> tuple[pa.Array, pa.Array]:
    """Messages, and errors: all at once where that can be, the rest one by one."""
    import decimal

    from chronolane.functions import columns

    def fit(v, t):
        if isinstance(t, T.StructType):
            return {f.name: fit(v[f.name], f.dataType) for f in t.fields}
        if isinstance(t, T.ArrayType):
            return [fit(x, t.elementType) for x in v]
        return decimal.Decimal(v) if isinstance(t, T.DecimalType) else v

    made, rows = columns.read(payloads, defs, arrow)
    rest = np.setdiff1d(np.arange(len(payloads)), rows)
    values, errors = [], []
    for x in payloads.take(pa.array(rest)).to_pylist():
        try:
            values.append(fit(Reader(x or b"").message(defs), kind))
            errors.append(None)
        except (ValueError, struct.error) as e:
            values.append(None)
            errors.append(str(e))
    order = pa.array(np.argsort(np.concatenate([rows, rest]), kind="stable"))
    return pa.concat_arrays([made, pa.array(values, arrow)]).take(order), pa.concat_arrays([pa.nulls(len(rows), pa.string()), pa.array(errors, pa.string())]).take(order)


def written(values: pa.Array, defs: dict[str, list[Field]]) -> pa.Array:
    """Payloads of a column of messages; null ones are null."""
    from chronolane.functions import columns

    there = values.is_valid()
    try:
        made = columns.write(values.filter(there), defs)
    except columns.TooMany:
        out = []
        for value in values.filter(there).to_pylist():
            w = Writer()
            w.message(defs, value)
            out.append(bytes(w.out))
        made = pa.array(out, pa.binary())
    at = np.cumsum(there.to_numpy(zero_copy_only=False)) - 1
    return made.take(pa.array(at, mask=~there.to_numpy(zero_copy_only=False)))


def decoded(messages: DataFrame, schema_text: str) -> DataFrame:
    """topic, timestamp_ns, seq, message (typed after the schema) and error (why a payload could not be read)."""
    defs = parse(schema_text)
    kind = spark_type(defs)
    out = T.StructType([T.StructField("topic", T.StringType()), T.StructField("timestamp_ns", T.LongType()), T.StructField("seq", T.LongType()), T.StructField("message", kind), T.StructField("error", T.StringType())])
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                values, errors = read(batch.column(3), defs, kind, arrow.field("message").type)
                yield pa.RecordBatch.from_arrays([*(c.cast(f.type) for c, f in zip(batch.columns[:3], arrow, strict=False)), values, errors], schema=arrow)

    return messages.select("topic", "timestamp_ns", "seq", "payload").mapInArrow(run, out)


def leads_with_header(schema_text: str) -> bool:
    """Whether the first field is a header."""
    fields = parse(schema_text)[""]
    return bool(fields) and not fields[0].array and fields[0].base.replace("/msg/", "/") in ("std_msgs/Header", "Header")


def header_stamp():
    """The capture stamp of a payload that leads with a header, in nanoseconds, by column functions: bytes 4 to 12 in the payload's byte order."""
    part = lambda at: F.hex(F.substring("payload", at, 4))
    turned = lambda h: F.concat(*[F.substring(h, k, 2) for k in (7, 5, 3, 1)])
    little = F.conv(F.hex(F.substring("payload", 2, 1)), 16, 10).cast("int") % 2 == 1
    number = lambda at: F.conv(F.when(little, turned(part(at))).otherwise(part(at)), 16, 10).cast("long")
    seconds = number(5)
    signed = F.when(seconds >= 2**31, seconds - 2**32).otherwise(seconds)
    return F.when(F.octet_length("payload") >= 12, signed * 1_000_000_000 + number(9))


def encoded(rows: DataFrame, schema_text: str) -> DataFrame:
    """The rows with `message` (a struct after the schema, no nulls inside) turned into `payload`; other columns stay. A null message is a null payload."""
    defs = parse(schema_text)
    others = [c for c in rows.columns if c != "message"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], written(batch.column(batch.num_columns - 1), defs)], [*others, "payload"])

    kind = T.StructType([*rows.select(*others).schema.fields, T.StructField("payload", T.BinaryType())])
    return rows.select(*others, "message").mapInArrow(run, kind)


def edited(messages: DataFrame, schema_text: str, topics: list[str], change: Callable[[dict], dict]) -> DataFrame:
    """The messages with the payloads of the topics read, changed and written again; all others as they are. A payload that cannot be read raises."""
    defs = parse(schema_text)
    names, wanted = messages.columns, set(topics)
    topic, payload = names.index("topic"), names.index("payload")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for name, data in zip(batch.column(topic).to_pylist(), batch.column(payload).to_pylist(), strict=True):
                if name in wanted:
                    w = Writer()
                    w.message(defs, change(Reader(data or b"").message(defs)))
                    data = bytes(w.out)
                out.append(data)
            columns = list(batch.columns)
            columns[payload] = pa.array(out, pa.binary())
            yield pa.RecordBatch.from_arrays(columns, names)

    return messages.mapInArrow(run, messages.schema)


def decompressed(messages: DataFrame, compression: str = "zstd") -> DataFrame:
    """The messages with payloads that were compressed one by one unpacked, sizes in the frames or not. Empty and null payloads stay; what is no frame raises."""
    if compression != "zstd":
        raise ValueError(f"unknown compression of messages {compression!r}")
    names = messages.columns
    payload = names.index("payload")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        unpack = zstandard.ZstdDecompressor()
        for batch in batches:
            columns = list(batch.columns)
            columns[payload] = pa.array([unpack.decompressobj().decompress(x) if x else x for x in columns[payload].to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays(columns, names)

    return messages.mapInArrow(run, messages.schema)
