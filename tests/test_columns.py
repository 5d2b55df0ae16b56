"""Payloads of a batch at once against those one by one, and against bytes put together by hand."""

import decimal
import struct

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql.pandas.types import to_arrow_type

from chronolane.functions import cdr, columns

SCHEMA = "===\n".join(
    [
        "bool flag\nstring name\nint8 small\nuint64 huge\nfloat64[3] three\nuint8[] data\nuint8[4] four\nint16[] shorts\nbool[] flags\nstring[] names\ndemo/Item[] items\ndemo/Nothing nothing\ndemo/Nothing[2] nothings\nfloat32 end\n",
        "MSG: demo/Item\nuint16 id\ndemo/Place[] places\nstring label\n",
        "MSG: demo/Place\nfloat64 x\nuint32 y\n",
        "MSG: demo/Nothing\n",
    ]
)
DEFS = cdr.parse(SCHEMA)
KIND = cdr.spark_type(DEFS)
ARROW = to_arrow_type(KIND)


def _value(rng, many=4):
    n = lambda: int(rng.integers(0, many))
    text = lambda: "aé\n"[: n()] * n()
    place = lambda: {"x": float(rng.normal()), "y": int(rng.integers(0, 2**32))}
    item = lambda: {"id": int(rng.integers(0, 2**16)), "places": [place() for _ in range(n())], "label": text()}
    return {
        "flag": bool(n() % 2), "name": text(), "small": int(rng.integers(-128, 128)), "huge": decimal.Decimal(2**64 - 1 - n()), "three": [float(x) for x in rng.normal(size=3)], "data": rng.bytes(n()), "four": rng.bytes(4),
        "shorts": [int(x) for x in rng.integers(-9, 9, n())], "flags": [bool(x) for x in rng.integers(0, 2, n())], "names": [text() for _ in range(n())], "items": [item() for _ in range(n())],
        "nothing": {"empty": None}, "nothings": [{"empty": None}] * 2, "end": float(n()),
    }


def _one_by_one(value):
    w = cdr.Writer()
    w.message(DEFS, value)
    return bytes(w.out)


def test_both_ways():
    rng = np.random.default_rng(1)
    values = [_value(rng) for _ in range(200)]
    column = pa.array([None, *values, None], ARROW)
    made = cdr.written(column, DEFS)
    want = [None, *map(_one_by_one, values), None]
    assert made.to_pylist() == want
    assert cdr.written(column.slice(5, 50), DEFS).to_pylist() == want[5:55]
    payloads = pa.array(want, pa.binary())
    for part in (payloads, payloads.slice(7, 90), payloads.slice(0, 0)):
        got, errors = cdr.read(part, DEFS, KIND, ARROW)
        first = 0 if len(part) > 100 else 7
        assert got.to_pylist() == column.slice(first, len(part)).to_pylist()
        assert [e is not None for e in errors.to_pylist()] == [not x.is_valid for x in part]
    assert len(columns.read(pa.array(want[1:-1], pa.binary()), DEFS, ARROW)[1]) == 200


def test_every_cut_is_told_as_one_by_one():
    value = _value(np.random.default_rng(4), 6)
    whole = _one_by_one(value)
    cuts = [whole[:k] for k in range(len(whole))] + [whole + b"more", b"\0\2" + whole[2:], b"\1\1" + whole[2:]]
    got, errors = cdr.read(pa.array(cuts, pa.binary()), DEFS, KIND, ARROW)
    for x, g, e in zip(cuts, got.to_pylist(), errors.to_pylist(), strict=True):
        try:
            want = cdr.Reader(x).message(DEFS)
            assert e is None and g["items"] == want["items"] and g["end"] == want["end"]
        except (ValueError, struct.error) as error:
            assert g is None and e == str(error)


def test_long_lists_and_wrong_values():
    rng = np.random.default_rng(5)
    long = _value(rng) | {"names": ["x"] * (columns.MANY + 5)}
    values = pa.array([long, _value(rng)], ARROW)
    made = cdr.written(values, DEFS)
    assert made.to_pylist() == [_one_by_one(v) for v in values.to_pylist()]
    assert cdr.read(made, DEFS, KIND, ARROW)[0].to_pylist() == values.to_pylist()
    small = cdr.parse("uint8 a\nint32[<=2] b\nint16[2] c")
    for value in ({"a": 256, "b": [], "c": [1, 2]}, {"a": 1, "b": [1, 2, 3], "c": [1, 2]}, {"a": 1, "b": [], "c": [1]}, {"a": None, "b": [], "c": [1, 2]}, {"a": 1, "b": [], "c": [1, 40000]}):
        with pytest.raises(ValueError):
            cdr.written(pa.array([value], pa.struct([("a", pa.int64()), ("b", pa.list_(pa.int64())), ("c", pa.list_(pa.int64()))])), small)


@pytest.mark.parametrize("order", "<>")
def test_bytes_by_hand(order):
    """A string of each length up to 8, so that the double after it is padded in every way; a sequence; both byte orders."""
    defs = cdr.parse("string s\nfloat64 d\nuint16[] u\nint32 i")
    kind = cdr.spark_type(defs)
    payloads = []
    for n in range(9):
        body = struct.pack(order + "I", n + 1) + b"x" * n + b"\0"
        body += bytes(-len(body) % 8) + struct.pack(order + "d", n / 2)
        body += struct.pack(order + "I", n) + struct.pack(f"{order}{n}H", *range(n))
        body += bytes(-len(body) % 4) + struct.pack(order + "i", -n)
        payloads.append(bytes([0, order == "<", 0, 0]) + body)
    got, errors = cdr.read(pa.array(payloads, pa.binary()), defs, kind, to_arrow_type(kind))
    assert got.to_pylist() == [{"s": "x" * n, "d": n / 2, "u": list(range(n)), "i": -n} for n in range(9)] and not any(errors.to_pylist())
    assert len(columns.read(pa.array(payloads, pa.binary()), defs, to_arrow_type(kind))[1]) == 9
    if order == "<":
        assert cdr.written(got, defs).to_pylist() == payloads


def test_empty_and_null_columns():
    assert cdr.written(pa.array([], ARROW), DEFS).to_pylist() == []
    assert cdr.written(pa.array([None, None], ARROW), DEFS).to_pylist() == [None, None]
    assert cdr.read(pa.array([], pa.binary()), DEFS, KIND, ARROW)[0].to_pylist() == []
    got, errors = cdr.read(pa.array([None, b"", b"\0\1"], pa.binary()), DEFS, KIND, ARROW)
    assert got.to_pylist() == [None] * 3 and errors.to_pylist() == ["not a plain CDR payload"] * 3
