"""Messages as indented text, field by field after their definition."""

from __future__ import annotations

import struct
from collections.abc import Iterator, Mapping

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from chronolane.functions import cdr

#: Arrays of more plain values than this are cut to their length, and how floating values are written.
INLINE, FLOATS = 32, {"float32": "%.7g", "float64": "%.17g"}
#: What stands for a character inside quotes.
QUOTED = str.maketrans({"'": "''", "\n": "\\n", "\r": "\\r", "\t": "\\t"})


def _plain(base: str, value: object) -> str:
    if base == "string":
        return f"'{value.translate(QUOTED)}'"
    if base == "bool":
        return "true" if value else "false"
    return FLOATS[base] % value if base in FLOATS else str(int(value))


def lines(defs: Mapping, value: Mapping, name: str = "", inline: int = INLINE, expand: bool = False) -> Iterator[str]:
    """The lines of a message: one for a plain field or a short array, a block for a nested message or a list of them."""
    for f in defs[name]:
        v, plain = value[f.name], f.base in cdr.PRIMITIVES or f.base == "string"
        inner = None if plain else cdr.resolve(defs, f.base)
        if not f.array:
            if plain:
                yield f"{f.name}: {_plain(f.base, v)}"
            else:
                yield f"{f.name}:"
                yield from ("  " + x for x in lines(defs, v, inner, inline, expand))
        elif not len(v):
            yield f"{f.name}: []"
        elif not plain:
            yield f"{f.name}:"
            for item in v:
                # the first line of an item holds its dash; an empty one is {}
                for k, x in enumerate(lines(defs, item, inner, inline, expand) if defs[inner] else ["{}"]):
                    yield ("    " if k else "  - ") + x
        elif len(v) <= inline:
            yield f"{f.name}: [{', '.join(_plain(f.base, x) for x in v)}]"
        elif expand:
            yield f"{f.name}:"
            yield from (f"  - {_plain(f.base, x)}" for x in v)
        else:
            yield f"{f.name}: [<{len(v)} items>]"


def rendered(messages: DataFrame, schema_text: str, inline: int = INLINE, expand: bool = False) -> DataFrame:
    """topic, timestamp_ns, seq, text and error of messages of one type; text is null where error says why a payload could not be read.

    expand: arrays of over `inline` plain values have a line for each value instead
    of their length. Quotes in strings are doubled; line ends and tabs are shown by
    a backslash form.
    """
    defs = cdr.parse(schema_text)
    kinds = [T.StructField("text", T.StringType()), T.StructField("error", T.StringType())]
    rows = messages.select("topic", "timestamp_ns", "seq", "payload")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, errors = [], []
            for payload in batch.column(3).to_pylist():
                try:
                    made = lines(defs, cdr.Reader(payload or b"").message(defs), "", inline, expand)
                    texts.append("".join(x + "\n" for x in made))
                    errors.append(None)
                except (ValueError, struct.error) as e:
                    texts.append(None)
                    errors.append(str(e))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(texts, pa.string()), pa.array(errors, pa.string())], ["topic", "timestamp_ns", "seq", "text", "error"])

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields[:3], *kinds]))
