"""Chat formatting with minimum-cost role repair.

A legal conversation is an optional system turn, then user and assistant turns
by turns, ending with the assistant. Each given turn is emitted under its role
or another one (RELABEL; UNKNOWN for roles that are none of the three), as a turn
of its own or merged into the turn before (MERGE), and empty turns may be put in
(INSERT each). Dynamic programming over the automaton whose state is the last
emitted role finds the repair of the least total cost; of equal ones, the states
that come first in the order assistant, user, system.

A turn's step is a matrix of least costs between states that depends on its role
only. So a conversation is cut into stretches of STRETCH turn numbers; where one
holds more than twice as many rows (turn numbers that repeat or are null), its
rows are sorted and cut by their count. Stretches yield matrices, their min-plus
products give the least cost up to each cut, a walk back over the cuts fixes the
states there, and each stretch is traced by itself. Partitions are read as sorted
streams, one stretch of at most 2 * STRETCH rows in memory at a time, so a
conversation, or one turn number of it, may hold any share of all rows. The walk
back holds 16 numbers for each stretch of one conversation.

Each turn yields a fragment; a conversation's fragments in order are its
rendering, closing marks and inserted turns included.

Defined results: a null role is unknown; a null text is empty; null turn numbers
come first, ties in turn number go by the role's first 64 characters and then by a
digest of role and text, so that no key of the sort is long; a null conv_id is one
conversation; repeated rows are turns of their own (and merge); an empty table
gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chronolane.llm.common import materialise, table

ROLES = ("system", "user", "assistant")
START, SYSTEM, USER, ASSISTANT = range(4)
RELABEL, UNKNOWN, MERGE, INSERT = 4, 2, 1, 3
STRETCH = 4096
OPEN, CLOSE = "<|{role}|>\n", "<|end|>\n"
_NEXT = {START: (SYSTEM, USER), SYSTEM: (USER,), USER: (ASSISTANT,), ASSISTANT: (USER,)}
_PREFER = (ASSISTANT, USER, SYSTEM, START)
_NEVER = 10**12


def _insertions() -> dict[tuple[int, int], tuple[int, ...]]:
    """From state to state: the fewest empty turns that lead from one to the other."""
    out = {(s, s): () for s in range(4)}
    for _ in range(4):
        for (s, t), way in list(out.items()):
            for u in _NEXT[t]:
                if len(out.get((s, u), range(9))) > len(way) + 1:
                    out[s, u] = (*way, u)
    return out


_WAYS = _insertions()


def _moves(role: int) -> dict[tuple[int, int], tuple[int, str, tuple[int, ...]]]:
    """From state to state over one turn of a role (0: unknown): cost, what is done, and the turns put in before."""
    out = {}
    for s, t in product(range(4), (SYSTEM, USER, ASSISTANT)):
        label = 0 if role == t else UNKNOWN if role == START else RELABEL
        ways = [(INSERT * len(way) + label, "keep" if role == t else "relabel", way) for p in range(4) if t in _NEXT[p] and (way := _WAYS.get((s, p))) is not None]
        if s == t:
            ways.append((MERGE + label, "merge", ()))
        if ways:
            out[s, t] = min(ways)
    return out


_MOVES = [_moves(r) for r in range(4)]
STEPS = [np.array([[m[s, t][0] if (s, t) in m else _NEVER for t in range(4)] for s in range(4)]) for m in _MOVES]
_FINISH = np.array([INSERT * len(_WAYS[s, ASSISTANT]) if s else INSERT * 2 for s in range(4)])


def combine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The min-plus product."""
    return np.minimum((a[:, :, None] + b[None, :, :]).min(axis=1), _NEVER)


def stretch_matrix(roles: list[int]) -> np.ndarray:
    out = np.where(np.eye(4, dtype=bool), 0, _NEVER)
    for r in roles:
        out = combine(out, STEPS[r])
    return out


def _first_least(cost: np.ndarray) -> int:
    return min(_PREFER, key=lambda s: (cost[s], _PREFER.index(s)))


def cut_states(matrices: list[np.ndarray]) -> list[tuple[int, int]]:
    """The states before and after each stretch of a least-cost repair."""
    upto = [np.array([0, _NEVER, _NEVER, _NEVER])]
    for m in matrices:
        upto.append(np.minimum((upto[-1][:, None] + m).min(axis=0), _NEVER))
    after, out = _first_least(upto[-1] + _FINISH), []
    for k in range(len(matrices) - 1, -1, -1):
        before = _first_least(upto[k] + matrices[k][:, after])
        out.append((before, after))
        after = before
    return out[::-1]


def trace(roles: list[int], before: int, after: int) -> list[tuple[int, str, tuple[int, ...]]]:
    """For each turn of a stretch: its role, what is done, and the turns put in before."""
    upto = [np.where(np.arange(4) == before, 0, _NEVER)]
    for r in roles:
        upto.append(np.minimum((upto[-1][:, None] + STEPS[r]).min(axis=0), _NEVER))
    out, state = [], after
    for k in range(len(roles) - 1, -1, -1):
        prior = _first_least(upto[k] + STEPS[roles[k]][:, state])
        _, what, put = _MOVES[roles[k]][prior, state]
        out.append((state, what, put))
        state = prior
    return out[::-1]


def _streams(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[list[tuple]]:
    """The rows of each key (the first columns) of a sorted stream."""
    held: list[tuple] = []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if held and row[:keys] != held[0][:keys]:
                yield held
                held = []
            held.append(row)
    if held:
        yield held


def _in_batches(rows: Iterator[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    held = []
    for row in rows:
        held.append(row)
        if len(held) == 5000:
            yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)


def _fragment(state: int, what: str, put: tuple[int, ...], text: str, first: bool) -> str:
    if what == "merge":
        return "\n" + text
    turns = "".join(OPEN.format(role=ROLES[p - 1]) + CLOSE for p in put)
    return ("" if first else CLOSE) + turns + OPEN.format(role=ROLES[state - 1]) + text


def _cut(slim: DataFrame, stretch: int) -> DataFrame:
    """The turns with `sub`, the place of their cut within `part`: 0 where a part holds at most 2 * stretch rows, else by the rows' count in sorted order.

    Equal rows change nothing in which order they come, so a number given once, in
    a written table, tells them apart: ranges may part them, and no task holds all.
    A row's place is its place in its range after the rows of the ranges before, so
    the cuts do not depend on the ranges.
    """
    full = slim.groupBy("conv_id", "part").agg(F.count("*").alias("n")).where(F.col("n") > 2 * stretch).select(F.col("conv_id").alias("c"), F.col("part").alias("p"))
    full = materialise(full, "full")
    if full.isEmpty():
        return slim.withColumn("sub", F.lit(0).cast("long"))
    same = F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("part") == F.col("p"))
    crowded = materialise(slim.join(full, same, "left_semi").withColumn("tie", F.monotonically_increasing_id()), "crowded")
    order = ["conv_id", "part", "turn", "lead", "mark", "tie"]
    ranged = crowded.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = materialise(ranged.withColumn("id", F.monotonically_increasing_id()), "placed").withColumn("range", F.shiftright("id", 33))
    ends = placed.groupBy("conv_id", "part", "range").agg(F.min("id").alias("first"), F.count("*").alias("n"))
    earlier = Window.partitionBy("conv_id", "part").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    ends = ends.select(F.col("conv_id").alias("c"), F.col("part").alias("p"), F.col("range").alias("r"), (F.coalesce(F.sum("n").over(earlier), F.lit(0)) - F.col("first")).alias("shift"))
    cut = placed.join(ends, same & (F.col("range") == F.col("r"))).withColumn("sub", F.expr(f"(id + shift) div {int(stretch)}")).select(*slim.columns, "sub")
    cut = materialise(cut, "cut")
    return slim.join(full, same, "left_anti").withColumn("sub", F.lit(0).cast("long")).unionByName(cut)


def repair(turns: DataFrame, stretch: int = STRETCH) -> DataFrame:
    """conv_id, turn, role, new_role, action (keep, relabel or merge), n_inserted (before the turn, and after the last one) and fragment."""
    code = F.coalesce(F.array_position(F.array(*map(F.lit, ROLES)), F.col("role")), F.lit(0)).cast("int")
    slim = turns.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.coalesce(F.floor(F.col("turn") / stretch), F.lit(-(2**62))).cast("long").alias("part"),
        F.col("turn").cast("long").alias("turn"),
        F.col("role").cast("string").alias("role"),
        code.alias("code"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    slim = slim.withColumn("lead", F.left("role", F.lit(64))).withColumn("mark", F.xxhash64("role", "text"))
    slim = _cut(slim, stretch)

    def matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = ((*g[0][:3], stretch_matrix([r[3] for r in g]).ravel().tolist()) for g in _streams(batches, 3))
        yield from _in_batches(rows, pa.schema([("conv_id", pa.int64()), ("part", pa.int64()), ("sub", pa.int64()), ("m", pa.list_(pa.int64()))]))

    def cuts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for g in _streams(batches, 1):
                found = cut_states([np.array(r[3]).reshape(4, 4) for r in g])
                for k, (r, (a, b)) in enumerate(zip(g, found, strict=True)):
                    yield *r[:3], a, b, k == len(g) - 1

        yield from _in_batches(rows(), pa.schema([("conv_id", pa.int64()), ("part", pa.int64()), ("sub", pa.int64()), ("before", pa.int32()), ("after", pa.int32()), ("last", pa.bool_())]))

    schema = pa.schema([("conv_id", pa.int64()), ("turn", pa.int64()), ("role", pa.string()), ("new_role", pa.string()), ("action", pa.string()), ("n_inserted", pa.int32()), ("fragment", pa.string())])

    def traced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for g in _streams(batches, 3):
                before, after, last = g[0][7:]
                for k, (r, (state, what, put)) in enumerate(zip(g, trace([r[5] for r in g], before, after), strict=True)):
                    text, n = _fragment(state, what, put, r[6], first=k == 0 and before == START), len(put)
                    if last and k == len(g) - 1:
                        end = _WAYS[state, ASSISTANT]
                        text += CLOSE + "".join(OPEN.format(role=ROLES[p - 1]) + CLOSE for p in end)
                        n += len(end)
                    yield r[0], r[3], r[4], ROLES[state - 1], what, n, text

        yield from _in_batches(rows(), schema)

    order = ["conv_id", "part", "sub", "turn", "lead", "mark"]
    keys = order[:3]
    dealt = slim.select("code", *order).repartition(*keys).sortWithinPartitions(*order).select(*keys, "code")
    made = dealt.mapInArrow(matrices, "conv_id long, part long, sub long, m array<long>")
    states = made.repartition("conv_id").sortWithinPartitions(*keys).mapInArrow(cuts, "conv_id long, part long, sub long, before int, after int, last boolean")
    states = materialise(states, "cuts").select(F.col("conv_id").alias("c"), F.col("part").alias("p"), F.col("sub").alias("s"), "before", "after", "last")
    joined = slim.join(states, slim["conv_id"].eqNullSafe(states["c"]) & (slim["part"] == states["p"]) & (slim["sub"] == states["s"])).drop("c", "p", "s")
    joined = joined.select("conv_id", "part", "sub", "turn", "role", "code", "text", "lead", "mark", "before", "after", "last").repartition(*keys).sortWithinPartitions(*order).drop("lead", "mark")
    return joined.mapInArrow(traced, "conv_id long, turn long, role string, new_role string, action string, n_inserted int, fragment string")


def op6_chat_formatting(spark, sf_dir: str) -> DataFrame:
    """Every turn's repair and the digest of its fragment of the rendering."""
    out = repair(table(spark, sf_dir, "conversations"))
    return out.select("conv_id", "turn", "role", "new_role", "action", "n_inserted", F.sha2(F.col("fragment").cast("binary"), 256).alias("fragment_sha256"))
