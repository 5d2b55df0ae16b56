"""SentencePiece encoding and decoding, with a max-plus scan over giant documents.

A sequence of pieces is the encoding of its text just when each two neighbours
are the encoding of theirs: the first merge across a neighbours' border would
also happen between those two alone. So an encoding is the one path of weight 0
in an automaton whose state is the last piece, where a step weighs 0 if the two
pieces may stand side by side and minus infinity if not.

A giant document is cut into chunks of CHUNK characters anywhere. The state at a
cut is the piece that reaches or crosses it; a chunk yields the matrix of
weights from the states at its start to those at its end. Matrices combine by
the max-plus product, which is associative: those of BLOCK chunks make one for
the block, in one task for each block; the blocks' products give the states at
their ends; between these, again block by block, the states at every cut; and
each chunk is then traced back by itself. So beside its text a document is in
one task only as a matrix for every BLOCK * CHUNK characters. Inside a chunk,
between the first and the last place where a space mark follows another
character (no piece holds such a pair) the state before does not matter and the
library encodes the stretch. Documents of one chunk go to the library at once.

Models: byte-pair models with byte fallback, a leading space mark and no further
normalisation; others raise ValueError.

Defined results: a null or empty text has no ids and one row; repeated rows are
each returned; a null doc_id is kept; an empty table gives no rows; extra columns
are ignored. The space mark itself, where a text holds it, decodes to a space.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronolane.llm.common import materialise, table

CHUNK, BLOCK = 16_384, 64
MARK = "▁"
_NEVER = -np.inf


class Pieces:
    """The model's pieces, their merges, and which may stand side by side."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        self.sp = sp = sentencepiece.SentencePieceProcessor(model_file=path)
        size = sp.get_piece_size()
        self.byte = {int(sp.id_to_piece(i)[1:-1], 16): i for i in range(size) if sp.is_byte(i)}
        plain = [i for i in range(size) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
        self.score = {sp.id_to_piece(i): sp.get_score(i) for i in plain}
        self.id = {sp.id_to_piece(i): i for i in plain}
        self.text = {i: sp.id_to_piece(i) for i in plain}
        self.longest = max(map(len, self.id))
        if len(self.byte) != 256 or sp.encode("a  b", out_type=str)[0][:1] != MARK:
            raise ValueError("not a byte-pair model with byte fallback and a leading space mark")
        self.breaks = not any(MARK in p.lstrip(MARK) for p in self.id)
        self.pairs: dict[tuple[str, str], bool] = {}

    def merged(self, text: str) -> list[str]:
        """The pieces of a short text: again and again the best-scored neighbours join, the leftmost of equals."""
        parts = list(text)
        while True:
            found = [(-self.score[x], i) for i in range(len(parts) - 1) if (x := parts[i] + parts[i + 1]) in self.score]
            if not found:
                return parts
            i = min(found)[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]

    def beside(self, a: str, b: str) -> bool:
        if not a:
            return True
        got = self.pairs.get((a, b))
        if got is None:
            got = self.pairs[a, b] = self.merged(a + b) == [a, b]
        return got

    def ids(self, piece: str) -> list[int]:
        """A piece's id, or those of its bytes."""
        i = self.id.get(piece)
        return [i] if i is not None else [self.byte[b] for b in piece.encode("utf-8", "surrogatepass")]

    def inner(self, text: str) -> list[int]:
        """Ids of a stretch that starts with a space mark, by the library (which puts the first mark there itself)."""
        return self.sp.encode(text[1:].replace(MARK, " ")) if len(text) > 1 else self.ids(MARK) if text else []

    def decode(self, ids: list[int], first: bool = True) -> str:
        """The text of ids; first: whether they start a document, whose leading mark is dropped."""
        out = bytearray()
        back = {i: b for b, i in self.byte.items()}
        for i in ids:
            if i in back:
                out.append(back[i])
            else:
                out += self.text[i].encode()
        text = out.decode("utf-8", "surrogatepass").replace(MARK, " ")
        return text[1:] if first and text else text

    def candidates(self, text: str, at: int) -> list[int]:
        """Ends of the pieces that start at a place; a character that is no piece stands by itself."""
        ends = [e for e in range(at + 1, min(at + self.longest, len(text)) + 1) if text[at:e] in self.id]
        return ends if ends and ends[0] == at + 1 else [at + 1, *ends]

    def walk(self, text: str, entry: tuple[int, int], until: int) -> dict[tuple[int, int], tuple[int, int]]:
        """From a state (start and end of a piece): the states that can follow, up to those that reach `until`, and what comes before each."""
        before: dict[tuple[int, int], tuple[int, int]] = {}
        ending: dict[int, list[tuple[int, int]]] = {entry[1]: [entry]}
        for p in range(entry[1], until):
            for state in ending.pop(p, ()):
                for q in self.candidates(text, p):
                    if (p, q) not in before and self.beside(text[state[0] : state[1]], text[p:q]):
                        before[p, q] = state
                        ending.setdefault(q, []).append((p, q))
        return before

    def reached(self, text: str, entries: list[tuple[int, int]], until: int) -> dict[tuple[int, int], int]:
        """As walk, from several states at once: of each state that can follow, which entries lead to it, as bits. States before `until` go as they are passed."""
        out: dict[tuple[int, int], int] = {}
        ending: dict[int, dict[tuple[int, int], int]] = {}
        for k, x in enumerate(entries):
            if x[1] >= until:
                out[x] = out.get(x, 0) | 1 << k
            else:
                at = ending.setdefault(x[1], {})
                at[x] = at.get(x, 0) | 1 << k
        for p in range(min(ending, default=until), until):
            if not (here := ending.pop(p, None)):
                continue
            for q in self.candidates(text, p):
                piece, mask = text[p:q], 0
                for state, bits in here.items():
                    if self.beside(text[state[0] : state[1]], piece):
                        mask |= bits
                if mask:
                    at = out if q >= until else ending.setdefault(q, {})
                    at[p, q] = mask
        return out

    def states(self, text: str, cut: int) -> list[tuple[int, int]]:
        """All states at a cut: pieces that start before it and end at it or later; at the very start the empty one."""
        if cut == 0:
            return [(0, 0)]
        return [(a, e) for a in range(max(0, cut - self.longest), cut) for e in self.candidates(text, a) if e >= cut]

    def hard(self, text: str, a: int, b: int) -> tuple[int, int] | None:
        """The first and the last place from a to b where a mark follows another character."""
        if not self.breaks:
            return None
        first = next((i for i in range(a + 1, b) if text[i] == MARK and text[i - 1] != MARK), None)
        last = next((i for i in range(b - 1, a, -1) if text[i] == MARK and text[i - 1] != MARK), None)
        return (first, last) if first is not None else None

    def _parts(self, text: str, s: int, e: int) -> tuple[int, int]:
        """Where the states at the start stop to matter, and from where those at the end are found; equal or (e, s) if nowhere."""
        found = self.hard(text, min(s + self.longest, e), e)
        return found or (e, s)

    def transfer(self, text: str, s: int, e: int) -> tuple[list, list, np.ndarray]:
        """The states at both cuts of a chunk, and the weights between them."""
        entries, exits = self.states(text, s), self.states(text, e)
        at = {x: k for k, x in enumerate(exits)}
        out = np.full((len(entries), len(exits)), _NEVER)
        head, tail = self._parts(text, s, e)
        if head < e:
            bits = 0
            for (_, q), mask in self.reached(text, entries, head).items():
                bits |= mask if q == head else 0
            ends = [at[x] for x in self.reached(text, [(tail, tail)], e) if x in at]
            for k in range(len(entries)):
                if bits >> k & 1:
                    out[k, ends] = 0.0
        else:
            for y, mask in self.reached(text, entries, e).items():
                if y in at:
                    out[[k for k in range(len(entries)) if mask >> k & 1], at[y]] = 0.0
        return entries, exits, out

    def trace(self, text: str, s: int, e: int, entry: tuple[int, int], leave: tuple[int, int]) -> list[int]:
        """Ids of the pieces after the entry state up to the leaving one."""
        if entry == leave:
            return []
        head, tail = self._parts(text, s, e)
        if head < e:
            left = self.walk(text, entry, head)
            end = next((x for x in left if x[1] == head), entry)
            return self._path(text, left, entry, end) + self.inner(text[head:tail]) + self._path(text, self.walk(text, (tail, tail), e), (tail, tail), leave)
        return self._path(text, self.walk(text, entry, e), entry, leave)

    def _path(self, text: str, before: dict, entry: tuple[int, int], state: tuple[int, int]) -> list[int]:
        out = []
        while state != entry:
            out.append(self.ids(text[state[0] : state[1]]))
            state = before[state]
        return [i for ids in reversed(out) for i in ids]


def combine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The max-plus product."""
    return (a[:, :, None] + b[None, :, :]).max(axis=1)


def product(matrices: list[np.ndarray]) -> np.ndarray:
    """The matrices' product, by halves."""
    while len(matrices) > 1:
        matrices = [combine(*matrices[k : k + 2]) if k + 1 < len(matrices) else matrices[k] for k in range(0, len(matrices), 2)]
    return matrices[0]


def cuts_of(matrices: list[np.ndarray], first: int, last: int) -> list[tuple[int, int]]:
    """The numbers of the states before and after each matrix, on a path from the first state to the last one."""
    upto = [np.where(np.arange(len(matrices[0])) == first, 0.0, _NEVER)[None, :]]
    for m in matrices:
        upto.append(combine(upto[-1], m))
    out, state = [], last
    for k in range(len(matrices) - 1, -1, -1):
        prior = int(np.flatnonzero((upto[k][0] + matrices[k][:, state]) == 0)[0])
        out.append((prior, state))
        state = prior
    return out[::-1]


_OUT = pa.schema([("doc_id", pa.int64()), ("chunk", pa.int32()), ("n_ids", pa.int64()), ("ids_crc32", pa.int64()), ("text_chars", pa.int64()), ("round_trip", pa.bool_()), ("ids", pa.list_(pa.int32()))])
_SCHEMA = "doc_id long, chunk int, n_ids long, ids_crc32 long, text_chars long, round_trip boolean, ids array<int>"


def _row(pieces: Pieces, doc: int | None, chunk: int, ids: list[int], text: str) -> tuple:
    back = pieces.decode(ids, chunk == 0)
    return (doc, chunk, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()), len(text), back == text.replace(MARK, " "), ids)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*rows, strict=True), _OUT, strict=True)], schema=_OUT)


def encode(docs: DataFrame, path: str, chunk: int = CHUNK) -> DataFrame:
    """doc_id, chunk, n_ids, ids_crc32, text_chars, round_trip and ids: a row for each document's chunk."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = Pieces(path)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = [t or "" for t in part.column(1).to_pylist()]
                found = pieces.sp.encode(texts, num_threads=1)
                yield _batch([_row(pieces, d, 0, ids, t) for d, ids, t in zip(part.column(0).to_pylist(), found, texts, strict=True)])

    longest = Pieces(path).longest

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each text's chunks with as much on both sides as a piece may reach: cut in one pass."""
        for batch in batches:
            for doc, row, text in zip(*(c for c in batch.columns), strict=True):
                t = MARK + text.as_py().replace(" ", MARK)
                for k, s in enumerate(range(0, len(t), chunk)):
                    e, left = min(s + chunk, len(t)), max(0, s - longest)
                    cols = {"doc_id": [doc.as_py()], "row": [row.as_py()], "chunk": [k], "block": [k // BLOCK], "s": [s], "e": [e], "left": [left], "window": [t[left : e + longest]]}
                    yield pa.RecordBatch.from_pydict(cols, schema=windowed)

    windowed = pa.schema([("doc_id", pa.int64()), ("row", pa.int64()), ("chunk", pa.int32()), ("block", pa.int32()), ("s", pa.int64()), ("e", pa.int64()), ("left", pa.int64()), ("window", pa.string())])

    def matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = Pieces(path)
        for batch in batches:
            for r in batch.to_pylist():
                o = r["left"]
                entries, exits, m = pieces.transfer(r["window"], r["s"] - o, r["e"] - o)
                flat = [[x + o for s in states for x in s] for states in (entries, exits)]
                if r["s"] == 0:
                    flat[0] = [0, 0]
                yield pa.RecordBatch.from_pydict({"row": [r["row"]], "chunk": pa.array([r["chunk"]], pa.int32()), "block": pa.array([r["block"]], pa.int32()), "entries": [flat[0]], "exits": [flat[1]], "weights": [m.ravel().tolist()]})

    pairs = lambda v: list(zip(v[::2], v[1::2], strict=True))

    def held(t: pa.Table, order: str) -> tuple[pa.Table, list, list, list[np.ndarray]]:
        t = t.sort_by(order)
        entries, exits = ([pairs(v) for v in t.column(c).to_pylist()] for c in ("entries", "exits"))
        weights = [np.array(w).reshape(len(e), len(x)) for e, x, w in zip(entries, exits, t.column("weights").to_pylist(), strict=True)]
        return t, entries, exits, weights

    def block_matrix(t: pa.Table) -> pa.Table:
        t, _, _, weights = held(t, "chunk")
        cols = t.select(["row", "block", "entries"]).slice(0, 1).append_column("exits", t.column("exits").slice(len(t) - 1))
        return cols.append_column("weights", pa.array([product(weights).ravel().tolist()], pa.list_(pa.float64())))

    def scan(t: pa.Table) -> pa.Table:
        t, _, exits, weights = held(t, "block")
        end = exits[-1][-1][1]
        reached = product(weights)
        last = next(k for k, x in enumerate(exits[-1]) if x[1] == end and reached[0, k] == 0)
        found = cuts_of(weights, 0, last)
        return pa.table({"row": t.column("row"), "block": t.column("block"), "first": pa.array([a for a, _ in found], pa.int32()), "last": pa.array([b for _, b in found], pa.int32())})

    def inside(t: pa.Table, ends: pa.Table) -> pa.Table:
        t, entries, exits, weights = held(t, "chunk")
        found = cuts_of(weights, ends.column("first")[0].as_py(), ends.column("last")[0].as_py())
        states = [[*entries[k][a], *exits[k][b]] for k, (a, b) in enumerate(found)]
        return pa.table({"row": t.column("row"), "chunk": t.column("chunk"), "cut": pa.array(states, pa.list_(pa.int64()))})

    def back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = Pieces(path)
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                o, (a, b, c, d) = r["left"], r["cut"]
                ids = pieces.trace(r["window"], r["s"] - o, r["e"] - o, (a - o, b - o), (c - o, d - o))
                text = r["window"][b - o : d - o]
                rows.append(_row(pieces, r["doc_id"], r["chunk"], ids, text[1:] if r["chunk"] == 0 else text))
            if rows:
                yield _batch(rows)

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    small = slim.where(F.length("text") < chunk).mapInArrow(whole, _SCHEMA)
    marked = slim.where(F.length("text") >= chunk).select("doc_id", F.monotonically_increasing_id().alias("row"), "text")
    windows = marked.mapInArrow(cut, "doc_id long, row long, chunk int, block int, s long, e long, left long, window string")
    windows = materialise(windows.repartition("row", "chunk"), "windows")
    states = "entries array<long>, exits array<long>, weights array<double>"
    made = materialise(windows.mapInArrow(matrices, f"row long, chunk int, block int, {states}"), "matrices")
    blocks = made.groupBy("row", "block").applyInArrow(block_matrix, f"row long, block int, {states}")
    ends = blocks.groupBy("row").applyInArrow(scan, "row long, block int, first int, last int")
    states = made.groupBy("row", "block").cogroup(ends.groupBy("row", "block")).applyInArrow(inside, "row long, chunk int, cut array<long>")
    giant = windows.join(states, ["row", "chunk"]).mapInArrow(back, _SCHEMA)
    return small.unionByName(giant)


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op4_sentencepiece(spark, sf_dir: str) -> DataFrame:
    """Every document's ids in digests, by chunks, and whether decoding gives the text back."""
    return encode(table(spark, sf_dir, "documents"), default_model()).drop("ids")
