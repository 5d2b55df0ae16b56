"""Substring deduplication with difference-cover anchors.

A window is `length` consecutive words of one document. A word goes if a window
over it has a word sequence that also starts earlier: in a document with a
smaller doc_id, or earlier in the same document.

With a difference cover D of the residues modulo v, any two positions i and j
have a shift d < v for which both i + d and j + d fall on the cover. So of each
document only the anchors (the first length - v + 1 words from a position whose
residue is in D) are hashed and sent out: two equal windows always share an
aligned anchor. Anchors found in one group of documents only need no further
look. Where an anchor is known elsewhere, it is extended: the full windows
around it go out once per group with their first place, and each group hears
which of its windows start earlier in another one. Windows that repeat within a
group are settled there.

Documents are dealt to groups by a hash of their id and text, about GROUP_BYTES of
text each, so copies, common passages and rows that share an id never meet in one
task: of a passage a task sees one row per group. Only rows that are equal in both
lie together.

A word's hash is its bytes as a polynomial at fixed places of four prime fields: two
different words of n bytes agree in one field at n of its 2^31 places at most, and
no form of word (as with sums that overflow) agrees at all. Two of the fields make
one half of a window's hash, the other two the other. Anchors only pick candidates:
sums of the one half, cut to 48 bits. Windows are told apart by 96 bits: 64 of sums
of the one half, 32 of sums of the other. What is left to chance is that two
different windows agree in all of these.

Defined results: a null text has no words; a null doc_id counts as smaller than
any other; rows that share a doc_id are not earlier than each other, except by a
smaller start; repeated rows are each returned; an empty table gives no rows;
extra columns are ignored by `repeats` and kept by `without_repeats`.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronolane.llm.common import nullable, partitions, table

LENGTH = 20
GROUP_BYTES = 8_000_000
#: Difference covers: every residue modulo v is a difference of two members.
COVERS = {1: (0,), 3: (0, 1), 7: (1, 2, 4), 13: (0, 1, 3, 9), 31: (1, 5, 11, 24, 25, 27)}
_NO_ID = -(2**63)
#: Bits for the rank of a text among those of one doc_id in a group.
_RANK_BITS = 20


def cover_for(length: int) -> tuple[int, np.ndarray]:
    """The widest period that leaves anchors of at least two fifths of the length."""
    period = max(v for v in COVERS if length - v + 1 >= 0.4 * length)
    return period, np.array(COVERS[period])


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: Primes below 2^31 and places of their fields, drawn at random once.
FIELDS = ((2147483647, 1466739587), (2147483629, 870315311), (2147483587, 1929402263), (2147483579, 315470837))
#: Bytes of a text that are hashed at once: a worker keeps powers for twice as many, eight tables of 8 bytes each.
_PIECE = 1 << 16


class Hasher:
    """Hashes all words of a text at once: sums over the bytes up to each end, the part before the word taken off, and its place divided out."""

    def __init__(self) -> None:
        self.separator = np.zeros(256, bool)
        self.separator[[9, 10, 11, 12, 13, 32]] = True
        self.power = [(np.ones(1, np.uint64), np.ones(1, np.uint64)) for _ in FIELDS]

    def _grow(self, n: int) -> None:
        def doubled(x: np.ndarray, base: int, p: int) -> np.ndarray:
            while len(x) < n:
                x = np.concatenate([x, x * np.uint64(pow(base, len(x), p)) % np.uint64(p)])
            return x

        self.power = [(doubled(up, b, p), doubled(back, pow(b, -1, p), p)) for (up, back), (p, b) in zip(self.power, FIELDS, strict=True)]

    def words(self, raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each word where it starts and two independent hashes, the same wherever the word stands."""
        data, at, out = np.frombuffer(raw, np.uint8), 0, []
        while at < len(data):
            end = min(len(data), at + _PIECE)
            while end < len(data) and not (gap := self.separator[data[end : end + 4096]]).any():
                end = min(len(data), end + len(gap))
            if end < len(data):
                end += int(gap.argmax())
            start, one, other = self._piece(data[at:end])
            out.append((start + at, one, other))
            at = end
        if len(self.power[0][0]) > 2 * _PIECE:  # a longer word's powers go with it: workers live on through other stages
            self.power = [tuple(x[: 2 * _PIECE].copy() for x in pair) for pair in self.power]
        none = [(np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint64))]
        return tuple(np.concatenate(c) for c in zip(*(out or none), strict=True))

    def _piece(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        edge = np.diff(np.concatenate([[False], ~self.separator[data], [False]]).astype(np.int8))
        start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        if not len(start):
            return start, np.zeros(0, np.uint64), np.zeros(0, np.uint64)
        self._grow(len(data))
        length, value, values = (end - start).astype(np.uint64), data.astype(np.uint64) + np.uint64(1), []
        for (p, _), (up, back) in zip(FIELDS, self.power, strict=True):
            # below 2^39 each: 2^25 of them cannot overflow; longer words are summed by parts
            total = np.zeros(len(data) + 1, np.uint64)
            if len(data) <= 1 << 24:
                np.cumsum(value * up[: len(data)], out=total[1:])
            else:
                np.cumsum(value * up[: len(data)] % np.uint64(p), out=total[1:])
            values.append((total[end] - total[start]) % np.uint64(p) * back[start] % np.uint64(p))
        a, b, c, d = values
        join = lambda x, y: _mix(((x << np.uint64(32)) | y) ^ (length * np.uint64(0x9E3779B97F4A7C15)))
        return start, join(a, b), join(c, d)


@lru_cache(maxsize=1)
def hasher() -> Hasher:
    """A worker's hasher: its powers are worked out once."""
    return Hasher()


def _run(words: np.ndarray, at: np.ndarray, n: int, factor: int) -> np.ndarray:
    """A hash of the n words from each position."""
    out = np.zeros(len(at), np.uint64)
    for k in range(n):
        out = out * np.uint64(factor) + words[at + k]
    return _mix(out)


def _anchor_places(n_words: int, length: int) -> np.ndarray:
    period, cover = cover_for(length)
    size = length - period + 1
    if n_words < length:
        return np.zeros(0, np.int64)
    at = (np.arange(0, n_words, period)[:, None] + cover[None, :]).ravel()
    return at[at <= n_words - size]


class Group:
    """The words of a group's documents, side by side, in the order of their ids."""

    def __init__(self, ids: list, texts: list, length: int) -> None:
        self.length = length
        self.ids = np.array([_NO_ID if i is None else i for i in ids], np.int64)
        self.raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
        # rows that share an id are told apart by their rank among its texts
        self.rank = np.zeros(len(ids), np.int64)
        order = sorted(range(len(ids)), key=lambda i: (self.ids[i], self.raw[i]))
        for a, b in zip(order, order[1:], strict=False):
            if self.ids[a] == self.ids[b]:
                self.rank[b] = self.rank[a] + (self.raw[a] != self.raw[b])
        start, self.words, self.other = hasher().words(b"\n".join(self.raw))
        ends = np.cumsum([len(r) + 1 for r in self.raw], dtype=np.int64)
        self.sizes = np.diff(np.searchsorted(start, ends), prepend=0).astype(np.int64)
        self.begin = np.concatenate([[0], np.cumsum(self.sizes)])

    def anchors(self) -> tuple[np.ndarray, np.ndarray]:
        """Places (in the row of all words) and hashes of all anchors."""
        places = [_anchor_places(int(n), self.length) + b for n, b in zip(self.sizes, self.begin[:-1], strict=True)]
        at = np.concatenate(places) if places else np.zeros(0, np.int64)
        period, _ = cover_for(self.length)
        return at, _run(self.words, at, self.length - period + 1, 0xA0761D6478BD642F) >> np.uint64(16)

    def windows(self, near: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places of windows (of those that hold an anchor at one of the places `near`, if given) and two hashes of each."""
        valid = np.zeros(len(self.words) + 1, bool)
        for n, b in zip(self.sizes, self.begin[:-1], strict=True):
            if n >= self.length:
                valid[b : b + n - self.length + 1] = True
        if near is not None:
            period, _ = cover_for(self.length)
            # an anchor at p lies in the windows from p - period + 1 to p
            edge = np.zeros(len(self.words) + 2, np.int64)
            np.add.at(edge, np.maximum(near - period + 1, 0), 1)
            np.add.at(edge, near + 1, -1)
            valid &= np.cumsum(edge)[: len(valid)] > 0
        at = np.flatnonzero(valid)
        second = _run(self.other, at, self.length, 0x8EBC6AF09C88C6E3) >> np.uint64(32)
        return at, _run(self.words, at, self.length, 0xE7037ED1A0B428DB), second.astype(np.uint32)

    def where(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of places: the ids, and the starts in the documents with the documents' ranks in the lowest bits."""
        doc = np.searchsorted(self.begin, at, side="right") - 1
        return self.ids[doc], ((at - self.begin[doc]) << _RANK_BITS) | self.rank[doc]

    def firsts(self, at: np.ndarray, h1: np.ndarray, h2: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of windows: the order by hashes, doc_id and start; where a new hash begins; which share the first one's doc_id and start."""
        doc = np.searchsorted(self.begin, at, side="right") - 1
        key, start = self.ids[doc], at - self.begin[doc]
        order = np.lexsort((start, key, h2, h1))
        h1, h2, key, start = h1[order], h2[order], key[order], start[order]
        new = np.ones(len(at), bool)
        new[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
        head = np.flatnonzero(new)[np.cumsum(new) - 1] if len(at) else np.zeros(0, np.int64)
        return order, new, (key == key[head]) & (start == start[head])


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _group_count(docs: DataFrame) -> int:
    """Groups of about GROUP_BYTES of text, at least four for each shuffle partition."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return max(4 * partitions(docs.sparkSession), -(-size // GROUP_BYTES))


def _apart(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of (hash, g) sorted by hash: the rows whose hash more than one g has. A run is told from its first and last row."""
    last_hash, last_g, told = None, None, False
    for batch in rows:
        h, g = (c.to_numpy() for c in batch.columns)
        if not len(h):
            continue
        same = np.zeros(len(h), bool)
        same[1:] = h[1:] == h[:-1]
        follows = last_hash is not None and h[0] == last_hash
        keep = same.copy()
        keep[:-1] |= same[1:]
        keep[0] |= follows
        if follows and not told:
            yield pa.RecordBatch.from_arrays([pa.array([last_g]), pa.array([last_hash])], ["g", "hash"])
        yield pa.RecordBatch.from_arrays([pa.array(g[keep]), pa.array(h[keep])], ["g", "hash"])
        last_hash, last_g, told = h[-1], g[-1], bool(keep[-1])


def _later(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of (h1, h2, id, at, g) sorted by all: the rows that are not at the first (id, start) of their hashes, as (g, id, at)."""
    head = None
    for batch in rows:
        c = [x.to_numpy() for x in batch.columns]
        n = batch.num_rows
        if not n:
            continue
        new = np.ones(n, bool)
        new[1:] = (c[0][1:] != c[0][:-1]) | (c[1][1:] != c[1][:-1])
        if head is not None and (c[0][0], c[1][0]) == head[:2]:
            new[0] = False
        start = c[3] >> _RANK_BITS
        at = np.maximum.accumulate(np.where(new, np.arange(n), -1))
        first_id = np.where(at < 0, head[2] if head else 0, c[2][at])
        first_start = np.where(at < 0, head[3] if head else 0, start[at])
        late = (c[2] != first_id) | (start != first_start)
        yield pa.RecordBatch.from_arrays([pa.array(x[late]) for x in (c[4], c[2], c[3])], ["g", "id", "at"])
        head = (c[0][-1], c[1][-1], first_id[-1], first_start[-1])


def _dealt(docs: DataFrame) -> DataFrame:
    count = _group_count(docs)
    return docs.withColumn("g", F.pmod(F.xxhash64("id", "text"), F.lit(count)).cast("int")).repartition("g")


def _late_windows(dealt: DataFrame, length: int) -> DataFrame:
    """g, id, at: the first places in a group of windows that start earlier in another group."""

    def anchors(t: pa.Table) -> pa.Table:
        group = Group(t.column("id").to_pylist(), t.column("text").to_pylist(), length)
        hashes = np.unique(group.anchors()[1])
        return pa.table({"hash": _signed(hashes), "g": pa.array(np.full(len(hashes), t.column("g")[0].as_py(), np.int32))})

    def extend(t: pa.Table, known: pa.Table) -> pa.Table:
        if not t.num_rows or not known.num_rows:
            return schema.empty_table()
        group = Group(t.column("id").to_pylist(), t.column("text").to_pylist(), length)
        at, hashes = group.anchors()
        shared = np.unique(known.column("hash").to_numpy()).view(np.uint64)
        at, h1, h2 = group.windows(near=at[np.isin(hashes, shared)])
        order, new, _ = group.firsts(at, h1, h2)
        pick = np.sort(order[new])  # in the order of places: neighbours differ little
        at, h1, h2 = at[pick], h1[pick], h2[pick]
        key, where = group.where(at)
        columns = [_signed(h1), pa.array(h2.view(np.int32)), pa.array(key), pa.array(where), pa.array(np.full(len(h1), t.column("g")[0].as_py(), np.int32))]
        return pa.table(columns, schema=schema)

    schema = pa.schema([("h1", pa.int64()), ("h2", pa.int32()), ("id", pa.int64()), ("at", pa.int64()), ("g", pa.int32())])
    known = dealt.groupBy("g").applyInArrow(anchors, "hash long, g int").repartition("hash").sortWithinPartitions("hash").mapInArrow(_apart, "g int, hash long")
    found = dealt.groupBy("g").cogroup(known.groupBy("g")).applyInArrow(extend, "h1 long, h2 int, id long, at long, g int")
    return found.repartition("h1", "h2").sortWithinPartitions("h1", "h2", "id", "at").mapInArrow(_later, "g int, id long, at long")


def _settled(group: Group, late_id: np.ndarray, late_at: np.ndarray) -> list[np.ndarray]:
    """Of each document, which words go: as arrays of booleans."""
    at, h1, h2 = group.windows()
    order, new, at_first = group.firsts(at, h1, h2)
    gone = ~at_first
    if len(late_id):
        heads = at[order[new]]
        place = np.dtype([("id", "<i8"), ("at", "<i8")])
        late, own = np.empty(len(late_id), place), np.empty(len(heads), place)
        late["id"], late["at"] = late_id, late_at
        own["id"], own["at"] = group.where(heads)
        near = np.flatnonzero(np.isin(own["id"], late["id"]))  # a quick sieve before whole places are compared
        elsewhere = np.zeros(len(heads), bool)
        elsewhere[near] = np.isin(own[near], late)
        gone |= elsewhere[np.cumsum(new) - 1]
    edge = np.zeros(len(group.words) + group.length + 1, np.int64)
    hit = at[order[gone]]
    edge[hit] += 1  # a place has one window only
    edge[hit + group.length] -= 1
    covered = np.cumsum(edge)[: len(group.words)] > 0
    return [covered[b : b + n] for b, n in zip(group.begin[:-1], group.sizes, strict=True)]


def repeats(docs: DataFrame, row: Column, length: int = LENGTH) -> DataFrame:
    """row (as given), doc_id, n_words, n_removed, kept_sha256 and kept (the text left; null where nothing goes)."""
    slim = docs.select(row.alias("row"), F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text"))
    dealt = _dealt(slim)
    kind = dealt.schema["row"].dataType

    def settle(t: pa.Table, late: pa.Table) -> pa.Table:
        group = Group(t.column("id").to_pylist(), t.column("text").to_pylist(), length)
        none = np.zeros(0, np.int64)
        gone = _settled(group, *((late.column(c).to_numpy() for c in ("id", "at")) if late.num_rows else (none, none)))
        digests, left = [], []
        for raw, out in zip(group.raw, gone, strict=True):
            found = raw.split()
            if out.any():
                found = [w for w, x in zip(found, out.tolist(), strict=True) if not x]
                left.append(b" ".join(found).decode("utf-8", "surrogatepass"))
            else:
                left.append(None)
            digests.append(hashlib.sha256(b" ".join(found)).hexdigest())
        removed = np.array([int(x.sum()) for x in gone], np.int64)
        row = t.column("row")
        return pa.table({"row": row.cast(nullable(row.type)), "doc_id": t.column("id"), "n_words": pa.array(group.sizes), "n_removed": pa.array(removed), "kept_sha256": pa.array(digests, pa.string()), "kept": pa.array(left, pa.string())})

    late = _late_windows(dealt, length)
    schema = f"row {kind.simpleString()}, doc_id long, n_words long, n_removed long, kept_sha256 string, kept string"
    return dealt.groupBy("g").cogroup(late.groupBy("g")).applyInArrow(settle, schema)


def op2_substring_dedup(spark, sf_dir: str) -> DataFrame:
    """Every document's words, and those that a repeated passage of 20 words takes out."""
    out = repeats(table(spark, sf_dir, "documents"), F.lit(0))
    return out.select("doc_id", "n_words", "n_removed", "kept_sha256")


def without_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """The documents with the repeated passages taken out of their texts; columns as they come.

    A text that loses nothing stays as it is, white space and all; in others the
    kept words are joined by one space. A column n_chars follows the new text.
    """
    out = repeats(docs, F.struct(*docs.columns), length)
    row = F.col("row").withField("text", F.coalesce("kept", "row.text"))
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        row = row.withField("n_chars", F.when(F.col("kept").isNull(), F.col("row.n_chars")).otherwise(F.length("kept")).cast(kind))
    return out.select(row.alias("row")).select("row.*")
