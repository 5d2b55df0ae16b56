"""Best-fit packing of tokenised documents, with certified bin counts.

Documents become token ids (and a closing id); longer ones are cut into pieces
of the full capacity, the first of which takes the odd rest. Full pieces are
sequences of their own. The other pieces are dealt by hash to partitions of
about PART_ITEMS, and each partition is packed by best-fit decreasing.

Every partition gets a certificate: the largest of a family of dual feasible
functions' bounds says how many bins its pieces need at least. A partition that
reaches its bound is done. One with a gap hands over the pieces of its emptiest
bins, four for each bin of the gap and four more, but half of its bins at most;
those of many partitions are exchanged, dealt anew to fewer partitions and packed
again, until one partition is left or no gap is. The emptiest half of the bins holds
half of the tokens at most, so each round passes on half of what it got or less: as
many rounds as the partitions' number has binary digits, and some two passes over
the pieces in all. `certified` also gives each partition's bound, bins and gap.

Defined results: a null text counts as empty, which is one closing id; repeated
rows are packed each by itself; an empty table gives no rows; extra columns are
ignored.
"""

from __future__ import annotations

import json
import re
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronolane.llm.common import materialise, nullable, table

CAPACITY, CLOSING = 2048, 0
PART_ITEMS = 50_000
#: Stretches of a text whose ids a worker remembers: how many in each of two generations at most, and up to which length.
MEMORY, MEMORABLE = 300_000, 48
_MARK = r'[.,;:!?%&$#*)"]'
#: Stretches end before a single space between two other characters, and between a letter or digit and a mark. The first two forms are the common ones.
_STRETCH = re.compile(rf" ?[^\W_]++(?={_MARK}| \S|\Z)|{_MARK}++(?= \S|\Z)|[\s\S]+?(?:(?<=\S)(?= \S)|(?<=[^\W_])(?={_MARK})|\Z)")

#: A stretch that the byte-level split leaves in one piece, whatever the letters, and whose bytes stand for themselves but for the space.
_LETTERS, _SPACE = re.compile(" ?[A-Za-z]+"), "\u0120"


class Encoder(dict):
    """Ids of stretches of text by tokenizers, without the special tokens a model adds, as little-endian bytes.

    With a byte-level split and no normaliser a single space between two other
    characters always opens a new piece, as does a mark after a letter or digit,
    so a text is cut there and each stretch is encoded by tokenizers once for as
    long as it is remembered: the ids are those of the whole text. A new stretch of
    plain letters goes straight to the tokenizers model, as it is one piece. With
    other files a text is one stretch.
    """

    def __init__(self, path: str, memory: int = MEMORY) -> None:
        super().__init__()
        self.memory = memory
        self.older: dict[str, bytes] = {}
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        spec = json.loads(Path(path).read_text())
        split, added = spec.get("pre_tokenizer") or {}, self.whole.get_added_tokens_decoder().values()
        plain = not spec.get("normalizer") and split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space")
        self.model = self.whole.model
        self.letters = plain and all(re.search("[^A-Za-z ]", t.content) for t in added)
        self.cuts = plain and not any(len(_STRETCH.findall(t.content)) > 1 or t.lstrip or t.rstrip or t.single_word for t in added)

    def __missing__(self, stretch: str) -> bytes:
        ids = self.older.get(stretch)
        if ids is None:
            if self.letters and _LETTERS.fullmatch(stretch):
                found = [t.id for t in self.model.tokenize(stretch.replace(" ", _SPACE))]
            else:
                found = self.whole.encode(stretch, add_special_tokens=False).ids
            ids = struct.pack(f"<{len(found)}I", *found)
        if len(stretch) <= MEMORABLE:
            if len(self) >= self.memory:
                self.older = dict(self)
                self.clear()
            self[stretch] = ids
        return ids

    def encode(self, text: str) -> bytes:
        return b"".join(map(self.__getitem__, _STRETCH.findall(text))) if self.cuts else self[text]


@lru_cache(maxsize=1)
def encoder(path: str, memory: int = MEMORY) -> Encoder:
    """The worker process's encoder of a file: what one task remembers serves the next."""
    return Encoder(path, memory)


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, closing: int = CLOSING, memory: int = MEMORY) -> DataFrame:
    """doc_id, piece, start, length and ids_crc32 of every piece of every document; memory: stretches remembered in each generation, whatever the result."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = encoder(path, memory).encode, np.array([closing], "<u4").tobytes()
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                rows, out = part.column(0).to_pylist(), []
                for doc, text in zip(rows, part.column(1).to_pylist(), strict=True):
                    ids = encode(text or "") + end
                    n = len(ids) // 4
                    head = n % capacity or capacity
                    starts = [0, *range(head, n, capacity)]
                    for k, (a, b) in enumerate(zip(starts, [*starts[1:], n], strict=True)):
                        out.append((doc, k, a, b - a, zlib.crc32(ids[4 * a : 4 * b])))
                cols = list(zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int32()), *(pa.array(c, pa.int64()) for c in cols[2:])], ["doc_id", "piece", "start", "length", "ids_crc32"])

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return slim.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def least_bins(count: np.ndarray) -> int:
    """A lower bound of the bins that pieces need; count[s] pieces have the size s, the capacity is len(count) - 1.

    The largest bound of these dual feasible functions: the sum of the sizes;
    for each threshold t up to half the capacity, sizes above capacity - t count
    as full and those below t as nothing; and for each k, sizes rounded down to
    k-ths of the capacity (exact (k+1)-ths keep their own size).
    """
    cap = len(count) - 1
    size = np.arange(cap + 1)
    total = count.cumsum()
    volume = (count * size).cumsum()
    best = -(-int(volume[-1]) // cap)
    t = np.arange(1, cap // 2 + 1)
    full = total[-1] - total[cap - t]
    middle = volume[cap - t] - volume[t - 1]
    if len(t):
        best = max(best, int((full + -(-middle // cap)).max()))
    for k in range(1, 101):
        whole = (size * (k + 1)) % cap == 0
        value = np.where(whole, size * k, (size * (k + 1) // cap) * cap)  # in units of k times the capacity
        best = max(best, -(-int((count * value).sum()) // (k * cap)))
    return best


def best_fit(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """The bin of each piece: largest pieces first, each to the fullest bin that has room."""
    bins = np.zeros(len(sizes), np.int64)
    open_: list[list[int]] = [[] for _ in range(capacity + 1)]  # bins by room left
    rooms, made = 0, 0  # rooms: bit r is set if a bin has exactly r left
    for i in np.argsort(-sizes, kind="stable").tolist():
        s = int(sizes[i])
        above = rooms >> s
        if above:
            r = s + (above & -above).bit_length() - 1
            b = open_[r].pop()
            if not open_[r]:
                rooms ^= 1 << r
        else:
            r, b = capacity, made
            made += 1
        bins[i] = b
        if r - s:
            open_[r - s].append(b)
            rooms |= 1 << (r - s)
    return bins


def _packed(lengths: np.ndarray, capacity: int, last: bool) -> tuple[np.ndarray, np.ndarray, tuple[int, int]]:
    """Bin (-1: handed over) and offset of each piece; the lower bound and the number of bins."""
    bins = best_fit(lengths, capacity)
    made = int(bins.max()) + 1 if len(bins) else 0
    bound = least_bins(np.bincount(lengths, minlength=capacity + 1))
    if made > bound and not last:
        fill = np.bincount(bins, weights=lengths, minlength=made)
        handed = np.argsort(fill, kind="stable")[: min(4 * (made - bound) + 4, made // 2)]
        bins = np.where(np.isin(bins, handed), -1, bins)
    order = np.argsort(bins, kind="stable")
    before = np.cumsum(lengths[order]) - lengths[order]
    new = np.ones(len(order), bool)
    new[1:] = np.diff(bins[order]) != 0
    offset = np.empty(len(order), np.int64)
    offset[order] = before - np.maximum.accumulate(np.where(new, before, 0))
    return bins, offset, (bound, made)


def _packer(names: list[str], part: str, capacity: int, last: bool, seq: int):
    def packed(t: pa.Table) -> pa.Table:
        t = t.sort_by([(c, "ascending") for c in ["length", *[c for c in names if c != "length"]]])
        bins, offset, (bound, made) = _packed(t.column("length").to_numpy().astype(np.int64), capacity, last)
        base = (seq << 56) + (t.column(part)[0].as_py() << 24)
        t = pa.table([c.cast(nullable(c.type)) for c in t.columns], t.column_names)
        out = t.select(names).append_column("sequence_id", pa.array(np.where(bins < 0, -1, bins + base)))
        out = out.append_column("offset", pa.array(offset)).append_column(part, t.column(part))
        return out.append_column("bound", pa.array(np.full(t.num_rows, bound))).append_column("bins", pa.array(np.full(t.num_rows, made)))

    return packed


def certified(items: DataFrame, capacity: int = CAPACITY, part_items: int = PART_ITEMS) -> tuple[DataFrame, DataFrame]:
    """The items (with a column length from 1 to the capacity) with sequence_id and offset, in place of columns of these names; and the certificates.

    A certificate is a row of round, part, bound (bins that the part's pieces need
    at least), bins (that they got), gap, and handed (pieces passed on). Equal rows
    are dealt apart.
    """
    items = items.drop("sequence_id", "offset")
    names = items.columns
    slim = items.select(F.struct(*names).alias("item"), "length")
    kind = slim.schema["item"].dataType.simpleString()
    full = slim.where(F.col("length") == capacity)
    # the sign tells full pieces from packed ones, whose number holds round, partition and bin
    done = [full.select("item", (-1 - F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))]
    rest, seq, proofs = slim.where(F.col("length") < capacity), 0, []
    n = rest.count()
    while n:
        parts = -(-n // part_items)
        last = parts == 1
        dealt = rest.withColumn("part", F.pmod(F.xxhash64(F.lit(seq), F.monotonically_increasing_id()), F.lit(parts)).cast("long"))
        packed = dealt.groupBy("part").applyInArrow(_packer(["item", "length"], "part", capacity, last, seq), f"item {kind}, length {dict(slim.dtypes)['length']}, sequence_id long, offset long, part long, bound long, bins long")
        tried = materialise(packed, "packed")
        made = tried.groupBy("part").agg(F.first("bound").alias("bound"), F.first("bins").alias("bins"), F.count_if(F.col("sequence_id") < 0).alias("handed"))
        proofs.append(made.select(F.lit(seq).alias("round"), "part", "bound", "bins", (F.col("bins") - F.col("bound")).alias("gap"), "handed"))
        done.append(tried.where("sequence_id >= 0").select("item", "sequence_id", "offset"))
        rest, seq = tried.where("sequence_id < 0").select("item", "length"), seq + 1
        n = rest.count()
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    schema = "round int, part long, bound long, bins long, gap long, handed long"
    proof = items.sparkSession.createDataFrame([], schema)
    for p in proofs:
        proof = proof.unionByName(p)
    return out.select("item.*", "sequence_id", "offset"), proof


def pack(items: DataFrame, capacity: int = CAPACITY, part_items: int = PART_ITEMS) -> DataFrame:
    """`certified` without the certificates."""
    return certified(items, capacity, part_items)[0]


def lower_bound(items: DataFrame, capacity: int = CAPACITY) -> int:
    """The certificate for all items together; it gathers one count for each size up to the capacity."""
    count = np.zeros(capacity + 1, np.int64)
    for r in items.groupBy("length").count().collect():
        count[r["length"]] = r["count"]
    return least_bins(count)


def packed_documents(docs: DataFrame, path: str, capacity: int = CAPACITY, memory: int = MEMORY) -> DataFrame:
    """The pieces of the documents with their places; ids come once and are kept in the shared folder."""
    return pack(materialise(pieces(docs, path, capacity, memory=memory), "pieces"), capacity)


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op9_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    """All documents in sequences of 2048 tokens."""
    return packed_documents(table(spark, sf_dir, "documents"), default_vocabulary())
