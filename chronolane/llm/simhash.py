"""SimHash near-duplicates by tiled exact comparison.

Each text gets a 64-bit fingerprint: the majority bits of the XXH64 hashes of
its word shingles. Equal fingerprints are folded into one row first, so a group
of copies costs one fingerprint. Distinct fingerprints are laid out in tiles of
at most TILE rows that share the population counts of their four 16-bit
quarters. Two fingerprints that differ in r bits differ by at most r in the sum
of those counts' differences, so a tile meets only the tiles within that
distance and all other pairs of tiles are skipped. A pair of tiles is compared
in full (exclusive-or, bit count); of its links a spanning forest is kept, which
connects the same fingerprints. Components over the forests come from
alternating star contractions, each round a written table.

Defined results: a null text counts as empty; a text without words has the
fingerprint zero and links like any other; repeated rows and equal texts share
a fingerprint and a component; a null doc_id takes part but never names a
component, unless no document of it has an id (then it is null); an empty table
gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronolane.llm.common import materialise, table

SEED = 42
TILE = 4096
_SIDE = 17  # a 16-bit quarter has 0 to 16 bits set


def text_fingerprint(text: str | None, shingle: int = 3) -> int:
    """The fingerprint of a text, as an unsigned number."""
    found = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not found:
        return 0
    joined = b" ".join(found)
    if len(found) <= shingle:
        hashes = [xxhash.xxh64_intdigest(joined, SEED)]
    else:
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        ends = np.cumsum(sizes + 1) - 1
        first, last = (ends - sizes)[: 1 - shingle].tolist(), ends[shingle - 1 :].tolist()
        digest = xxhash.xxh64_intdigest
        hashes = [digest(joined[a:b], SEED) for a, b in zip(first, last, strict=True)]
    total = np.zeros(64, np.int64)
    values = np.array(hashes, "<u8")
    for at in range(0, len(values), 1 << 16):
        part = values[at : at + (1 << 16)]
        total += np.unpackbits(part.view(np.uint8), bitorder="little").reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return int(np.packbits(total * 2 > len(values), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """doc_id and fp (the fingerprint's bits as a signed long) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = [text_fingerprint(t.as_py(), shingle) for t in batch.column(1)]
            bits = pa.array(np.array(values, np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), bits], ["doc_id", "fp"])

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return slim.mapInArrow(run, "doc_id long, fp long")


def _quarter(fp: Column, k: int) -> Column:
    return F.bit_count(F.shiftrightunsigned(fp, 16 * k).bitwiseAND(F.lit(0xFFFF).cast("long")))


def _cell(counts: list[Column]) -> Column:
    out = counts[0]
    for c in counts[1:]:
        out = out * _SIDE + c
    return out


def _steps(radius: int) -> list[tuple[int, ...]]:
    """Moves between cells whose counts differ by the radius at most in all; of a move and its opposite, one."""
    near = [m for m in product(range(-radius, radius + 1), repeat=4) if sum(map(abs, m)) <= radius]
    return [m for m in near if m >= (0, 0, 0, 0)]


def tiles(distinct: DataFrame, size: int = TILE) -> DataFrame:
    """cell, q0..q3, slice and fps: the distinct fingerprints in tiles of about `size` rows.

    The slices of a cell come from its row count, a table of at most 17^4 rows.
    """
    at = distinct.select("fp", *[_quarter(F.col("fp"), k).alias(f"q{k}") for k in range(4)])
    at = at.withColumn("cell", _cell([F.col(f"q{k}") for k in range(4)]))
    counts = at.groupBy("cell").agg(F.ceil(F.count("*") / F.lit(size)).alias("slices"))
    at = at.join(F.broadcast(counts), "cell")  # 83,521 rows at most, whatever the input
    at = at.withColumn("slice", F.pmod(F.xxhash64("fp"), "slices").cast("int"))
    return at.groupBy("cell", "q0", "q1", "q2", "q3", "slice").agg(F.collect_list("fp").alias("fps"))


def _merge(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Join the trees of label that the links i-j connect; a root is the smallest index of its tree."""
    while True:
        a, b = label[i], label[j]
        apart = a != b
        if not apart.any():
            return
        i, j, a, b = i[apart], j[apart], a[apart], b[apart]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while not np.array_equal(up := label[label], label):
            label[:] = up


def tile_forest(a: np.ndarray, b: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links of a spanning forest over all pairs of a and b within the radius."""
    label = np.arange(len(a) + len(b))
    for at in range(0, len(a), 256):
        near = np.bitwise_count(a[at : at + 256, None] ^ b[None, :]) <= radius
        i, j = np.nonzero(near)
        if len(i):
            _merge(label, i + at, j + len(a))
    both, own = np.concatenate([a, b]), np.arange(len(label))
    linked = label != own
    return both[linked], both[label[linked]]


def links(distinct: DataFrame, radius: int = 2, size: int = TILE) -> DataFrame:
    """src, dst: links between distinct fingerprints with the components of all pairs within the radius."""
    tiled = materialise(tiles(distinct, size), "tiles")
    moves = F.array(*[F.struct(*[F.lit(x).alias(f"d{k}") for k, x in enumerate(m)]) for m in _steps(radius)])
    left = tiled.withColumn("m", F.explode(moves)).select(
        F.col("cell").alias("from"),
        _cell([F.col(f"q{k}") + F.col(f"m.d{k}") for k in range(4)]).alias("cell"),
        F.expr("m.d0 = 0 AND m.d1 = 0 AND m.d2 = 0 AND m.d3 = 0").alias("same"),
        *[(F.col(f"q{k}") + F.col(f"m.d{k}")).alias(f"t{k}") for k in range(4)],
        F.col("slice").alias("a_slice"),
    )
    for k in range(4):
        left = left.where(F.col(f"t{k}").between(0, _SIDE - 1))
    left = left.select("from", "cell", "same", "a_slice")
    own = tiled.select(F.col("cell").alias("from"), F.col("slice").alias("a_slice"), F.col("fps").alias("a"))
    right = tiled.select("cell", F.col("slice").alias("b_slice"), F.col("fps").alias("b"))
    # numbers first: the slices of a full cell meet as numbers, and each pair of tiles is a row of its own that any task may compare
    pairs = left.join(right.drop("b"), "cell").where("NOT same OR a_slice <= b_slice").drop("same")
    pairs = pairs.join(own, ["from", "a_slice"]).join(right, ["cell", "b_slice"]).repartition("from", "a_slice", "cell", "b_slice").select("a", "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = batch.column(0), batch.column(1)
            for k in range(batch.num_rows):
                x, y = (c[k].values.to_numpy(zero_copy_only=False).view(np.uint64) for c in (a, b))
                src, dst = tile_forest(x, y, radius)
                differ = src != dst
                if differ.any():
                    yield pa.RecordBatch.from_arrays([pa.array(v[differ].view(np.int64)) for v in (src, dst)], ["src", "dst"])

    return pairs.mapInArrow(run, "src long, dst long")


def components(edges: DataFrame, rounds: int = 50) -> DataFrame:
    """node, root: the smallest node reachable from each node that has a link.

    Alternating large and small stars; each round is a checkpoint in the shared
    folder, and it ends when a round changes nothing.
    """
    spark = edges.sparkSession
    both = F.array(F.struct(F.col("src").alias("u"), F.col("dst").alias("v")), F.struct(F.col("dst").alias("u"), F.col("src").alias("v")))
    edges = edges.where("src <> dst").distinct().checkpoint()
    before = None
    for _ in range(rounds):
        sides = edges.select(F.explode(both).alias("e")).select("e.u", "e.v")
        least = sides.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        edges = sides.join(least, "u").where("v > u").select(F.col("v").alias("src"), F.col("m").alias("dst")).where("src <> dst").distinct()
        down = edges.select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v"))
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        joined = down.join(least, "u")
        edges = joined.select(F.col("v").alias("src"), F.col("m").alias("dst")).union(joined.select(F.col("u").alias("src"), F.col("m").alias("dst")))
        edges = edges.where("src <> dst").distinct().checkpoint()
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("src", "dst").cast("decimal(38,0)"))).first()
        if now == before:
            return edges.select(F.col("src").alias("node"), F.col("dst").alias("root"))
        before = now
    raise RuntimeError(f"components of {spark.sparkContext.appName} did not settle in {rounds} rounds")


def near_duplicates(docs: DataFrame, shingle: int = 3, radius: int = 2, size: int = TILE) -> DataFrame:
    """doc_id, fp, component_id of every row."""
    spark = docs.sparkSession
    made = materialise(fingerprints(docs, shingle), "fingerprints")
    distinct = made.groupBy("fp").agg(F.min("doc_id").alias("first_id"))
    roots = components(links(distinct.select("fp"), radius, size)) if not made.isEmpty() else spark.createDataFrame([], "node long, root long")
    named = distinct.join(roots, distinct["fp"] == roots["node"], "left").select("fp", "first_id", F.coalesce("root", "fp").alias("root"))
    least = named.groupBy("root").agg(F.min("first_id").alias("component_id"))
    named = named.join(least, "root").select("fp", "component_id")
    return made.join(named, "fp").select("doc_id", "fp", "component_id")


def hex16(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def op7_simhash_near_dedup(spark, sf_dir: str) -> DataFrame:
    """Every document's fingerprint, and the smallest doc_id reachable by links of two bits or fewer."""
    out = near_duplicates(table(spark, sf_dir, "documents"))
    return out.select("doc_id", hex16(F.col("fp")).alias("fingerprint"), "component_id")


#: For near copies: the similarity asked for, bits, the radius of candidates, that of the first 64 bits, and what a tile holds: texts, and shingle hashes of a group's texts, about.
SIMILARITY_9THS = 4  # similarity 0.8: 9 * common >= 4 * (size + size)
WIDE_BITS, WIDE_RADIUS, FIRST_RADIUS, WIDE_TILE, TILE_HASHES = 256, 64, 20, 8192, 1 << 19


def shingle_set(text: str | None, shingle: int = 5) -> np.ndarray:
    """The distinct hashes of a text's word shingles, in order."""
    found = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not found:
        return np.zeros(0, np.uint64)
    joined = b" ".join(found)
    if len(found) <= shingle:
        return np.array([xxhash.xxh64_intdigest(joined, SEED)], np.uint64)
    sizes = np.fromiter(map(len, found), np.int64, len(found))
    ends = np.cumsum(sizes + 1) - 1
    first, last = (ends - sizes)[: 1 - shingle].tolist(), ends[shingle - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    return np.unique(np.array([digest(joined[a:b], SEED) for a, b in zip(first, last, strict=True)], np.uint64))


def wide_fingerprint(values: np.ndarray) -> list[int]:
    """WIDE_BITS majority bits in 64-bit words: of each distinct shingle's hash and of values mixed from it."""
    words = WIDE_BITS // 64
    total = np.zeros(WIDE_BITS, np.int64)
    for at in range(0, len(values), 1 << 14):
        part = values[at : at + (1 << 14)]
        wide = np.stack([part, *[_mixed(part, k) for k in range(1, words)]], axis=1)
        total += np.unpackbits(wide.view(np.uint8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return np.packbits(total * 2 > len(values), bitorder="little").view("<i8").tolist()


def _mixed(x: np.ndarray, k: int) -> np.ndarray:
    x = x + np.uint64(0x9E3779B97F4A7C15 * k & (2**64 - 1))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _set_key(values: np.ndarray) -> tuple[bytes, int]:
    """A digest of a set of hashes, and its first 64 bits as a signed number."""
    sig = xxhash.xxh3_128_digest(values.astype("<u8").tobytes(), SEED)
    return sig, int.from_bytes(sig[:8], "little", signed=True)


def _alike(a: dict, b: dict, same: bool, radius: int, block: int = 64) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """i, j and the bits that differ: pairs of a row of a and one of b that may be near copies, for some rows of a at a time.

    The first word sieves, all words decide, and sets whose sizes alone rule the
    similarity out go. same: a and b are one tile; each pair comes once.
    """
    for at in range(0, len(a["n"]), block):
        i, j = np.nonzero(np.bitwise_count(a["w"][at : at + block, None, 0] ^ b["w"][None, :, 0]) <= FIRST_RADIUS)
        i = i + at
        if same:
            i, j = i[i < j], j[i < j]
        far = np.bitwise_count(a["w"][i] ^ b["w"][j]).sum(axis=1, dtype=np.int64)
        low, high = np.minimum(a["n"][i], b["n"][j]), np.maximum(a["n"][i], b["n"][j])
        near = (far <= radius) & ((9 - SIMILARITY_9THS) * low >= SIMILARITY_9THS * high)
        yield i[near], j[near], far[near]


def candidate_forest(a: dict, b: dict, same: bool, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links of a spanning forest over all pairs that may be near copies."""
    off = 0 if same else len(a["n"])
    label = np.arange(off + len(b["n"]))
    for i, j, _ in _alike(a, b, same, radius):
        _merge(label, i, j + off)
    ids = b["id"] if same else np.concatenate([a["id"], b["id"]])
    linked = label != np.arange(len(label))
    return ids[linked], ids[label[linked]]


def _common(own: np.ndarray, tile: dict, rows: np.ndarray) -> np.ndarray:
    """How many of a set's hashes each of the tile's rows holds."""
    out = np.zeros(len(rows), np.int64)
    ends = np.cumsum(tile["n"][rows])
    for part in np.split(np.arange(len(rows)), np.flatnonzero(np.diff(ends // TILE_HASHES)) + 1):
        n = tile["n"][rows[part]]
        first = np.cumsum(n) - n
        values = tile["hashes"][np.arange(n.sum()) + np.repeat(tile["first"][rows[part]] - first, n)]
        at = np.minimum(np.searchsorted(own, values), len(own) - 1)
        out[part] = np.add.reduceat(own[at] == values, first, dtype=np.int64)
    return out


def near_forest(a: dict, b: dict, same: bool, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links of a spanning forest over all pairs of near copies: candidates whose sets have the similarity.

    Of the candidates of a row those are counted that are not connected with it
    yet, first the closest one of each tree.
    """
    off = 0 if same else len(a["n"])
    label = np.arange(off + len(b["n"]))
    src, dst = [], []
    for i, j, far in _alike(a, b, same, radius):
        cuts = np.flatnonzero(np.diff(i)) + 1
        for row, js, d in zip(i[np.r_[0, cuts]] if len(i) else [], np.split(j, cuts), np.split(far, cuts), strict=False):
            own = a["hashes"][a["first"][row] : a["first"][row] + a["n"][row]]
            for turn in range(2):
                apart = label[js + off] != label[row]
                js, d = js[apart], d[apart]
                if not len(js):
                    break
                tried = js
                if turn == 0:
                    order = np.argsort(d, kind="stable")
                    tried = js[order][np.unique(label[js[order] + off], return_index=True)[1]]
                near = tried[_common(own, b, tried) * 9 >= (a["n"][row] + b["n"][tried]) * SIMILARITY_9THS]
                if len(near):
                    trees, one = np.unique(label[near + off], return_index=True)
                    src.append(np.full(len(one), a["id"][row]))
                    dst.append(b["id"][near[one]])
                    trees = np.append(trees, label[row])
                    label[np.isin(label, trees)] = trees.min()
    none = [np.zeros(0, np.int64)]
    return np.concatenate(none + src), np.concatenate(none + dst)


_TILES = ["pop", "to", "a_slice", "b_slice"]
_WORDS = [f"w{k}" for k in range(WIDE_BITS // 64)]


def _row(*more: str) -> Column:
    return F.struct("id", "n", *[F.get("fp", F.lit(k)).alias(w) for k, w in enumerate(_WORDS)], *more)


def _tile_pairs(distinct: DataFrame, size: int) -> DataFrame:
    """same, a and b: every two tiles that can hold near copies."""
    pop = F.bit_count(F.get("fp", F.lit(0)))
    counts = distinct.groupBy(pop.alias("pop")).agg(F.ceil(F.count("*") / F.lit(size)).alias("slices"))
    at = distinct.withColumn("pop", pop).join(F.broadcast(counts), "pop")  # 65 rows at most
    at = at.withColumn("slice", F.pmod(F.xxhash64("fp"), "slices").cast("int"))
    tiled = materialise(at.groupBy("pop", "slice").agg(F.collect_list(_row()).alias("rows")), "tiles")
    left = tiled.select(F.explode(F.sequence(F.col("pop"), F.least(F.col("pop") + FIRST_RADIUS, F.lit(64)))).alias("to"), "pop", F.col("slice").alias("a_slice"), F.col("rows").alias("a"))
    right = tiled.select(F.col("pop").alias("to"), F.col("slice").alias("b_slice"), F.col("rows").alias("b"))
    pairs = left.join(right, "to").where("pop <> to OR a_slice <= b_slice").repartition(*_TILES)
    return pairs.select(F.expr("pop = to AND a_slice = b_slice").alias("same"), "a", "b")


def _group_pairs(groups: DataFrame, slim: DataFrame, shingle: int, size: int) -> DataFrame:
    """same, a and b with the shingle hashes: every two tiles of a group of candidates. groups: g, id, key, n, fp."""
    slices = F.ceil(F.greatest(F.count("*") / F.lit(size), F.sum("n") / F.lit(TILE_HASHES))).cast("int")
    placed = groups.join(groups.groupBy("g").agg(F.greatest(slices, F.lit(1)).alias("slices")), "g").withColumn("slice", F.pmod(F.xxhash64("key"), "slices").cast("int"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                values = shingle_set(text.as_py(), shingle)
                yield pa.RecordBatch.from_arrays([pa.array([doc], pa.int64()), pa.array([_set_key(values)[1]], pa.int64()), pa.array([values.view(np.int64)], pa.list_(pa.int64()))], ["id", "key", "hashes"])

    texts = slim.join(groups.select(F.col("id").alias("doc_id")).distinct(), "doc_id", "left_semi").select("doc_id", "text")
    sets = texts.mapInArrow(run, "id long, key long, hashes array<long>").join(placed, ["id", "key"]).dropDuplicates(["id", "key"])
    tiled = materialise(sets.groupBy("g", "slices", "slice").agg(F.collect_list(_row("hashes")).alias("rows")), "groups")
    own = tiled.select(F.lit(True).alias("same"), F.col("rows").alias("a"), F.lit(None).cast(tiled.schema["rows"].dataType).alias("b"))
    left = tiled.where("slices > 1").select("g", F.col("slice").alias("a_slice"), F.col("rows").alias("a"), F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("b_slice")).where("a_slice < b_slice")
    right = tiled.select("g", F.col("slice").alias("b_slice"), F.col("rows").alias("b"))
    across = left.join(right, ["g", "b_slice"]).repartition("g", "a_slice", "b_slice")
    return own.unionByName(across.select(F.lit(False).alias("same"), "a", "b"))


def _linked(pairs: DataFrame, forest, radius: int) -> DataFrame:
    """src and dst: the forests of all pairs of tiles."""

    def side(column: pa.Array, k: int) -> dict[str, np.ndarray]:
        v = column[k].values
        out = {"id": v.field("id").to_numpy(), "n": v.field("n").to_numpy()}
        out["w"] = np.stack([v.field(w).to_numpy() for w in _WORDS], axis=1).view(np.uint64)
        if "hashes" in [f.name for f in v.type]:
            lists = v.field("hashes")
            out |= {"first": lists.offsets.to_numpy()[:-1].astype(np.int64), "hashes": lists.values.to_numpy().view(np.uint64)}
        return out

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, same in enumerate(batch.column(0).to_pylist()):
                a = side(batch.column(1), k)
                src, dst = forest(a, a if same else side(batch.column(2), k), same, radius)
                if len(src):
                    yield pa.RecordBatch.from_arrays([pa.array(src), pa.array(dst)], ["src", "dst"])

    return pairs.mapInArrow(compare, "src long, dst long")


def near_copies(docs: DataFrame, shingle: int = 5, radius: int = WIDE_RADIUS, size: int = WIDE_TILE) -> DataFrame:
    """doc_id and component_id of every row with an id: components of near copies, named by their smallest doc_id.

    Near copies have sets of five-word shingles with a Jaccard similarity of at
    least 0.8, counted over all shingles of both. Fingerprints only find the
    candidates: a similarity of 0.8 differs in about 39 of 256 bits with a spread
    of 6 (48 where a text has five shingles), unrelated texts in 128. Tiles are
    cut by the population count of the first 64 bits and meet within FIRST_RADIUS.

    Equal sets are one row. Candidates make groups by spanning forests; inside a
    group its texts' whole sets meet, tile by tile, and each two tiles give a
    spanning forest of the near copies among them. No task gives out all pairs.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(t.as_py(), shingle) for t in batch.column(1)]
            keys = [_set_key(s) for s in sets]
            cols = [batch.column(0), pa.array([k[0] for k in keys], pa.binary()), pa.array([k[1] for k in keys], pa.int64())]
            cols += [pa.array([len(s) for s in sets], pa.int64()), pa.array([wide_fingerprint(s) for s in sets], pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "sig", "key", "n", "fp"])

    slim = docs.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    made = materialise(slim.mapInArrow(run, "doc_id long, sig binary, key long, n long, fp array<long>"), "wide")
    distinct = materialise(made.groupBy("sig", "key", "n", "fp").agg(F.min("doc_id").alias("id")), "distinct")

    groups = components(_linked(_tile_pairs(distinct, size), candidate_forest, radius))
    least = groups.select(F.col("root").alias("node"), "root").distinct()  # the roots themselves
    grouped = distinct.join(groups.union(least), distinct["id"] == F.col("node")).select(F.col("root").alias("g"), "id", "key", "n", "fp")
    roots = components(_linked(_group_pairs(materialise(grouped, "grouped"), slim, shingle, -(-size // 4)), near_forest, radius))
    named = distinct.join(roots, distinct["id"] == roots["node"], "left").select("sig", F.coalesce("root", "id").alias("component_id"))
    return made.join(named, "sig").select("doc_id", "component_id")


def keep_first(docs: DataFrame) -> DataFrame:
    """The documents without those whose group of near copies has a smaller doc_id; columns as they come. Rows without an id stay.

    Of rows that share a doc_id all stay or go.
    """
    found = near_copies(docs).where("doc_id <> component_id").select("doc_id").distinct()
    return docs.join(found, "doc_id", "left_anti").select(*docs.columns)
