"""Document fingerprints: one-permutation MinHash with optimal densification, in DataFrame functions only.

Every word shingle of a whole text is hashed once. The hash's low bits choose
one of BINS bins, the rest compete there for the minimum. An empty bin takes the
minimum of the first full bin on a list of its own, the same for all texts:
PROBES bins by fixed steps, then all bins by a hash of both numbers. Of each
bin's minimum, shifted by a number of places that depends on the bin, the BITS
lowest bits are packed, eight bins to a long.

The likeness of two fingerprints is the share m of equal bins, corrected for
bins that agree by chance: (m - c) / (1 - c) with c = 2 ** -BITS, from 0 to 1.

Everything about one text happens in its row; only the search for the next
document moves texts, by ranges of doc_id (`with_next`).

Defined results: a null text counts as empty; a text with fewer words than a
shingle has one, all its words (of none, the empty one); equal texts have equal
fingerprints and the likeness 1; a null doc_id comes last in descending order,
rows that share a doc_id follow each other by text; repeated rows are each
returned; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronolane.llm.common import partitions, table, words

SHINGLE, BINS, BITS, PROBES = 5, 256, 8, 6
STRETCHES = 64
_HIGH = 48  # bits of a hash that compete within a bin
_NO_ID = -(2**63)


def _shingles(hashes: Column) -> Column:
    n = F.size(hashes)
    run = F.transform(hashes, lambda x, i: F.xxhash64(x, *[F.get(hashes, i + k) for k in range(1, SHINGLE)]))
    return F.when(n >= SHINGLE, F.slice(run, 1, F.greatest(n - (SHINGLE - 1), F.lit(1)))).otherwise(F.array(F.xxhash64(hashes)))


def with_fingerprint(docs: DataFrame, text: str, name: str) -> DataFrame:
    """Adds `name`: the fingerprint of the column `text`, an array of longs. All other columns stay (as one struct meanwhile, so that none can clash).

    Arrays that a later lambda reads are columns of their own and are read more
    than once, so that they are worked out once for each row.
    """
    kept = ["row"]
    out = docs.select(F.struct(*[c for c in docs.columns if c.lower() != name.lower()]).alias("row"), F.transform(words(F.col(text)), lambda w: F.xxhash64(w)).alias("_h"))
    split = lambda h: F.shiftleft(h.bitwiseAND(F.lit(BINS - 1).cast("long")), _HIGH).bitwiseOR(F.shiftrightunsigned(h, 64 - _HIGH))
    out = out.select(*kept, F.sort_array(F.transform(_shingles(F.col("_h")), split)).alias("_s"))
    s = F.col("_s")
    bin_of = lambda x: F.shiftrightunsigned(x, _HIGH)
    firsts = F.filter(s, lambda x, i: (i == 0) | (bin_of(x) != bin_of(F.get(s, i - 1))))
    out = out.select(*kept, firsts.alias("_f"))
    f = F.col("_f")
    full = F.map_from_arrays(F.transform(f, lambda x: bin_of(x).cast("int")), f)
    out = out.select(*kept, "_f", full.alias("_m"))
    out = out.select(*kept, "_f", F.when(F.size("_m") > 0, F.transform(F.sequence(F.lit(0), F.lit(BINS - 1)), lambda j: F.element_at("_m", j))).alias("_b"))
    out = out.withColumn("_raw", F.col("_b"))
    for t in range(PROBES):
        out = out.withColumn("_b", F.when(F.size("_f") < BINS, F.transform("_b", _probe(t))).otherwise(F.col("_b")))
    last = lambda v, j: F.coalesce(v, F.array_min(F.transform("_f", lambda x: F.struct(F.xxhash64(j, bin_of(x)).alias("o"), x.alias("x"))))["x"])
    out = out.withColumn("_b", F.when((F.size("_f") < BINS) & F.exists("_b", lambda v: v.isNull()), F.transform("_b", last)).otherwise(F.col("_b")))
    # one value may fill many bins: each bin shows other bits of it, or short texts would differ in BITS bits only
    turned = F.transform("_b", lambda v, j: F.call_function("shiftrightunsigned", v, j % (_HIGH - BITS)))
    out = out.withColumn("_b", F.when(F.size("_b") > 0, turned))
    low = F.lit((1 << BITS) - 1).cast("long")
    each = 64 // BITS
    pack = lambda g: F.aggregate(F.slice("_b", g * each + 1, each), F.lit(0).cast("long"), lambda a, v: F.shiftleft(a, BITS).bitwiseOR(v.bitwiseAND(low)))
    packed = F.transform(F.sequence(F.lit(0), F.lit(BINS // each - 1)), pack)
    return out.select("row.*", F.when(F.size("_b") > 0, packed).alias(name))


def _probe(t: int):
    """The t-th bin on the list of bin j: an odd multiple of j, moved on."""
    a, b = 2 * (37 * t + 11) + 1, 101 * t + 53
    return lambda v, j: F.coalesce(v, F.get("_raw", (j * a + b) % BINS))


def likeness(a: Column, b: Column) -> Column:
    """The corrected share of equal bins of two fingerprints."""
    ones = F.lit(sum(1 << (BITS * k) for k in range(64 // BITS))).cast("long")

    def apart(x: Column, y: Column) -> Column:
        z = x.bitwiseXOR(y)
        for k in (1, 2, 4):
            z = z.bitwiseOR(F.shiftrightunsigned(z, k))
        return F.bit_count(z.bitwiseAND(ones))

    differ = F.aggregate(F.zip_with(a, b, apart), F.lit(0), lambda x, y: x + y)
    chance = 2.0**-BITS
    return F.greatest(F.lit(0.0), (F.lit(1.0) - differ / BINS - chance) / (1 - chance))


def as_text(fingerprint: Column) -> Column:
    return F.array_join(F.transform(fingerprint, lambda x: F.lpad(F.lower(F.hex(x)), 16, "0")), "")


def _ranges(docs: DataFrame, parts: int) -> tuple[DataFrame, int]:
    """stretch, from, cuts: where STRETCHES ranges of doc_id begin, and the ids that cut each into ranges of as many rows; and the ranges of one.

    Quantiles of quantiles: however the ids lie, a range holds about as many rows
    as another, but for those that share one id.
    """
    spark = docs.sparkSession
    at = docs.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("id"))
    heads = at.select(F.percentile_approx("id", [k / STRETCHES for k in range(STRETCHES)], 10_000).alias("q")).first()["q"] or [0]
    heads = sorted(set(heads))
    per = max(1, -(-parts // len(heads)))
    stretch = _place(F.array(*map(F.lit, heads)), F.col("id"))
    cuts = at.groupBy(stretch.alias("stretch")).agg(F.array_distinct(F.percentile_approx("id", [k / per for k in range(per)], 100 * per)).alias("cuts"))
    found = {r["stretch"]: r["cuts"] for r in cuts.collect()}  # a number for each range
    return spark.createDataFrame([(k, h, found.get(k, [h])) for k, h in enumerate(heads)], "stretch int, head long, cuts array<long>"), per


def _place(cuts: Column, value: Column) -> Column:
    """The number of the last cut at or below a value; 0 before the first."""
    return F.greatest(F.size(F.filter(cuts, lambda c: c <= value)) - 1, F.lit(0))


def with_next(docs: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Adds columns of the next row by descending doc_id (after the last: the first); columns: new name by old.

    Rows are dealt to ranges of doc_id of about equal counts. In a range a window
    looks one row ahead; its last row looks at a copy of the first row of the next
    range. So no task sees more than a range and the copies.
    """
    spark = docs.sparkSession
    held = docs.select(F.struct(*docs.columns).alias("row"), F.coalesce(F.col("doc_id").cast("long"), F.lit(_NO_ID)).alias("o"), F.col("text").alias("t"))
    ranges, per = _ranges(docs, 4 * partitions(spark))
    starts = F.array(*[F.lit(r["head"]) for r in ranges.select("head").orderBy("stretch").collect()])
    cut = ranges.select("stretch", "cuts")  # STRETCHES rows at most
    put = held.withColumn("stretch", _place(starts, F.col("o"))).join(F.broadcast(cut), "stretch")
    at = F.when(F.col("o") == _NO_ID, F.lit(-1)).otherwise(F.col("stretch") * per + _place(F.col("cuts"), F.col("o")))
    put = put.withColumn("p", at.cast("long")).drop("stretch", "cuts")
    # a row for each range
    heads = put.groupBy("p").agg(F.max("o").alias("o")).orderBy("p").collect()
    targets = spark.createDataFrame([(r["o"], heads[(i + 1) % len(heads)]["p"]) for i, r in enumerate(heads)], "o long, to long")
    copies = put.join(F.broadcast(targets), "o").select("row", "o", "t", F.col("to").alias("p"), F.lit(1).alias("copy"))
    w = Window.partitionBy("p").orderBy("copy", F.col("o").desc(), "t")
    out = put.withColumn("copy", F.lit(0)).unionByName(copies)
    made = F.struct(*[F.lead(F.col("row")[old]).over(w).alias(new) for new, old in columns.items()])
    new = {c.lower() for c in columns}
    kept = [F.col("row")[c].alias(c) for c in docs.columns if c.lower() not in new]
    return out.select("row", "copy", made.alias("made")).where("copy = 0").select(*kept, *[F.col("made")[c].alias(c) for c in columns])


def op3_document_fingerprints(spark, sf_dir: str) -> DataFrame:
    """Every document's fingerprint, that of its edited text, and their likenesses."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    out = with_next(with_fingerprint(docs, "text", "fp"), {"_next": "text", "next_fp": "fp"})
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.left("text", n - half), F.left("_next", half))
    out = out.select("doc_id", n.cast("long").alias("n_chars"), edited.alias("edited"), "fp", "next_fp")
    out = with_fingerprint(out, "edited", "edited_fp")
    return out.select(
        "doc_id",
        "n_chars",
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        as_text(F.col("fp")).alias("fingerprint"),
        as_text(F.col("edited_fp")).alias("edited_fingerprint"),
        likeness(F.col("fp"), F.col("edited_fp")).alias("near_edited"),
        likeness(F.col("fp"), F.col("next_fp")).alias("near_next"),
    )
