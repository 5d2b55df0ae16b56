"""Spelling variant grouping over a forward and a reversed sorted dictionary.

Words are runs of letters, lower-cased, counted over all texts with combining in
the tasks; those long and frequent enough are the dictionary. It is ranged over the
partitions and sorted, and a word's number is its place in that order, so that of
two numbers the smaller has the smaller word.

One edit leaves a half intact. A class holds the words of n code points and those of
n + 1; two near words of a class share the first n // 2 code points or the last
n - n // 2. Blocks of a shared prefix are runs in the dictionary sorted forwards,
blocks of a shared suffix runs in the reversed one. A task gets whole blocks, sorted,
and scans them one at a time; of a word only what lies between the shared ends
travels, with a digest (SHA-256) of the shared ends as the block's name.

A block of over BLOCK words, or of over BLOCK_CHARS code points, is subdivided: the
edit lies between the shared ends, and there again one half is intact, so the block
becomes one with a longer prefix and one with a longer suffix. Each round halves
what lies between, until that is one code point: then a block has no more words
than letters (90) and pairs of letters. A pair that shares both halves would be met
twice; `first` says before which code point the middles of a pair must begin to
differ in this block, so that every pair is met once.

In a block each two words are verified: equal lengths with one place that differs,
or one code point too many. A task passes on one row for each word of a block that
has near words: how many, and the best.

Forms double the count at each step, so that chains are short (63 steps at most).
Roots come by doubling: each round a word takes its form's root so far.

Defined results: null and empty texts have no words; a null doc_id counts as the
empty text in the checksum; rows that are repeated count again; of near words with
equal counts the smallest in code-point order is the form; an empty table gives no
rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronolane.llm.common import crc32_sql, materialise, partitions, table

#: What words are made of, which of them lose a code point, and which count.
RUN = r"[A-Za-zÀ-ÿ]+"
DROP_EVERY, LEAST_LENGTH, LEAST_COUNT = 97, 5, 3
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Words, and code points between the shared ends, from which on a block is subdivided.
BLOCK, BLOCK_CHARS = 512, 1 << 22


def words(docs: DataFrame) -> DataFrame:
    """word: each run of each text, lower-cased, those whose checksum with the doc_id says so without one code point."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    runs = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), F.explode(F.regexp_extract_all(text, F.lit(RUN), F.lit(0))).alias("run"))
    runs = runs.withColumn("run", F.when(F.col("run").rlike("[A-Z]"), F.translate("run", UPPER, LOWER)).otherwise(F.col("run")))
    runs = runs.select("run", F.crc32(F.concat_ws(":", "id", "run").cast("binary")).alias("h"))
    at = (F.col("h") % F.length("run")).cast("int")
    without = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
    return runs.select(F.when(F.col("h") % DROP_EVERY == 0, without).otherwise(F.col("run")).alias("word"))


def dictionary(found: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT) -> DataFrame:
    """id, word, n: the words that are long and frequent enough, numbered in code-point order (not gapless)."""
    counts = found.where(F.length("word") >= least_length).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least_count)
    sorted_ = materialise(counts, "counts").repartitionByRange(partitions(found.sparkSession), "word").sortWithinPartitions("word")
    return materialise(sorted_.select(F.monotonically_increasing_id().alias("id"), "word", "n"), "dictionary")


def _block(word: Column, head: Column, tail: Column, n: Column) -> Column:
    """The digest of the class and the shared ends."""
    ends = F.concat_ws("\x00", n.cast("string"), F.substring(word, F.lit(1), head), F.substring(word, F.length(word) - tail + 1, tail))
    return F.unhex(F.sha2(ends.cast("binary"), 256))


def _halves(words_: DataFrame) -> DataFrame:
    """word, id, n, size (of the class), head, tail, first: each word in both classes that it may meet others in, by its first and by its last half."""
    length = F.length("word")
    out = words_.select("word", "id", "n", F.explode(F.array(length, length - 1)).alias("size")).where("size > 0")
    half = F.floor(F.col("size") / 2).cast("int")
    forward = F.struct(half.alias("head"), F.lit(0).alias("tail"), (F.col("size") + 2).alias("first"))
    # pairs that differ at or after the half are the forward block's
    reverse = F.struct(F.lit(0).alias("head"), (F.col("size") - half).alias("tail"), half.alias("first"))
    return out.select("*", F.explode(F.array(forward, reverse)).alias("e")).select("word", "id", "n", "size", "e.*").where("first > 0")


def _subdivided(rows: DataFrame) -> DataFrame:
    """The rows of blocks that are too large, by the halves of what lies between their shared ends."""
    between = F.col("size") - F.col("head") - F.col("tail")
    half = F.floor(between / 2).cast("int")
    left = F.struct((F.col("head") + half).alias("head"), F.col("tail").alias("tail"), (F.col("first") - half).alias("first"))
    right = F.struct(F.col("head").alias("head"), (F.col("tail") + between - half).alias("tail"), F.least(F.col("first"), half).alias("first"))
    return rows.select("word", "id", "n", "size", F.explode(F.array(left, right)).alias("e")).select("word", "id", "n", "size", "e.*").where("first > 0")


def blocks(words_: DataFrame, most: int = BLOCK, chars: int = BLOCK_CHARS) -> DataFrame:
    """block, first, short (whether of the class's own length), id, n, middle: the words of all blocks."""
    rows, done = _halves(words_), []
    while True:
        between = F.col("size") - F.col("head") - F.col("tail")
        named = materialise(rows.withColumn("block", _block(F.col("word"), F.col("head"), F.col("tail"), F.col("size"))), "blocks")
        large = named.groupBy("block", "first", "head", "tail", "size").agg(F.count("*").alias("c")).where(between > 1)
        large = materialise(large.where(F.col("c") > F.least(F.lit(most), F.ceil(F.lit(chars) / between))).select("block", "first"), "large")
        middle = F.substring("word", F.col("head") + 1, F.length("word") - F.col("head") - F.col("tail"))
        small = named.join(large, ["block", "first"], "left_anti")
        done.append(small.select("block", "first", (F.length("word") == F.col("size")).alias("short"), "id", "n", middle.alias("middle")))
        if large.isEmpty():
            break
        rows = _subdivided(named.join(large, ["block", "first"], "left_semi"))
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out


def _letters(middles: list[str], width: int) -> np.ndarray:
    """Code points, a row for each of the middles of one length."""
    return np.frombuffer("".join(middles).encode("utf-32-le"), np.uint32).reshape(len(middles), width)


def _pairs(first: int, short: list[str], long: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, bool]]:
    """Places of near words of a block: of two short ones, or (True) of a short and a long one."""
    width = len(short[0])
    a = _letters(short, width)
    for i in range(len(a) - 1):
        differ = a[i + 1 :] != a[i]
        near = np.flatnonzero(differ.sum(axis=1) == 1)
        near = near[differ[near].argmax(axis=1) < first] if len(near) else near
        yield np.full(len(near), i), near + i + 1, False
    if not long:
        return
    b = _letters(long, width + 1)
    for i in range(len(a)):
        # one code point too many: what agrees from the left and from the right covers the short one
        same = np.zeros((len(b), width + 1), bool)
        same[:, :width] = b[:, :width] == a[i]
        left = (~same).argmax(axis=1)  # the last column never agrees
        back = np.zeros((len(b), width + 1), bool)
        back[:, :width] = (b[:, 1:] == a[i])[:, ::-1]
        near = np.flatnonzero((left + (~back).argmax(axis=1) >= width) & (left < first))
        yield np.full(len(near), i), near, True


def _scanned(block: list[tuple[bool, int, int, str]], first: int) -> Iterator[tuple[int, int, int, int]]:
    """id, near words, and n and id of the best of them, of the words of one block."""
    short, long = [r for r in block if r[0]], [r for r in block if not r[0]]
    if not short or len(block) < 2:
        return
    ids = np.array([r[1] for r in short + long], np.int64)
    counts = np.array([r[2] for r in short + long], np.int64)
    found = [(i, j + len(short) * across) for i, j, across in _pairs(first, [r[3] for r in short], [r[3] for r in long]) if len(i)]
    if not found:
        return
    i, j = (np.concatenate([p[k] for p in found]) for k in (0, 1))
    here, there = np.concatenate([i, j]), np.concatenate([j, i])
    order = np.lexsort((ids[there], -counts[there], here))
    here, there = here[order], there[order]
    starts = np.flatnonzero(np.r_[True, here[1:] != here[:-1]])
    yield from zip(ids[here[starts]].tolist(), np.diff(np.r_[starts, len(here)]).tolist(), counts[there[starts]].tolist(), ids[there[starts]].tolist(), strict=True)


def near_words(rows: DataFrame) -> DataFrame:
    """id, n_near, best (n and id of the near word of largest n) of every word of the dictionary that has near words."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made(found: list[tuple[int, int, int, int]]) -> pa.RecordBatch:
            columns = list(zip(*found, strict=True)) or [[]] * 4
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["id", "near", "best_n", "best_id"])

        name, held = None, []
        for batch in batches:
            found = []
            for block, first, short, i, n, middle in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if (block, first) != name:
                    found += _scanned(held, name[1]) if name else []
                    name, held = (block, first), []
                held.append((short, i, n, middle))
            yield made(found)
        if name:
            yield made(list(_scanned(held, name[1])))

    n = partitions(rows.sparkSession)
    dealt = rows.repartition(n, "block", "first").sortWithinPartitions("block", "first", "middle").select("block", "first", "short", "id", "n", "middle")
    each = dealt.mapInArrow(scan, "id long, near long, best_n long, best_id long")
    best = F.max_by(F.struct("best_n", "best_id"), F.struct("best_n", -F.col("best_id")))
    return each.groupBy("id").agg(F.sum("near").alias("n_near"), best.alias("best"))


def roots(forms: DataFrame) -> DataFrame:
    """id, root: where the forms of each id lead. forms: id, form, without cycles."""
    reached, moved = materialise(forms.select("id", F.col("form").alias("root"), F.lit(True).alias("on")), "roots"), True
    while moved:
        ahead = reached.select(F.col("id").alias("root"), F.col("root").alias("further"))
        step = reached.where("on").join(ahead, "root", "left")
        step = step.select("id", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("on"))
        reached = materialise(step.unionByName(reached.where("NOT on")), "roots")
        moved = not reached.where("on").isEmpty()
    return reached.select("id", "root")


def grouped(known: DataFrame, most: int = BLOCK, chars: int = BLOCK_CHARS) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word. known: id (in the words' order), word, n."""
    near = materialise(near_words(blocks(known, most, chars)), "near")
    met = known.select("id", "n").join(near, "id", "left")
    formed = F.when(F.col("best.best_n") >= 2 * F.col("n"), F.col("best"))
    met = materialise(met.select("id", F.coalesce("n_near", F.lit(0)).alias("n_near"), formed.alias("form")), "forms")
    ends = roots(met.where("form IS NOT NULL").select("id", F.col("form.best_id").alias("form")))
    named = lambda c: known.select(F.col("id").alias(f"{c}_id"), F.col("word").alias(c))
    out = known.join(met, "id").join(ends.withColumnRenamed("root", "root_id"), "id", "left")
    out = out.select("word", "n", "n_near", F.col("form.best_n").alias("form_n"), F.col("form.best_id").alias("form_id"), "root_id")
    out = out.join(named("form"), "form_id", "left").join(named("root"), "root_id", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op12_spelling_variants(spark, sf_dir: str) -> DataFrame:
    """Every frequent word of all documents with its form and root."""
    return grouped(dictionary(words(table(spark, sf_dir, "documents"))))


_LOWER = f"translate(r, '{UPPER}', '{LOWER}')"
ORACLE_SQL = f"""
WITH RECURSIVE runs AS (SELECT coalesce(doc_id::VARCHAR, '') AS id, unnest(regexp_extract_all(coalesce(text, ''), '{RUN}')) AS r FROM documents),
c AS (SELECT id, {_LOWER} AS w, count(*) AS c FROM runs GROUP BY ALL),
h AS (SELECT w, c, {crc32_sql("id || ':' || w")} AS h FROM c),
v AS (SELECT CASE WHEN h % {DROP_EVERY} = 0 THEN substr(w, 1, h % length(w)) || substr(w, h % length(w) + 2) ELSE w END AS word, c FROM h),
k AS (SELECT word, sum(c)::BIGINT AS n FROM v WHERE length(word) >= {LEAST_LENGTH} GROUP BY word HAVING sum(c) >= {LEAST_COUNT}),
p AS (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM k),
q AS (SELECT word, n, substr(word, 1, i - 1) AS a, substr(word, i + 1) AS b FROM p),
near AS (SELECT x.word, y.word AS other, y.n AS other_n FROM q x JOIN q y USING (a, b) WHERE x.word <> y.word
  UNION SELECT q.word, k.word, k.n FROM q JOIN k ON q.a || q.b = k.word
  UNION SELECT k.word, q.word, q.n FROM q JOIN k ON q.a || q.b = k.word),
best AS (SELECT word, count(*) AS n_near, first(other ORDER BY other_n DESC, other) AS other, max(other_n) AS other_n FROM near GROUP BY word),
f AS (SELECT k.word, k.n, coalesce(n_near, 0) AS n_near, CASE WHEN other_n >= 2 * k.n THEN other END AS form, CASE WHEN other_n >= 2 * k.n THEN other_n END AS form_n FROM k LEFT JOIN best USING (word)),
r AS (SELECT word, form AS root, 1 AS step FROM f WHERE form IS NOT NULL UNION ALL SELECT r.word, f.form, step + 1 FROM r JOIN f ON f.word = r.root WHERE f.form IS NOT NULL),
e AS (SELECT word, max_by(root, step) AS root FROM r GROUP BY word)
SELECT f.word, form, coalesce(root, f.word) AS root, n, n_near, form_n FROM f LEFT JOIN e USING (word)"""
