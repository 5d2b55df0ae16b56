"""Filter interaction audit: what each filter removes in every order of the filters.

Each document gets a bit mask of the filters that it fails. The masks are crossed
with a broadcast table of all orders of the filters (120 for five, whatever the
number of documents), which gives the step of each document's first failure; the
order's steps are exploded and counted by conditional sums, which Spark combines
in the tasks before it shuffles: a task passes on a row for each part, order and
step at most. A row is a mask, a part and two flags; no text takes part.

The fifth filter fails a text that also stands under a smaller doc_id. The smallest
doc_id of a text's SHA-256 comes from sums combined in the tasks; documents meet it
by digest and doc_id together, so that copies of one text, however many, lie apart.

Defined results: a null text is empty (fails only the word count, and the copy
filter if a smaller doc_id's text is empty or null); a null source is the part ''; a
row with a null doc_id neither is a copy nor has copies, and is neither good nor
toxic; rows that share doc_id and text are no copies of each other, each counts;
several labels of a doc_id count if one of them says 1; an empty table gives no
rows; extra columns are ignored.
"""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronolane.llm.common import materialise, partitions, table, words

FILTERS = "ABCDE"
#: Least words, least distinct words of a hundred, most capitals of a hundred characters.
LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS = 50, 65, 5


def own_failures(text: Column) -> dict[str, Column]:
    """Whether a text fails each filter that looks at nothing else."""
    found = words(text)
    n = F.size(found)
    return {
        "A": n < LEAST_WORDS,
        "B": 100 * F.size(F.array_distinct(found)) < LEAST_DISTINCT * n,
        "C": 100 * F.regexp_count(text, F.lit("[A-Z]")) > MOST_CAPITALS * F.length(text),
        "D": text.rlike(r"[#$%&*|]"),
    }


def failures(docs: DataFrame) -> DataFrame:
    """part, doc_id and failed of every row: the mask of the filters that it fails, A the lowest bit."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    bits = [F.when(fails, F.lit(1 << FILTERS.index(k))).otherwise(F.lit(0)) for k, fails in own_failures(F.col("t")).items()]
    slim = docs.select(F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"), "doc_id", text.alias("t"))
    mask = bits[0]
    for b in bits[1:]:
        mask = mask.bitwiseOR(b)
    made = materialise(slim.select("part", "doc_id", F.unhex(F.sha2(F.col("t").cast("binary"), 256)).alias("digest"), mask.alias("failed")), "failures")
    first = made.where(F.col("doc_id").isNotNull()).groupBy("digest").agg(F.min("doc_id").alias("doc_id")).withColumn("first", F.lit(True))
    copy = F.col("doc_id").isNotNull() & F.col("first").isNull()
    last = F.when(copy, F.lit(1 << FILTERS.index("E"))).otherwise(F.lit(0))
    return made.join(first, ["digest", "doc_id"], "left").select("part", "doc_id", F.col("failed").bitwiseOR(last).alias("failed"))


def with_labels(failed: DataFrame, labels: DataFrame) -> DataFrame:
    """Adds good and toxic, 0 or 1: whether a label of the row's doc_id says so."""
    says = lambda c: F.max(F.when(F.col(c) == 1, 1).otherwise(0)).alias("good" if c == "quality" else c)
    known = labels.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(says("quality"), says("toxic"))
    return failed.join(known, "doc_id", "left").select("part", "failed", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("good", "toxic")])


def replay(rows: DataFrame, filters: str = FILTERS) -> DataFrame:
    """The counts of every part, order and step. rows: part, failed (a mask), good and toxic (0 or 1)."""
    spark = rows.sparkSession
    made = [("".join(filters[i] for i in p), [1 << i for i in p]) for p in itertools.permutations(range(len(filters)))]
    orders = spark.createDataFrame(made, "filter_order string, bits array<int>")
    fails = lambda k: F.col("failed").bitwiseAND(F.get("bits", F.lit(k))) != 0
    first = F.coalesce(*[F.when(fails(k), F.lit(k + 1)) for k in range(len(filters))], F.lit(len(filters) + 1))
    # dealt again: the rows are small, what they make is not
    crossed = rows.repartition(partitions(spark)).crossJoin(F.broadcast(orders)).withColumn("first", first)
    steps = crossed.select("part", "failed", "good", "toxic", "filter_order", "first", F.posexplode("bits").alias("before", "bit"))
    step = F.col("before") + 1
    counted = lambda test, name: F.sum(F.when(test, F.lit(1)).otherwise(F.lit(0)).cast("long")).alias(name)
    here, own = F.col("first") == step, F.col("failed").bitwiseAND(F.col("bit")) != 0
    counts = steps.groupBy("part", "filter_order", step.alias("step"), "bit").agg(
        counted(F.col("first") > step, "kept"),
        counted(here, "removed"),
        counted(own & (F.col("first") < step), "redundant"),
        counted(F.col("failed") == F.col("bit"), "unique_fails"),
        counted(here & (F.col("good") == 1), "good_lost"),
        counted(here & (F.col("toxic") == 1), "toxic_lost"),
    )
    counts = materialise(counts, "replay")  # a row for each part, order and step
    shares = counts.groupBy("part", "bit").agg(F.sum("removed").alias("shapley"))
    return counts.join(shares, ["part", "bit"]).drop("bit")


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley of the five filters."""
    return replay(with_labels(failures(docs), labels))


def op13_filter_audit(spark, sf_dir: str) -> DataFrame:
    """All orders of the five filters over all documents."""
    return audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


_WORD = r"[^\x20\x09-\x0D]+"
ORACLE_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '{_WORD}') AS ws, min(doc_id) OVER (PARTITION BY t) AS first FROM d),
f AS (SELECT rid, doc_id, part, [
  len(ws) < {LEAST_WORDS}, 100 * len(list_distinct(ws)) < {LEAST_DISTINCT} * len(ws),
  100 * len(regexp_extract_all(t, '[A-Z]')) > {MOST_CAPITALS} * length(t), regexp_matches(t, '[#$%&*|]'), coalesce(first < doc_id, false)] AS fails FROM w),
l AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
x AS (SELECT f.*, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic FROM f LEFT JOIN l USING (doc_id)),
k AS (SELECT unnest(range(1, 6)) AS i),
o AS (SELECT [a.i, b.i, c.i, d.i, e.i] AS seq FROM k a, k b, k c, k d, k e WHERE len(list_distinct([a.i, b.i, c.i, d.i, e.i])) = 5),
r AS (SELECT x.*, seq, coalesce(list_position(list_transform(seq, lambda i: fails[i]), true), 6) AS first FROM x, o),
s AS (SELECT part, array_to_string(list_transform(seq, lambda i: '{FILTERS}'[i]), '') AS filter_order, i AS step, seq[i] AS own,
  count(*) FILTER (first > i) AS kept, count(*) FILTER (first = i) AS removed, count(*) FILTER (fails[seq[i]] AND first < i) AS redundant,
  count(*) FILTER (fails[seq[i]] AND len(list_filter(fails, lambda y: y)) = 1) AS unique_fails,
  count(*) FILTER (first = i AND good) AS good_lost, count(*) FILTER (first = i AND toxic) AS toxic_lost FROM r, k GROUP BY ALL)
SELECT part, filter_order, step::INT AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
  (sum(removed) OVER (PARTITION BY part, own))::BIGINT AS shapley FROM s"""
