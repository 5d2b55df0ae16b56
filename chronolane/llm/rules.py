"""Quality rules with adaptive thresholds, in DataFrame functions only.

Each whole text gets counts in one pass over its words. Measures made of them
(symbols and capitals for each word, repeated lines for each line with a word,
characters for each word) are taken to their square roots, which makes the
spread of a count much the same at any level, and sketched per language and
source: a sketch is a count for each of BINS bins of the width 1 / SCALE, so its
quantiles are right within a bin and sketches merge by adding counts, in any
order and with the same result.

A group's sketch is merged with PRIOR rows' worth of its language's, and that one
with PRIOR rows' worth of everything's: a small group leans on its parents, a
large one stands for itself, with no switch between. Each group sets its own fence
for each measure by where most of it lies: the median plus REACH times the range
from the lower quartile to the median. Neither moves much while junk, which lies
above, is well under half of a source; a source that is all code has its own level
and spread, and keeps its texts. Where most of a group has none of something, both
are 0; there the fence is the upper tenth of the group, of its language or of
everything, whichever is lowest, so that a source which is junk by a third does not
set its own fence. A document's own sampling error goes on top: NOISE over the root
of its words (or lines). Documents meet their group's fences by a join and are kept
below all of them.

What it cannot tell: a source with more junk than sound texts looks like one of
another kind, and of something that over a tenth of everything has, only what is
above that tenth's level is junk.

Defined results: a null text has no words, lines or symbols (and fails the base
rules, as texts under 20 words do); a null language or source counts as an empty
name; repeated rows are judged alike; an empty table gives no rows; extra
columns are carried by `judged` if named, but for those named as its results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronolane.llm.common import materialise, table, words

WINDOW = 8
#: Bins of the sketches, how many of them make up 1, and the number of rows whose weight a parent has.
BINS, SCALE, PRIOR = 10_000, 100, 50.0
REACH, NOISE, MOST = 8.0, 2.0, 0.9
MEASURES = ("symbols", "capitals", "repeated", "word_length")
RESULTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
_SALTS = 16


def repeated_words(hashes: Column, n: Column) -> tuple[Column, Column]:
    """From word hashes: the window hashes, and (from a column `windows` that holds them) the words in windows found twice or more."""
    run = F.transform(hashes, lambda x, i: F.xxhash64(x, *[F.get(hashes, i + k) for k in range(1, WINDOW)]))
    windows = F.when(n >= WINDOW, F.slice(run, 1, F.greatest(n - (WINDOW - 1), F.lit(1)))).otherwise(F.array().cast("array<bigint>"))
    return windows, F.size(F.array_distinct("windows")) < F.size("windows")


def counts(docs: DataFrame, carry: list[str]) -> DataFrame:
    """The carried columns with n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words and n_capitals."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    out = docs.select(*carry, text.alias("_text"), words(text).alias("_words"))
    lines = F.filter(F.split("_text", "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    out = out.select(
        *carry,
        F.size("_words").cast("long").alias("n_words"),
        F.length(F.array_join("_words", "")).cast("long").alias("word_chars"),
        F.regexp_count("_text", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        F.regexp_count("_text", F.lit(r"\p{Lu}")).cast("long").alias("n_capitals"),
        lines.alias("_lines"),
        F.transform("_words", lambda w: F.xxhash64(w)).alias("_hashes"),
    )
    kept = [*carry, "n_words", "word_chars", "n_symbols", "n_capitals"]
    windows, repeats = repeated_words(F.col("_hashes"), F.col("n_words").cast("int"))
    dup_lines = F.size("_lines") - F.size(F.array_distinct("_lines"))
    out = out.select(*kept, F.size("_lines").cast("long").alias("n_lines"), dup_lines.cast("long").alias("n_dup_lines"), windows.alias("windows"))
    kept += ["n_lines", "n_dup_lines"]
    # only texts with a repeated window sort their windows; equal hashes then stand side by side
    ordered = F.when(repeats, F.sort_array(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i")))))
    out = out.select(*kept, ordered.alias("_by_hash"))
    s = F.col("_by_hash")
    twice = F.filter(s, lambda x, k: (x["h"] == F.get(s, k - 1)["h"]) | (x["h"] == F.get(s, k + 1)["h"]))
    out = out.select(*kept, F.sort_array(F.transform(twice, lambda x: x["i"])).alias("_at"))
    at = F.col("_at")
    new = F.transform(at, lambda p, k: F.least(F.lit(WINDOW), F.coalesce(F.get(at, k + 1) - p, F.lit(WINDOW))))
    n_repeat = F.aggregate(new, F.lit(0).cast("long"), lambda a, x: a + x)
    return out.select(*kept, F.coalesce(n_repeat, F.lit(0)).alias("n_repeat_words"))


def measures() -> dict[str, tuple[Column, Column]]:
    """Each measure's square root, and what it counts by."""
    n, lines = F.greatest(F.col("n_words"), F.lit(1)), F.greatest(F.col("n_lines"), F.lit(1))
    made = zip(MEASURES, ("n_symbols", "n_capitals", "n_dup_lines", "word_chars"), (n, n, lines, n), strict=True)
    return {k: (F.sqrt(F.col(c) / by), by) for k, c, by in made}


def sketches(counted: DataFrame) -> DataFrame:
    """lang, source, measure, bin, w: how many documents of a group fall in each bin. The last bin is open."""
    pairs = F.array(*[F.struct(F.lit(k).alias("measure"), F.least(F.floor(v * SCALE), F.lit(BINS)).cast("int").alias("bin")) for k, (v, _) in measures().items()])
    each = counted.select("lang", "source", F.explode(pairs).alias("m"))
    return each.groupBy("lang", "source", "m.measure", "m.bin").agg(F.count("*").cast("double").alias("w"))


def _merged(own: DataFrame, keys: list[str], prior: DataFrame) -> DataFrame:
    """keys, measure, bin, w: own sketches with the prior's shares (keys, measure, bin, share) worth PRIOR rows."""
    added = prior.select(*keys, "measure", "bin", (F.col("share") * PRIOR).alias("w"))
    return own.select(*keys, "measure", "bin", "w").unionByName(added).groupBy(*keys, "measure", "bin").agg(F.sum("w").alias("w"))


def _shares(sketch: DataFrame, keys: list[str]) -> DataFrame:
    """Adds share and upto: a bin's share of its sketch's weight, and that of all bins up to it. A window holds one sketch: BINS rows at most."""
    group = Window.partitionBy(*keys, "measure")
    running = group.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    total = F.sum("w").over(group)
    return sketch.select(*keys, "measure", "bin", (F.col("w") / total).alias("share"), F.round(F.sum("w").over(running) / total, 9).alias("upto"))


def _quantiles(shares: DataFrame, keys: list[str], prefix: str, *names: str) -> DataFrame:
    """keys, measure, and of low, mid and top (the bins of the lower quartile, the median and the upper tenth) those named."""
    at = {"low": 0.25, "mid": 0.5, "top": MOST}
    return shares.groupBy(*keys, "measure").agg(*[F.min(F.when(F.col("upto") >= at[n], F.col("bin"))).alias(prefix + n) for n in names])


def fences(sketch: DataFrame) -> DataFrame:
    """lang, source and a fence for each measure, on the scale of the square roots."""
    salts = F.array(*map(F.lit, range(_SALTS)))
    sum_to = lambda *keys: sketch.groupBy(*keys, "measure", "bin").agg(F.sum("w").alias("w"))
    every = _shares(sum_to(), [])  # BINS + 1 rows for each measure at most
    by_lang = sum_to("lang")
    langs = by_lang.select("lang", "measure").distinct().join(F.broadcast(every), "measure")
    lang = _shares(_merged(by_lang, ["lang"], langs), ["lang"])
    # a language may hold any share of the groups: its sketch meets them in several places
    groups = sketch.select("lang", "source", "measure").distinct().withColumn("salt", F.pmod(F.hash("source"), F.lit(_SALTS)))
    parent = lang.withColumn("salt", F.explode(salts))
    own = _shares(_merged(sketch, ["lang", "source"], groups.join(parent, ["lang", "measure", "salt"])), ["lang", "source"])
    made = _quantiles(own, ["lang", "source"], "s_", "low", "mid", "top").join(_quantiles(lang, ["lang"], "l_", "top"), ["lang", "measure"])
    made = made.join(F.broadcast(_quantiles(every, [], "a_", "top")), "measure")
    level = F.greatest(F.col("s_mid") + REACH * (F.col("s_mid") - F.col("s_low")), F.least("s_top", "l_top", "a_top"))
    fence = (level + 1) / SCALE
    return made.groupBy("lang", "source").agg(*[F.max(F.when(F.col("measure") == m, fence)).alias(f"fence_{m}") for m in MEASURES])


def judged(docs: DataFrame, carry: list[str]) -> DataFrame:
    """The carried columns with the counts, base_failed and kept."""
    carry = [c for c in carry if c.lower() not in RESULTS]
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    slim = docs.select(F.struct(*carry).alias("carried"), name("lang"), name("source"), "text")
    counted = materialise(counts(slim, ["carried", "lang", "source"]), "counts")
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    out = counted.withColumn("base_failed", failed).join(fences(sketches(counted)), ["lang", "source"])
    below = ~F.col("base_failed")
    for m, (v, by) in measures().items():
        below = below & (v - NOISE / F.sqrt(by) <= F.col(f"fence_{m}"))
    return out.select(*[F.col("carried")[c].alias(c) for c in carry], *RESULTS[:-1], below.alias("kept"))


def op8_quality_rules(spark, sf_dir: str) -> DataFrame:
    """Every document's counts and verdicts."""
    return judged(table(spark, sf_dir, "documents"), ["doc_id"])


def _sql() -> str:
    """The same rows in DuckDB's SQL."""
    word, fence = r"[^\x20\x09-\x0D]+", f"(greatest(s_mid + {REACH} * (s_mid - s_low), least(s_top, l_top, a_top)) + 1) / {SCALE}"
    shares = lambda keys, source: f"""SELECT *, w / sum(w) OVER (PARTITION BY {keys}) AS share, round(sum(w) OVER (PARTITION BY {keys} ORDER BY bin) / sum(w) OVER (PARTITION BY {keys}), 9) AS upto FROM ({source})"""
    quantiles = lambda keys, source, p: f"SELECT {keys}, min(bin) FILTER (upto >= 0.25) AS {p}_low, min(bin) FILTER (upto >= 0.5) AS {p}_mid, min(bin) FILTER (upto >= {MOST}) AS {p}_top FROM {source} GROUP BY {keys}"
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '{word}') AS ws, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{word}')) AS ls FROM d),
words AS (SELECT rid, unnest(ws) AS word, generate_subscripts(ws, 1) AS pos FROM w),
places AS (SELECT rid, pos, {" || ' ' || ".join(["word", *(f"lead(word, {k}) OVER o" for k in range(1, WINDOW))])} AS run FROM words WINDOW o AS (PARTITION BY rid ORDER BY pos)),
win AS (SELECT rid, pos, count(*) OVER (PARTITION BY rid, run) AS n FROM places WHERE run IS NOT NULL),
rep AS (SELECT rid, count(DISTINCT p) AS n_repeat_words FROM (SELECT rid, unnest(range(pos, pos + {WINDOW})) AS p FROM win WHERE n > 1) GROUP BY rid),
c AS (SELECT rid, doc_id, lang, source, len(ws)::BIGINT AS n_words, coalesce(len(array_to_string(ws, '')), 0)::BIGINT AS word_chars,
  len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols, len(regexp_extract_all(t, '\\p{{Lu}}')) AS n_capitals, len(ls) AS n_lines,
  (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words FROM w LEFT JOIN rep USING (rid)),
f AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM c),
m AS (SELECT rid, lang, source, 'symbols' AS measure, sqrt(n_symbols / greatest(n_words, 1)) AS v, greatest(n_words, 1) AS by_n FROM f
  UNION ALL SELECT rid, lang, source, 'capitals', sqrt(n_capitals / greatest(n_words, 1)), greatest(n_words, 1) FROM f
  UNION ALL SELECT rid, lang, source, 'repeated', sqrt(n_dup_lines / greatest(n_lines, 1)), greatest(n_lines, 1) FROM f
  UNION ALL SELECT rid, lang, source, 'word_length', sqrt(word_chars / greatest(n_words, 1)), greatest(n_words, 1) FROM f),
k AS (SELECT lang, source, measure, least(floor(v * {SCALE}), {BINS})::INT AS bin, count(*)::DOUBLE AS w FROM m GROUP BY ALL),
a AS ({shares("measure", "SELECT measure, bin, sum(w) AS w FROM k GROUP BY ALL")}),
l AS ({shares("lang, measure", f"SELECT lang, measure, bin, sum(w) AS w FROM (SELECT lang, measure, bin, w FROM k UNION ALL SELECT lang, measure, bin, share * {PRIOR} FROM (SELECT DISTINCT lang, measure FROM k) JOIN a USING (measure)) GROUP BY ALL")}),
s AS ({shares("lang, source, measure", f"SELECT lang, source, measure, bin, sum(w) AS w FROM (SELECT * FROM k UNION ALL SELECT lang, source, measure, bin, share * {PRIOR} FROM (SELECT DISTINCT lang, source, measure FROM k) JOIN l USING (lang, measure)) GROUP BY ALL")}),
q AS (SELECT lang, source, measure, {fence} AS fence FROM ({quantiles("lang, source, measure", "s", "s")}) JOIN ({quantiles("lang, measure", "l", "l")}) USING (lang, measure) JOIN ({quantiles("measure", "a", "a")}) USING (measure)),
v AS (SELECT rid, bool_and(v - {NOISE} / sqrt(by_n) <= fence) AS below FROM m JOIN q USING (lang, source, measure) GROUP BY rid)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND below AS kept FROM f JOIN v USING (rid)"""


ORACLE_SQL = _sql()
