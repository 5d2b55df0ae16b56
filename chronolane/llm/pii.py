r"""Personal data by bootstrapped contextual extraction, in DataFrame functions only.

Base entities are found by fixed patterns, each kind's matches leftmost and
without overlap: e-mail addresses, IP addresses with parts of at most 255, card
numbers of 16 to 19 digits that pass the Luhn test, phone numbers of 8 to 15
digits. They are the seeds.

An instance is a word that holds a digit or an at sign, or a row of short groups
of digits. Its lexical patterns are of five forms: the two words before it; its
shape (letters, marks, and the numbers of digits of long runs) with the word
before it, with the word after it, and with the kinds of both neighbours (word,
mark, instance, start, end); and the words on both sides. Words are taken from
the text without outer marks, in lower case, and an earlier or later instance is
one token, as are the text's start and end.

Patterns and instances form a graph. Seeds score 1 for their kind. A pattern
stands for the kind of which it has most different seeds; its score is

    (seeds of the kind + scores of its unseen instances)
    / (that + seeds of other kinds + DOUBT for each unseen instance not scored + PRIOR)

and an unseen instance's score is the best score of its patterns with LEAST_SEEDS
different seeds or more. After ROUNDS rounds, patterns with that many seeds and a
score of LEAST_SCORE discover: their unseen instances whose digit count lies in
the range of those seeds, or one beside it, become spans of that kind. So a
shape counts as an identifier's only where words or neighbours go with it, and
words only where the number of digits does. Scores are joins and sums over
(pattern, instance) counts, so a common pattern is one pre-aggregated row per
task; joins on patterns are salted.

The patterns are written so that they take linear time and constant stack on any
text, with the same matches as the plain ones: possessive loops, and starts only
where a run begins.

Defined results: a null text counts as empty and has no spans; repeated rows have
the same spans each; a null doc_id is kept; an empty table gives no rows; extra
columns are ignored by `spans` and kept by `masked`. Positions are code points,
ends exclusive.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronolane.llm.common import materialise, table

KINDS = ("email", "ip", "card", "phone")
ROUNDS, PRIOR, DOUBT, LEAST_SEEDS, LEAST_SCORE = 3, 1.0, 0.02, 5, 0.6
_SALTS = 16

#: Plain forms: [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+, [0-9]+(\.[0-9]+){3}, [0-9]([\x20-]?[0-9])+, \+[0-9][\x20().0-9-]+[0-9]
PATTERNS = {
    "email": r"[A-Za-z0-9._%+-](?:(?<![A-Za-z0-9._%+-]{2})|(?<=\G.))[A-Za-z0-9._%+-]*+@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"[0-9](?<![0-9]{2})[0-9]*+\.[0-9]++\.[0-9]++\.[0-9]++",
    # a whole run of digits with single separators, where it has 16 to 19 digits
    "card": r"[0-9](?<![0-9]{2})(?<![0-9][\x20-][0-9])(?:[\x20-]?[0-9]){15,18}+(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_GROUP = r"[+(]{0,2}[0-9][0-9().-]{0,8}+(?![0-9])"
#: Short groups of digits in a row, or one word that holds a digit or an at sign.
INSTANCE = rf"(?<!\S)(?:{_GROUP}(?:\x20{_GROUP})*+\S*+|[^\s0-9@]*+[0-9@]\S*+)"
#: The last two words before an instance (of the reversed text), the first one after it; and the tokens that stand for instances and the text's ends (words are in lower case).
_TAIL, _HEAD, _START, _OTHER, _END = r"^\s*+(\S*+(?:\s++\S++)?+)", r"^\s*+(\S*+)", "<START>", "<INSTANCE>", "<END>"
_OPEN, _CLOSE = r"^[^\p{L}\p{N}+(]*+", r"[^\p{L}\p{N}][^\p{L}\p{N}]*+$"


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0), lambda x, y: x + y)


def with_running(out: DataFrame, name: str, values: Column) -> DataFrame:
    """Adds `name`: the running sums of an array of integers, in blocks of about its square root.

    Blocks and their sums are columns of their own, used twice each, so that they
    are worked out once for each row and not once for each element.
    """
    out = out.withColumn("_v", values)
    n = F.size("_v")
    side = F.greatest(F.ceil(F.sqrt(n)).cast("int"), F.lit(1))
    blocks = F.transform(F.sequence(F.lit(0), F.greatest((n - 1) / side, F.lit(0)).cast("int")), lambda b: F.slice("_v", b * side + 1, side))
    out = out.withColumn("_blocks", F.when(n > 0, blocks))
    out = out.withColumn("_sums", F.transform("_blocks", _total))
    inner = lambda block, b: F.transform(block, lambda x, i: _total(F.slice("_sums", 1, b)) + _total(F.slice(block, 1, i + 1)))
    sums = F.when(F.size("_sums") > 0, F.flatten(F.transform("_blocks", inner))).otherwise(F.array().cast("array<int>"))
    return out.withColumn(name, sums).drop("_v", "_blocks", "_sums")


def _matches(out: DataFrame, name: str, pattern: str, may: Column, carry: list[str]) -> DataFrame:
    """Adds `name`: an array of struct(start, end, m, before, after), one for each match; before and after: the text since the match before, and up to the next."""
    none = F.array().cast("array<string>")
    out = out.withColumn("_m", F.when(may, F.regexp_extract_all("_text", F.lit(pattern), F.lit(0))).otherwise(none))
    out = out.withColumn("_p", F.when(F.size("_m") > 0, F.split("_text", pattern, -1)).otherwise(none))
    steps = F.zip_with(F.slice("_p", 1, F.size("_m")), F.col("_m"), lambda p, m: F.length(p) + F.length(m))
    out = with_running(out, "_e", steps)
    made = F.transform("_m", lambda m, i: F.struct((F.get("_e", i) - F.length(m)).alias("start"), F.get("_e", i).alias("end"), m.alias("m"), F.get("_p", i).alias("before"), F.get("_p", i + 1).alias("after")))
    return out.select(*carry, made.alias(name))


def _valid(kind: str, m: Column) -> Column:
    digits = F.regexp_replace(m, "[^0-9]", "")
    if kind == "ip":
        return F.forall(F.split(m, r"\.", -1), lambda p: F.regexp_replace(p, "^0+", "").rlike("^(|[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"))
    if kind == "card":
        n = F.length(digits)
        digit = lambda i: F.substr(digits, i, F.lit(1)).cast("int")
        value = lambda i: F.when((n - i) % 2 == 0, digit(i)).otherwise(digit(i) * 2 - F.when(digit(i) > 4, 9).otherwise(0))
        return F.aggregate(F.transform(F.sequence(F.lit(1), n), value), F.lit(0), lambda a, x: a + x) % 10 == 0
    if kind == "phone":
        return F.length(digits).between(8, 15)
    return F.lit(True)


def _validator(kind: str):
    return lambda x: _valid(kind, x["m"])


def base_spans(docs: DataFrame, carry: list[str], keep_text: bool = False) -> DataFrame:
    """The carried columns and `_email`, `_ip`, `_card`, `_phone`: arrays of struct(start, end)."""
    out = docs.select(*carry, F.coalesce(F.col("text").cast("string"), F.lit("")).alias("_text"))
    digit = F.col("_text").rlike("[0-9]")
    may = {"email": F.contains("_text", F.lit("@")), "ip": digit, "card": digit, "phone": F.contains("_text", F.lit("+"))}
    kept = [*carry, "_text"]
    for kind in KINDS:
        out = _matches(out, "_found", PATTERNS[kind], may[kind], kept)
        fine = F.filter("_found", _validator(kind))
        out = out.select(*kept, F.transform(fine, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"))).alias(f"_{kind}"))
        kept.append(f"_{kind}")
    return out if keep_text else out.drop("_text")


def _tagged(kind: str, spans: Column) -> Column:
    return F.transform(spans, lambda x: F.struct(F.lit(KINDS.index(kind)).alias("k"), x["start"].alias("start"), x["end"].alias("end")))


def _all_base() -> Column:
    return F.concat(*[_tagged(k, F.col(f"_{k}")) for k in KINDS])


def _bare(word: Column) -> Column:
    """A word in lower case without outer marks; one of marks only as it is."""
    inner = F.regexp_replace(F.regexp_replace(F.lower(word), r"^[^\p{L}\p{N}<]++", ""), r"(?<=[\p{L}\p{N}>])[^\p{L}\p{N}>]++$", "")
    return F.when(inner == "", word).otherwise(inner)


def _shape(instance: Column) -> Column:
    """Letters as a, digits as 9, runs of five digits or more with their length."""
    out = F.regexp_replace(instance, r"\p{L}++", "a")
    out = F.transform(F.regexp_extract_all(out, F.lit(r"[0-9]++|[^0-9]++"), F.lit(0)), lambda x: F.when(~x.rlike("^[0-9]"), x).when(F.length(x) > 4, F.concat(F.lit("9{"), F.length(x), F.lit("}"))).otherwise(F.lit("9")))
    return F.array_join(out, "")


def _neighbour(word: Column) -> Column:
    return F.when(word.isin(_START, _OTHER, _END), word).when(word.rlike(r"\p{L}"), F.lit("word")).otherwise(F.lit("mark"))


def instances(based: DataFrame, carry: list[str]) -> DataFrame:
    """From base spans with the text: the carried columns and `_instances`, an array of struct(start, end, patterns, digits, instance, k).

    k is the kind's number for seeds and null for others; start and end are the
    instance's without outer marks, digits counts its digits.
    """
    kept = [*carry, "_base"]
    out = based.withColumn("_base", _all_base()).select(*kept, "_text")
    may = F.col("_text").rlike("[0-9@]")
    out = _matches(out, "_found", INSTANCE, may, kept)
    # columns of their own, used more than once each
    tail = lambda x: F.reverse(F.regexp_extract(F.reverse(x["before"]), _TAIL, 1))
    tokens = lambda text: F.transform(F.filter(F.split(text, r"\s+", -1), lambda w: w != ""), _bare)
    out = out.withColumn("_tokens", F.transform("_found", lambda x: tokens(tail(x))))
    one = lambda token: F.array(F.lit(token))
    earlier = lambda i: F.concat(F.when(i == 1, one(_START)).otherwise(one(_OTHER)), F.get("_tokens", i - 1), one(_OTHER))
    out = out.withColumn("_context", F.transform("_tokens", lambda t, i: F.concat(F.when(i == 0, one(_START)).otherwise(earlier(i)), t)))
    n = F.size("_found")
    follows = lambda x, i: F.coalesce(F.nullif(_bare(F.regexp_extract(x["after"], _HEAD, 1)), F.lit("")), F.when(i + 1 < n, F.lit(_OTHER)).otherwise(F.lit(_END)))
    out = out.withColumn("_follows", F.transform("_found", follows))
    out = out.withColumn("_inner", F.transform("_found", lambda x: F.regexp_replace(F.regexp_replace(x["m"], _OPEN, ""), _CLOSE, "")))
    out = out.withColumn("_shape", F.transform("_inner", _shape))
    # used twice, so that the base spans are put together once for each row
    over = lambda x: F.filter("_base", lambda b: (b["start"] < x["end"]) & (x["start"] < b["end"]))
    kind = lambda x: F.when(F.size("_base") > 0, F.get(over(x), F.lit(0))["k"])

    def patterns(i: Column) -> Column:
        words, after, shape = F.get("_context", i), F.get("_follows", i), F.get("_shape", i)
        before = F.get(words, F.size(words) - 1)
        form = lambda *parts: F.concat_ws("\t", *[F.lit(p) if isinstance(p, str) else p for p in parts])
        return F.array(
            form("two before", F.get(words, F.size(words) - 2), before),
            form("before", before, shape),
            form("after", after, shape),
            form("kinds", _neighbour(before), shape, _neighbour(after)),
            form("both", before, after),
        )

    made = F.transform(
        "_found",
        lambda x, i: F.struct(
            (x["start"] + F.length(F.regexp_extract(x["m"], _OPEN, 0))).alias("start"),
            (x["start"] + F.length(F.regexp_extract(x["m"], _OPEN, 0)) + F.length(F.get("_inner", i))).alias("end"),
            patterns(i).alias("patterns"),
            F.length(F.regexp_replace(x["m"], "[^0-9]", "")).alias("digits"),
            F.xxhash64(F.get("_inner", i)).alias("instance"),
            kind(x).alias("k"),
        ),
    )
    return out.select(*carry, F.filter(made, lambda x: x["start"] < x["end"]).alias("_instances"))


def _with_patterns(rows: DataFrame, patterns: DataFrame) -> DataFrame:
    """The rows that have one of the patterns, with the patterns' columns. A pattern may hold any share of the rows: it meets them in several places."""
    salted = rows.withColumn("_salt", F.pmod(F.col("instance"), F.lit(_SALTS)).cast("int"))
    return salted.join(patterns.withColumn("_salt", F.explode(F.array(*map(F.lit, range(_SALTS))))), ["pattern", "_salt"]).drop("_salt")


def confident(edges: DataFrame) -> DataFrame:
    """Patterns that may discover: pattern, k, low, high (the range of their seeds' digits) and score.

    edges: pattern, instance, k (null: unseen), digits; each once.
    """
    kinds = edges.groupBy("pattern", "k").agg(F.count("*").alias("n"), F.min("digits").alias("low"), F.max("digits").alias("high"))
    seeded = F.when(F.col("k").isNotNull(), F.struct("n", (-F.col("k")).alias("back"), "low", "high"))
    own = kinds.groupBy("pattern").agg(F.max(seeded).alias("top"), F.sum(F.when(F.col("k").isNotNull(), F.col("n"))).alias("seeds"), F.sum(F.when(F.col("k").isNull(), F.col("n"))).alias("unseen"))
    own = own.where(F.col("top.n") >= LEAST_SEEDS).select("pattern", (-F.col("top.back")).alias("k"), "top.low", "top.high", F.col("top.n").alias("of_kind"), "seeds", F.coalesce("unseen", F.lit(0)).alias("unseen"))

    def scored(gained: Column, scored: Column) -> Column:
        good = F.col("of_kind") + gained
        return good / (good + (F.col("seeds") - F.col("of_kind")) + DOUBT * (F.col("unseen") - scored) + PRIOR)

    zero = F.lit(0.0)
    out = materialise(own.withColumn("score", scored(zero, zero)), "patterns")
    unseen = edges.where("k IS NULL").select("pattern", "instance", "digits")
    for _ in range(ROUNDS - 1):
        met = _with_patterns(unseen, out.select("pattern", "k", "low", "high", "score")).where("digits BETWEEN low - 1 AND high + 1")
        best = met.groupBy("instance", "k").agg(F.max("score").alias("worth"))
        gained = met.select("pattern", "instance", "k").join(best, ["instance", "k"]).groupBy("pattern").agg(F.sum("worth").alias("gained"), F.count("*").alias("scored"))
        out = out.drop("score").join(gained, "pattern", "left")
        out = materialise(out.withColumn("score", scored(F.coalesce("gained", zero), F.coalesce("scored", zero))).drop("gained", "scored"), "patterns")
    return out.where(F.col("score") >= LEAST_SCORE).select("pattern", "k", "low", "high", "score")


def discovered(held: DataFrame, keys: list[str]) -> DataFrame:
    """keys and `_more`: the spans that confident patterns discover, an array of struct(k, start, end), for rows that have any.

    Of several kinds a span takes that of the best pattern.
    """
    flat = held.select(*keys, F.explode("_instances").alias("x")).select(*keys, "x.*")
    flat = flat.withColumn("pattern", F.explode("patterns")).drop("patterns")
    edges = materialise(flat.select("pattern", "instance", "k", "digits").distinct(), "edges")
    new = _with_patterns(flat.where("k IS NULL").drop("k"), confident(edges)).where("digits BETWEEN low - 1 AND high + 1")
    new = new.groupBy(*keys, "start", "end").agg(F.max_by("k", F.struct("score", -F.col("k"))).alias("k"))
    return new.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("k", "start", "end"))).alias("_more"))


def _text_of(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["k"]), x["start"], x["end"])), ",")


def _null_safe(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    right = right.select(*[F.col(k).alias(f"{k}_r") for k in keys], "_more")
    on = [left[k].eqNullSafe(right[f"{k}_r"]) for k in keys]
    return left.join(right, on, "left").drop(*[f"{k}_r" for k in keys])


def _held(docs: DataFrame, carry: list[str]) -> DataFrame:
    based = base_spans(docs, carry, keep_text=True)
    return instances(based, [*carry, *[f"_{k}" for k in KINDS]])


def spans(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256 and spans of every row."""
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("_hash", F.xxhash64("text"))
    held = materialise(_held(slim, ["doc_id", "_hash"]), "instances")
    out = _null_safe(held.drop("_instances"), discovered(held, ["doc_id", "_hash"]), ["doc_id", "_hash"])
    base = F.array_sort(_all_base())
    every = F.array_sort(F.concat(_all_base(), F.coalesce("_more", F.array().cast("array<struct<k:int,start:int,end:int>>"))))
    return out.select(
        "doc_id",
        *[F.size(f"_{k}").cast("long").alias(f"n_{k}") for k in KINDS],
        F.sha2(_text_of(base).cast("binary"), 256).alias("base_sha256"),
        _text_of(every).alias("spans"),
    )


def op10_contextual_pii(spark, sf_dir: str) -> DataFrame:
    """Every document's personal data."""
    return spans(table(spark, sf_dir, "documents"))


def masked(docs: DataFrame) -> DataFrame:
    """The documents with each span replaced by its kind in square brackets; columns as they come.

    Where spans overlap the one that starts first (then the longest) stands, and
    the rest of the others goes with it. A column n_chars follows the new text.
    """
    keys = ["doc_id", "_hash"]
    # the row travels as one struct: no column of it can clash with those made here
    marked = docs.select(F.struct(*docs.columns).alias("row"), "doc_id", "text", F.xxhash64("text").alias("_hash"))
    held = materialise(_held(marked.select(*keys, "text"), keys).select(*keys, _all_base().alias("_base"), "_instances"), "instances")
    held = held.where("size(_instances) > 0 OR size(_base) > 0")  # of the table: pushed below, it would repeat the search
    more = discovered(held, keys)
    found = _null_safe(held.drop("_instances").distinct(), more, keys)
    every = F.array_sort(
        F.transform(
            F.concat("_base", F.coalesce("_more", F.array().cast("array<struct<k:int,start:int,end:int>>"))),
            lambda x: F.struct(x["start"].alias("start"), (-x["end"]).alias("back"), x["k"].alias("k")),
        )
    )
    found = found.select(*keys, every.alias("_more"))
    names = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])
    # (text so far, place reached) over the spans by start
    start = F.struct(F.lit("").alias("t"), F.lit(0).alias("at"))

    def add(a: Column, x: Column) -> Column:
        clear = x["start"] >= a["at"]
        piece = F.substr(F.col("text"), a["at"] + 1, F.greatest(x["start"] - a["at"], F.lit(0)))
        return F.struct(F.when(clear, F.concat(a["t"], piece, F.get(names, x["k"]))).otherwise(a["t"]).alias("t"), F.greatest(a["at"], -x["back"]).alias("at"))

    done = lambda a: F.concat(a["t"], F.substr(F.col("text"), a["at"] + 1, F.length("text")))
    out = _null_safe(marked, found, keys)
    hit = F.coalesce(F.size("_more"), F.lit(0)) > 0
    out = out.withColumn("made", F.when(hit, F.aggregate("_more", start, add, done)))
    row = F.col("row").withField("text", F.coalesce("made", "text"))
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        row = row.withField("n_chars", F.when(F.col("made").isNotNull(), F.length("made")).otherwise(F.col("row.n_chars")).cast(kind))
    return out.select(row.alias("row")).select("row.*")
