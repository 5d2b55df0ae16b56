"""Columns named like those the operators make, and very long texts, through every operator that returns rows of its input."""

import pytest
from pyspark.sql import functions as F

from chronolane.llm import chat, fingerprint, packing, pii, quality, rules, sentencepiece_scan, simhash, substring, warc

NAMES = (
    "row", "kept", "_hash", "_hit", "doc_id_r", "_h", "_p", "_copy", "_lang", "_source", "part", "sequence_id", "offset", "score", "id", "g", "h1", "hash", "made", "carried", "n_words", "_more", "_text",
    "_base", "_instances", "p", "o", "t", "copy", "stretch", "cuts", "fp", "component_id", "node", "root", "measure", "bin", "w", "piece", "length", "start",
)
COPIED = " ".join(f"word{k}" for k in range(40))
ROWS = [(1, f"{COPIED} tail one"), (2, f"head two {COPIED}"), (3, None), (3, ""), (None, "mail a@b.cd"), (4, f"{COPIED} tail one")]
LENGTH = 500_000
LONG = {"spaces": " ", "lines": "\n", "word": "x", "digits": "7", "pairs": "7 ", "short": "ab ", "ats": "a@", "dots": "1.", "marks": "# "}


@pytest.fixture(scope="module")
def clashing(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars int, " + ", ".join(f"`{n}` string" for n in NAMES)
    return spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t), *(f"own {n}" for n in NAMES)) for i, t in ROWS], schema)


def same(df, out, columns):
    assert out.count() == df.count()
    for r in out.select(*columns).distinct().collect():
        assert r.asDict() == {c: f"own {c}" for c in columns}


def test_columns_are_kept(clashing):
    for out in (pii.masked(clashing), substring.without_repeats(clashing), clashing.transform(simhash.keep_first)):
        assert out.schema.simpleString() == clashing.schema.simpleString()
    same(clashing, pii.masked(clashing), NAMES)
    same(clashing, substring.without_repeats(clashing), NAMES)
    assert {r["text"] for r in pii.masked(clashing).collect()} >= {"mail [EMAIL]", None, ""}
    assert {r["text"] for r in substring.without_repeats(clashing).collect()} >= {f"{COPIED} tail one", "head two", None, ""}
    same(clashing, fingerprint.with_fingerprint(clashing, "text", "fp"), [n for n in NAMES if n != "fp"])
    same(clashing, fingerprint.with_next(clashing, {"_next": "text", "copy": "p"}), [n for n in NAMES if n != "copy"])
    judged = rules.judged(clashing, clashing.columns)
    same(clashing, judged, [n for n in NAMES if n not in rules.RESULTS])
    items = clashing.drop("length").selectExpr("*", "7L AS length")
    same(clashing, packing.pack(items), [n for n in NAMES if n not in ("sequence_id", "offset", "length")])


def test_columns_are_ignored(clashing):
    labels = clashing.selectExpr("doc_id", "cast(doc_id % 2 as int) AS quality", "text AS score")
    assert quality.with_scores(clashing.drop("score"), labels).count() == len(ROWS)
    assert simhash.near_duplicates(clashing).count() == len(ROWS) and simhash.near_copies(clashing).count() == len(ROWS) - 1
    assert packing.packed_documents(clashing, packing.default_vocabulary()).count() == len(ROWS)
    assert sentencepiece_scan.encode(clashing, sentencepiece_scan.default_model()).count() == len(ROWS)
    turns = clashing.selectExpr("*", "doc_id AS conv_id", "1 AS turn", "'user' AS role")
    assert chat.repair(turns).count() == len(ROWS)
    pages = clashing.selectExpr("*", "doc_id AS page_id", "text AS html", "text AS url", "1 AS first", "2 AS sha", "3 AS key", "4 AS size")
    assert warc.with_first(pages).count() == len(ROWS)


@pytest.fixture(scope="module")
def long(spark):
    rows = [(k, (unit * 2_000_000)[: LENGTH] + " end") for k, unit in enumerate(LONG.values())]
    return spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'en' AS lang", "'s' AS source").repartition(len(LONG))


@pytest.mark.parametrize("operator", ["quality", "substring", "fingerprint", "sentencepiece", "simhash", "near", "rules", "packing", "pii", "warc", "chat"])
def test_long_texts(spark, tmp_path, long, operator):
    labels = long.selectExpr("doc_id", "cast(doc_id % 2 as int) AS quality")
    n = len(LONG)
    if operator == "warc":
        warc.write_archives(long.selectExpr("doc_id AS page_id", "'u' AS url", "text AS html"), str(tmp_path / "w"))
        assert warc.read_archives(spark, str(tmp_path / "w")).where("payload_bytes > 499999").count() == n
        return
    made = {
        "quality": lambda: quality.with_scores(long, labels),
        "substring": lambda: substring.without_repeats(long),
        "fingerprint": lambda: fingerprint.with_fingerprint(long, "text", "fp"),
        "sentencepiece": lambda: sentencepiece_scan.encode(long.withColumn("text", F.expr("left(text, 200000)")), sentencepiece_scan.default_model()).where("round_trip").select("doc_id").distinct(),
        "simhash": lambda: simhash.near_duplicates(long),
        "near": lambda: simhash.near_copies(long),
        "rules": lambda: rules.judged(long, ["doc_id"]),
        "packing": lambda: packing.packed_documents(long, packing.default_vocabulary()).select("doc_id").distinct(),
        "pii": lambda: pii.masked(long),
        "chat": lambda: chat.repair(long.selectExpr("doc_id AS conv_id", "1 AS turn", "'user' AS role", "text")),
    }[operator]()
    made = [tuple(r) for r in made.collect()]
    assert len(made) == n


def test_hasher_stays_small():
    """A worker keeps few powers after long texts and long words, and a word's hashes are the same wherever pieces end."""
    some = [b"one", b"two", b"x" * 200_000, b"three"]
    hasher = substring.Hasher()
    alone = {w: tuple(int(h[0]) for h in substring.Hasher().words(w)[1:]) for w in some}
    for raw in (b" ".join(some * 3), b"one two " * 200_000):
        start, one, other = hasher.words(raw)
        assert [(int(a), int(b)) for a, b in zip(one, other, strict=True)] == [alone[w] for w in raw.split()]
        assert all(raw[s : s + 1].strip() for s in start.tolist())
        assert sum(x.nbytes for pair in hasher.power for x in pair) < 16_000_000
