"""Filter audit, sharding and spelling variants against plain versions, and on odd rows."""

import collections
import itertools
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronolane.llm import audit, sharding, spelling

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, source string, part string, failed string, first string, slot string, shard string, tie string, id string, n string, word string, step int"
EXTRA = ("own",) * 9 + (7,)
TEXTS = [
    None, "", " \n\t", "one", "one", "A B C D", "a " * 60, "word# " + " ".join(f"w{k}" for k in range(70)), " ".join(f"w{k}" for k in range(50)),
    " ".join(f"w{k}" for k in range(49)), "ABC " * 30, "x" * 3000, "wörd é ÀÉ " * 60, "a|b " * 55, "ten " * 31 + " ".join(f"d{k}" for k in range(40)),
]


def rows_of(seed=0, n=150):
    r = random.Random(seed)
    out = [(k + 1, r.choice(TEXTS), r.choice(["s", "t", "t", "t", None, ""])) for k in range(n)]
    out += [(None, "one", "s"), (None, None, None), (5, out[4][1], "s"), (5, "other text", "s"), (6, "other text", "u")]
    return out + [(None, "one", "s")] * 20


# ---- filter audit ----


def plain_audit(rows, labels):
    least, good, toxic = {}, set(), set()
    for i, t, _ in rows:
        if i is not None:
            least[t or ""] = min(least.get(t or "", i), i)
    for i, q, x in labels:
        good |= {i} if q == 1 and i is not None else set()
        toxic |= {i} if x == 1 and i is not None else set()
    out, shapley = {}, collections.Counter()
    for i, t, part in rows:
        t, part = t or "", part or ""
        w = WORD.findall(t)
        fails = {
            "A": len(w) < 50,
            "B": 100 * len(set(w)) < 65 * len(w),
            "C": 100 * len(re.findall("[A-Z]", t)) > 5 * len(t),
            "D": bool(re.search(r"[#$%&*|]", t)),
            "E": i is not None and least[t] < i,
        }
        for p in itertools.permutations("ABCDE"):
            gone = False
            for step, f in enumerate(p, 1):
                c = out.setdefault((part, "".join(p), step), [0] * 6)
                here = fails[f] and not gone
                c[2] += fails[f] and gone
                gone = gone or here
                c[0] += not gone
                c[1] += here
                c[3] += fails[f] and sum(fails.values()) == 1
                c[4] += here and i in good
                c[5] += here and i in toxic
                shapley[part, f] += here
    return sorted((*k, *map(int, v), shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items())


AUDITED = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def test_audit_brute_force(spark):
    rows = rows_of()
    labels = [(k, k % 2, k % 3 == 0) for k in range(1, 120)] + [(3, 0, 0), (4, 1, 1), (None, 1, 1), (7, None, None), (999, 1, 1)]
    df = spark.createDataFrame([(*r, *EXTRA) for r in rows], DOCS)
    marks = spark.createDataFrame([(i, q, None if x is None else int(x)) for i, q, x in labels], "doc_id long, quality int, toxic int")
    got = audit.audit(df, marks).select(*AUDITED).collect()
    assert sorted(map(tuple, got)) == plain_audit(rows, labels)
    assert {r["filter_order"] for r in got} == {"".join(p) for p in itertools.permutations("ABCDE")}


def test_audit_without_rows(spark):
    df = spark.createDataFrame([], DOCS)
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert audit.audit(df, labels).count() == 0
    one = audit.audit(spark.createDataFrame([(1, None, None, *EXTRA)], DOCS), labels).collect()
    assert len(one) == 600 and sum(r["removed"] for r in one) == 120 and {r["part"] for r in one} == {""}


def test_replay_of_other_filters(spark):
    rows = spark.createDataFrame([("p", 0b11, 1, 0), ("p", 0b10, 0, 1), ("p", 0, 1, 1)], "part string, failed int, good int, toxic int")
    got = {(r["filter_order"], r["step"]): (r["kept"], r["removed"], r["redundant"], r["unique_fails"], r["shapley"]) for r in audit.replay(rows, "XY").collect()}
    assert got == {("XY", 1): (2, 1, 0, 0, 1), ("XY", 2): (1, 1, 1, 1, 3), ("YX", 1): (1, 2, 0, 1, 3), ("YX", 2): (1, 0, 1, 0, 1)}


# ---- sharding ----


def plain_jump(key, shards):
    b, j = -1, 0
    while j < shards:
        b = j
        key = (key * 2862933555777941757 + 1) % 2**64
        j = int((b + 1) * (float(2**31) / float((key >> 33) + 1)))
    return b


def test_jumps():
    r = random.Random(1)
    keys = np.array([0, 1, 2**63, 2**64 - 1, *(r.randrange(2**64) for _ in range(3000))], np.uint64)
    for n in (1, 2, 3, 24, 1000):
        assert sharding.jump(keys, n).tolist() == [plain_jump(int(k), n) for k in keys]
    assert len(sharding.jump(keys[:0], 24)) == 0
    before, after = sharding.jump(keys, 24), sharding.jump(keys, 25)
    assert set(after[before != after].tolist()) == {24} and 0.02 < np.mean(before != after) < 0.06
    assert np.bincount(before, minlength=24).min() > 80


def test_placed(spark):
    rows = rows_of(2, 400) + [(8, "same", "s")] * 300 + [(None, f"text {k}", "s") for k in range(300)]
    got = sharding.placed(spark.createDataFrame([(*r, *EXTRA) for r in rows], DOCS)).collect()
    assert len(got) == len(rows)
    assert sorted((str(r["doc_id"]), r["size"], r["text_crc32"]) for r in got) == sorted((str(i), len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t, _ in rows)
    by = collections.defaultdict(set)
    for r in got:
        by[r["doc_id"]].add((r["shard"], r["grown_shard"]))
        assert r["grown_shard"] in (r["shard"], 24) and r["law"] == "key"
    assert all(len(v) == 1 for v in by.values())
    for k in range(24):
        held = [r for r in got if r["shard"] == k]
        assert sorted(r["slot"] for r in held) == list(range(len(held)))
    again = sharding.placed(spark.createDataFrame([(*r, *EXTRA) for r in rows[::-1]], DOCS)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))


def test_shards_keep_rows(spark, tmp_path):
    df = spark.createDataFrame([(*r, *EXTRA) for r in rows_of(3)], DOCS)
    out = sharding.sharded(df, 5, "text")
    assert set(out.columns) == set(df.columns) and out.count() == df.count()
    assert out.groupBy("text").agg(F.count_distinct("shard").alias("n")).where("n > 1").count() == 0
    sharding.write_shards(df, str(tmp_path / "s"), 5)
    back = spark.read.parquet(str(tmp_path / "s"))
    plain = lambda d: sorted(map(str, d.select("doc_id", "text", "source", "tie", "step").collect()))
    assert plain(back) == plain(df) and {r["shard"] for r in back.select("shard").distinct().collect()} == set(range(5))
    assert sharding.placed(df.where("false")).count() == 0
    with pytest.raises(ValueError):
        sharding.shard_of(F.lit(1), 0)


# ---- spelling ----


def near(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(a) + 1 == len(b) and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def plain_variants(counts):
    out = {}
    for w, n in counts.items():
        others = sorted((-counts[x], x) for x in counts if near(w, x))
        best = others[0] if others and -others[0][0] >= 2 * n else None
        out[w] = (best[1] if best else None, n, len(others), -best[0] if best else None)
    rows = []
    for w, (form, n, m, fn) in out.items():
        root = w
        while out[root][0] is not None:
            root = out[root][0]
        rows.append((w, form, root, n, m, fn))
    return sorted(rows, key=str)


def plain_words(rows):
    count = collections.Counter()
    for i, t, *_ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            count[run] += 1
    return {w: n for w, n in count.items() if len(w) >= 5 and n >= 3}


VARIANTS = ["word", "form", "root", "n", "n_near", "form_n"]


@pytest.mark.parametrize("most", [2, 7, 512])
def test_variants_brute_force(spark, most):
    r = random.Random(most)
    counts = {"".join(r.choice(letters) for _ in range(r.randint(5, 9))): r.choice([3, 4, 8, 20, 90]) for letters in ("ab", "abcdefgh", "aé÷z") for _ in range(250)}
    base = ["international", "neighbourhood", "ßtraßenbahn"]
    for w in base:
        counts[w] = 700
        for k in range(60):
            v = list(r.choice([w, *[x for x in counts if abs(len(x) - len(w)) < 2 and x[0] == w[0]]]))
            p = r.randrange(len(v))
            v[p : p + 1] = r.choice(["", r.choice("aeé"), v[p] + r.choice("xyz"), "q"])
            counts.setdefault("".join(v), r.choice([3, 5, 200, 300]))
    known = spark.createDataFrame([(k, w, counts[w]) for k, w in enumerate(sorted(counts))], "id long, word string, n long").repartition(3)
    got = spelling.grouped(known, most).select(*VARIANTS).collect()
    assert sorted(map(tuple, got), key=str) == plain_variants(counts)


def test_variants_of_texts(spark):
    r = random.Random(4)
    made = ["colour", "color", "colours", "Grüße", "GRÜSSE", "grüsse", "naïve", "naive", "ÉTUDE", "étude", "abc", "a"]
    rows = [(k, " ".join(r.choice(made) for _ in range(200)) + "-don't 12x", *("own",) * 10, 7) for k in range(40)]
    rows += [(None, None, *("own",) * 10, 7), (None, "colour colour", *("own",) * 10, 7), (None, "colour colour", *("own",) * 10, 7), (3, "", *("own",) * 10, 7), (3, "12 34", *("own",) * 10, 7)]
    schema = DOCS
    df = spark.createDataFrame(rows, schema)
    got = spelling.grouped(spelling.dictionary(spelling.words(df))).select(*VARIANTS).collect()
    assert sorted(map(tuple, got), key=str) == plain_variants(plain_words(rows)) and got
    none = spelling.grouped(spelling.dictionary(spelling.words(df.where("false"))))
    assert none.count() == 0 and none.columns == VARIANTS


def test_variants_very_long_words(spark):
    long = "x" * 300_000
    words = [long, long[:-1], "y" + long[1:], long[:150_000] + "z" + long[150_000:], long[:-2], "x" * 8]
    df = spark.createDataFrame([(k, " ".join(words)) for k in range(3)], "doc_id long, text string")
    counts = {w: 3 for w in words}
    got = spelling.grouped(spelling.dictionary(df.select(F.explode(F.split("text", " ")).alias("word"))), 2).select(*VARIANTS).collect()
    assert sorted(map(tuple, got), key=str) == plain_variants(counts)
    assert sorted((len(r["word"]), r["n_near"]) for r in got) == [(8, 0), (299_998, 1), (299_999, 3), (300_000, 2), (300_000, 3), (300_001, 1)]
