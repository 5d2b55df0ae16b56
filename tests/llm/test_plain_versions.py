"""The fingerprint and the discriminant against plain versions that share no code with them."""

import binascii
import re

import numpy as np
import pandas as pd
import xxhash

from chronolane.llm import fingerprint, quality

DATA = "/root/testdata/sf0.001"
FULL = (1 << 64) - 1


def _chain(*values):
    """A hash over values in turn: text, or numbers as (value, bytes)."""
    h = 42
    for v in values:
        data = v.encode() if isinstance(v, str) else (v[0] & ((1 << 8 * v[1]) - 1)).to_bytes(v[1], "little")
        h = xxhash.xxh64_intdigest(data, seed=h)
    return h


def _signed(x):
    return x - (1 << 64) if x >> 63 else x


def plain_fingerprint(text):
    words = [(_chain(w), 8) for w in re.findall(r"[^\x20\x09-\x0D]+", text or "")]
    shingles = {_chain(*words[i : i + 5]) for i in range(max(len(words) - 4, 1))}
    full = {}
    for h in shingles:
        full[h & 255] = min(full.get(h & 255, FULL), h >> 16)
    out = []
    for j in range(256):
        at = [j] + [(j * (2 * (37 * t + 11) + 1) + 101 * t + 53) % 256 for t in range(6)]
        bin_ = next((b for b in at if b in full), None)
        if bin_ is None:
            bin_ = min(full, key=lambda b: (_signed(_chain((j, 4), (b, 8))), b))
        out.append((full[bin_] | bin_ << 48) >> (j % 40) & 255)
    return bytes(out).hex()


def test_fingerprints_equal_plain_ones(spark):
    texts = ["", None, "a", "a b", "a b c d e", "a b c d e f", " a\tb\n", "é 日本  x", "x " * 300, " ".join(str(k) for k in range(5000))]
    docs = pd.read_parquet(f"{DATA}/documents.parquet")["text"].tolist()
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts + docs)], "doc_id long, text string")
    got = fingerprint.with_fingerprint(df, "text", "fp").select("text", fingerprint.as_text("fp").alias("fp")).collect()
    assert len(got) == len(texts) + len(docs) and all(r["fp"] == plain_fingerprint(r["text"]) for r in got)


def test_likeness_equals_the_share_of_bins(spark):
    texts = [" ".join(f"w{k}" for k in range(a, a + 200)) for a in (0, 0, 5, 40, 120, 1000)] + ["", "one"]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    fp = fingerprint.with_fingerprint(df, "text", "fp")
    pairs = fp.selectExpr("text AS a", "fp AS x").crossJoin(fp.selectExpr("text AS b", "fp AS y")).select("a", "b", fingerprint.likeness("x", "y").alias("s"))
    for r in pairs.collect():
        x, y = (bytes.fromhex(plain_fingerprint(t)) for t in (r["a"], r["b"]))
        m = np.mean([u == v for u, v in zip(x, y, strict=True)])
        assert abs(r["s"] - max(0.0, (m - 1 / 256) / (1 - 1 / 256))) < 1e-12
        assert (r["a"] == r["b"]) <= (r["s"] == 1.0)


def plain_difference(x, y, at):
    """Log densities of two normal distributions, covariances shrunk as Ledoit and Wolf do, by their definitions."""
    scale = np.maximum(x.std(axis=0), 1e-3)
    logs = []
    for k in (0, 1):
        own = x[y == k]
        mean = own.mean(axis=0)
        z = (own - mean) / scale
        s = sum(np.outer(v, v) for v in z) / len(z)
        level = np.mean(np.diag(s)) * np.eye(len(s))
        spread = np.square(s - level).sum()
        noise = sum(np.square(np.outer(v, v) - s).sum() for v in z) / len(z) ** 2
        weight = max(min(noise, spread) / spread, 0.01)
        cov = ((1 - weight) * s + weight * level + 1e-4 * np.eye(len(s))) * scale[:, None] * scale[None, :]
        off = at - mean
        logs.append(-0.5 * (np.einsum("ij,jk,ik->i", off, np.linalg.inv(cov), off) + np.linalg.slogdet(cov)[1]))
    return logs[1] - logs[0]


def test_the_discriminant_equals_a_plain_one(spark):
    docs, labels = (pd.read_parquet(f"{DATA}/{t}.parquet") for t in ("documents", "labels"))
    learnt = labels[[binascii.crc32(str(d).encode()) % 5 != 0 for d in labels["doc_id"]]]
    both = learnt.dropna(subset=["quality"]).groupby("doc_id")["quality"].max().to_frame().join(docs.set_index("doc_id")["text"], how="inner")
    x, y = quality.features(both["text"]), both["quality"].to_numpy()
    every = quality.features(docs["text"])
    read = [spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("documents", "labels")]
    model = quality.train(*read)
    want = plain_difference(x, y, every)
    assert np.allclose(model.difference(every), want, rtol=1e-6, atol=1e-6)
    got = {r["doc_id"]: r for r in quality.op1_quality_classifier(spark, DATA).collect()}
    for d, v in zip(docs["doc_id"], want, strict=True):
        s = 1 / (1 + np.exp(-np.clip(model.intercept + model.slope * v, -60, 60)))
        assert abs(got[d]["score"] - s) < 1e-6 and got[d]["held_out"] == (binascii.crc32(str(d).encode()) % 5 == 0)
        assert got[d]["predicted"] == int(got[d]["score"] >= 0.3)
