"""Samples by reservoir and normals of points against plain loops."""

import random

import numpy as np
import xxhash

from chronolane.operators import colour, spatial


def _hash(key, n):
    """A long and an int in turn, as one hash with a sign."""
    h = xxhash.xxh64_intdigest(key.to_bytes(8, "little", signed=True), seed=42)
    h = xxhash.xxh64_intdigest(n.to_bytes(4, "little"), seed=h)
    return h - (1 << 64) if h >> 63 else h


def test_reservoirs_equal_plain_ones(spark):
    rng = random.Random(4)
    counts = {-3: 1, 0: 16, 1: 17, 2: 400, 9: 90}
    rows = [(k, t, float(t)) for k, n in counts.items() for t in rng.sample(range(10_000), n)]
    rng.shuffle(rows)
    want = set()
    for k in counts:
        slots = {}
        for n, r in enumerate(sorted(r for r in rows if r[0] == k)):
            slot = n if n < 16 else _hash(k, n) % (n + 1)
            if slot < 16:
                slots[slot] = r
        want |= set(slots.values())
    df = spark.createDataFrame(rows, "point long, image long, value double")
    for dealt in (df, df.repartition(7)):
        assert {tuple(r) for r in colour.reservoir(dealt, ["point"], "image").collect()} == want
    assert colour.reservoir(df.limit(0), ["point"], "image").count() == 0


def test_normals_equal_plain_ones(spark):
    rng = np.random.default_rng(8)
    at = np.concatenate([rng.normal(size=(150, 3)) * [4, 4, 0.1], rng.normal(size=(60, 3)) * [0.1, 2, 2] + 9, [[80.0, 80.0, 80.0]]])
    df = spark.createDataFrame([(k, *map(float, p)) for k, p in enumerate(at)], "idx long, x double, y double, z double")
    got = {r["idx"]: r for r in spatial.normals(df, 8, 1.0).collect()}
    assert len(got) == len(at)
    for k, p in enumerate(at):
        d = np.sqrt(((at - p) ** 2).sum(axis=1))
        near = [j for j in np.argsort(d) if j != k][:8]
        values, vectors = np.linalg.eigh(np.cov(at[near].T, bias=True))
        assert abs(got[k]["spacing"] - d[near].mean()) < 1e-9
        n = np.array([got[k][c] for c in ("nx", "ny", "nz")])
        assert abs(np.linalg.norm(n) - 1) < 1e-9 and n[np.abs(n).argmax()] > 0
        assert values[1] - values[0] < 1e-6 or abs(n @ vectors[:, 0]) > 1 - 1e-6


def test_normals_shuffle_neighbours_once(spark):
    """No pair is dealt out again after the search: neighbours bring their places along."""
    rng = np.random.default_rng(9)
    df = spark.createDataFrame([(k, *map(float, p)) for k, p in enumerate(rng.normal(size=(300, 3)))], "idx long, x double, y double, z double")
    out = spatial.normals(df, 8, 1.0)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan.replace("FlatMapCoGroups", "") and plan.count("Exchange hashpartitioning(idx") == 1
    assert out.count() == 300
    assert spatial.normals(df.limit(0), 8, 1.0).count() == 0
