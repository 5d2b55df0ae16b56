"""Quality classifier: a regularised quadratic discriminant over document statistics.

Each whole text becomes FEATURES statistics, transformed to be roughly normal.
For each class a mean and a shrinkage covariance are fitted; the score is the
difference of the two log densities (squared Mahalanobis distances through
cached Cholesky factors, and log determinants), turned into a probability by a
fitted intercept and slope.

The fit reads a bounded sample of labelled rows: of each class the `per_class`
rows (PER_CLASS unless given) whose id hashes lowest, so it is the same sample
wherever it runs. Scoring reads every row.

Defined results: a null text counts as empty, and empty texts are scored like
others; repeated rows are scored alike; a label row without an id or a quality
is ignored, repeated labels of an id count once; when a class has fewer than two
sampled rows every score is the share of label 1 (0.5 without labels); empty
tables give no rows; extra columns are kept by `with_scores` and ignored here.
"""

from __future__ import annotations

from dataclasses import dataclass
from operator import eq

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronolane.llm.common import table

#: Rows of each class that the fit reads, and the score from which a document passes.
PER_CLASS, THRESHOLD = 10_000, 0.3
FEATURES = (
    "log_words", "log_lines", "word_length", "upper", "digit", "symbol", "bar", "exclaim", "comma_stop",
    "distinct", "adjacent_repeat", "repeated_lines", "other_bytes", "commonest_word",
)
_SYMBOLS = np.frombuffer(b"#*$%&<>", np.uint8)


def statistics(text: str | None) -> list[float]:
    """The transformed statistics of a whole text."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    count = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    found = raw.split()
    n, size = len(found), len(raw)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    # small counts are kept apart from none, large shares saturate
    share = lambda k, of: float(np.log1p(100 * k / max(of, 1)))
    kinds: dict[bytes, int] = {}
    for w in found:
        kinds[w] = kinds.get(w, 0) + 1
    return [
        float(np.log1p(n)),
        float(np.log1p(len(lines))),
        float(np.log1p((size - int(count[32])) / max(n, 1))),
        share(int(count[65:91].sum()), size),
        share(int(count[48:58].sum()), size),
        share(int(count[_SYMBOLS].sum()), size),
        share(int(count[124]), size),
        share(int(count[33]), size),
        share(int(count[44] + count[46]), size),
        float(np.log1p(len(kinds)) / np.log1p(max(n, 1))),
        share(sum(map(eq, found, found[1:])), n),
        share(len(lines) - len(set(lines)), len(lines)),
        share(int(count[128:].sum()), size),
        share(max(kinds.values(), default=0), n),
    ]


def features(texts) -> np.ndarray:
    return np.array([statistics(t) for t in texts], float).reshape(-1, len(FEATURES))


@dataclass
class Discriminant:
    """The fitted discriminant: plain arrays, small enough to travel with the tasks."""

    mean: np.ndarray  # of a class, of all features
    whiten: np.ndarray  # inverse Cholesky factors
    log_det: np.ndarray
    intercept: float
    slope: float

    def difference(self, x: np.ndarray) -> np.ndarray:
        """Log density of class 1 less that of class 0."""
        each = [-0.5 * ((((x - self.mean[k]) @ self.whiten[k].T) ** 2).sum(axis=1) + self.log_det[k]) for k in (0, 1)]
        return each[1] - each[0]

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.intercept + self.slope * self.difference(x), -60, 60)))


@dataclass
class Constant:
    """Stands in for a discriminant when a class has too few rows."""

    value: float

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.full(len(x), self.value)


def shrunk_covariance(x: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """Covariance shrunk towards a multiple of the diagonal `scale` by the asymptotically best weight."""
    z = (x - x.mean(axis=0)) / scale
    n, d = z.shape
    s = z.T @ z / n
    level = np.trace(s) / d
    spread = ((s - level * np.eye(d)) ** 2).sum()
    noise = min(spread, max(0.0, (((z**2).sum(axis=1) ** 2).mean() - (s**2).sum()) / n))
    weight = max(noise / spread if spread else 1.0, 0.01)
    return ((1 - weight) * s + weight * level * np.eye(d)) * np.outer(scale, scale)


def fit(x: np.ndarray, y: np.ndarray, share: float) -> Discriminant | Constant:
    """x: statistics of the sample, y: 0 or 1, share: that of label 1 among all labelled rows."""
    if min((y == 0).sum(), (y == 1).sum()) < 2:
        return Constant(share)
    scale = np.maximum(x.std(axis=0), 1e-3)
    factors = [np.linalg.cholesky(shrunk_covariance(x[y == k], scale) + 1e-4 * np.diag(scale**2)) for k in (0, 1)]
    whiten = np.array([np.linalg.inv(f) for f in factors])
    log_det = np.array([2 * np.log(np.diag(f)).sum() for f in factors])
    model = Discriminant(np.array([x[y == k].mean(axis=0) for k in (0, 1)]), whiten, log_det, 0.0, 1.0)
    # logistic fit of intercept and slope, each row weighted so that the sample stands for all labelled rows
    d = model.difference(x)
    unit = max(float(np.median(np.abs(d))), 1e-9)
    a = np.column_stack([np.ones(len(d)), np.clip(d / unit, -20, 20)])
    weight = np.where(y == 1, share / (y == 1).mean(), (1 - share) / (y == 0).mean())
    b, ridge = np.array([0.0, 1.0]), 1e-4 * len(d)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ b, -60, 60)))
        step = np.linalg.solve((a * (weight * p * (1 - p))[:, None]).T @ a + ridge * np.eye(2), a.T @ (weight * (y - p)) - ridge * (b - [0.0, 1.0]))
        b = b + step
        if np.abs(step).max() < 1e-9:
            break
    model.intercept, model.slope = float(b[0]), float(max(b[1], 1e-6) / unit)
    return model


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> Discriminant | Constant:
    """Fit on a bounded sample of the labelled rows that are not held out."""
    slim = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("y"))
    slim = slim.where(F.col("doc_id").isNotNull() & F.col("y").isin(0, 1) & ~held_out(F.col("doc_id")))
    slim = slim.groupBy("doc_id").agg(F.max("y").alias("y"))
    counts = {r["y"]: r["n"] for r in slim.groupBy("y").agg(F.count("*").alias("n")).collect()}
    total = sum(counts.values())
    share = counts.get(1, 0) / total if total else 0.5
    if min(counts.get(0, 0), counts.get(1, 0)) < 2:
        return Constant(share)
    order = F.xxhash64("doc_id")
    sample = slim.where("y = 0").orderBy(order, "doc_id").limit(per_class).union(slim.where("y = 1").orderBy(order, "doc_id").limit(per_class))
    chosen = sample.collect()  # 2 * per_class pairs of numbers at most
    spark = docs.sparkSession
    # from Arrow: rows would be read by Python workers of another kind, which stay beside those of the stages
    chosen = pa.table({"doc_id": pa.array([r["doc_id"] for r in chosen], pa.int64()), "y": pa.array([r["y"] for r in chosen], pa.int32())})
    chosen = F.broadcast(spark.createDataFrame(chosen, "doc_id long, y int"))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(chosen, "doc_id")

    @F.pandas_udf("array<double>")
    def measure(text: pd.Series) -> pd.Series:
        return pd.Series(list(features(text)))

    rows = texts.select("doc_id", "y", measure("text").alias("x")).collect()
    rows = sorted({(r["doc_id"], r["y"], tuple(r["x"])) for r in rows})
    return fit(np.array([r[2] for r in rows], float).reshape(-1, len(FEATURES)), np.array([r[1] for r in rows], int), share)


def score_column(model: Discriminant | Constant, text: Column) -> Column:
    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series(model.score(features(texts)))

    return score(text.cast("string"))


def with_scores(docs: DataFrame, labels: DataFrame, name: str = "score", per_class: int = PER_CLASS) -> DataFrame:
    """The documents with their score in the column `name`."""
    return docs.withColumn(name, score_column(train(docs, labels, per_class), F.col("text")))


def op1_quality_classifier(spark, sf_dir: str) -> DataFrame:
    """Every document's quality score."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = with_scores(docs, table(spark, sf_dir, "labels"))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that score THRESHOLD or more; columns as they come."""
    return docs.where(score_column(train(docs, labels), F.col("text")) >= THRESHOLD)
