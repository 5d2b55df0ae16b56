"""A corpus pipeline: quality, near duplicates, repeated passages, personal data, packing.

Each stage takes (spark, docs, sf_dir) and works on all its predecessor kept.
All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from chronolane.llm import packing, pii, quality, simhash, substring
from chronolane.llm.common import materialise, small_batches, table

#: Stretches of text whose ids a worker remembers in each of two generations.
MEMORY = 40_000

#: Bytes that go to Python at once: a batch is held by the JVM, outside its heap, and by the worker, and its whole texts are many times the size of other rows.
BATCH = 4 << 20


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on their labels, rejects go."""
    small_batches(spark, BATCH)
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the smallest doc_id stays."""
    small_batches(spark, BATCH)
    return simhash.keep_first(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 20 words that also start earlier are taken out of the texts."""
    small_batches(spark, BATCH)
    return substring.without_repeats(docs)


def contextual_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is masked by its kind."""
    return pii.masked(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' tokens in sequences of 2048: a row for each piece. The workers serve other stages too, so they remember less than op9's."""
    small_batches(spark, BATCH)
    return packing.packed_documents(docs, packing.default_vocabulary(), memory=MEMORY)


STAGES = [
    ("quality_classifier", quality_classifier),
    ("simhash_near_dedup", simhash_near_dedup),
    ("substring_dedup", substring_dedup),
    ("contextual_pii", contextual_pii),
    ("best_fit_packing", best_fit_packing),
]

#: Hashes of shingles, a fitted model and token ids are beyond SQL; tests hold each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
