"""Sharding by jump consistent hashing.

A stable key decides the shard: the first 64 bits of the MD5 of the key column as
text, then the jumps of Lamping and Veach, which need no table of the shards. With n
shards a key has 1/n of the keys in each; with one more, 1/(n + 1) of them move, all
into the new shard. The jumps run over a batch of keys at once in numpy, some ln n
rounds, each over the keys that still jump.

A row's slot is its place in its shard by key, checksum, size and id. Rows are
ranged by (shard, key, checksum, size, id, number of the row) over the partitions,
sorted inside, and numbered there; a table of a row for each partition and shard in
it (partitions plus shards at most) says where each begins. So neither a shard, nor
a key or a text that many rows share, meets in one task: the row's number, written
down before, cuts equal rows apart.

Defined results: a null text has no bytes (size 8, checksum 0); rows with a null
doc_id have the key of the empty text and so one shard; rows that share a doc_id
share a shard; equal rows have slots side by side, any of them each; an empty
table gives no rows; `sharded` and `write_shards` keep all columns, but for one
named shard.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronolane.llm.common import crc32_sql, free_name, materialise, partitions, table

SHARDS = 24
#: Fixed value: the multiplier of the generator that the jumps draw from.
MULTIPLIER = 2862933555777941757
_INDEX_BITS = 33  # of monotonically_increasing_id: below them a row's place in its partition


def jump(keys: np.ndarray, shards: int) -> np.ndarray:
    """The shard of each unsigned 64-bit key."""
    out = np.zeros(len(keys), np.int32)
    at, state, bucket = np.arange(len(keys)), keys.astype(np.uint64), np.zeros(len(keys), np.int64)
    while len(at):
        out[at] = bucket
        state = state * np.uint64(MULTIPLIER) + np.uint64(1)
        bucket = ((bucket + 1) * (float(1 << 31) / ((state >> np.uint64(33)).astype(np.float64) + 1))).astype(np.int64)
        on = bucket < shards
        at, state, bucket = at[on], state[on], bucket[on]
    return out


def key_of(column: Column) -> Column:
    """The first 64 bits of the MD5 of a column as text, as a signed long; null counts as empty."""
    digest = F.md5(F.coalesce(column.cast("string"), F.lit("")).cast("binary"))
    half = lambda at: F.conv(F.substring(digest, at, 8), 16, 10).cast("long")
    return F.shiftleft(half(1), 32).bitwiseOR(half(9))


def shard_of(key: Column, shards: int) -> Column:
    """The shard, 0 to shards - 1, of a key made by key_of."""
    if shards < 1:
        raise ValueError("there must be a shard at least")

    @F.pandas_udf("int")
    def jumped(keys: pd.Series) -> pd.Series:
        return pd.Series(jump(keys.to_numpy(np.int64).view(np.uint64), shards))

    return jumped(key)


def sharded(docs: DataFrame, shards: int = SHARDS, by: str = "doc_id") -> DataFrame:
    """The rows with their shard by any column; by a text's digest, equal texts share a shard."""
    kept = docs.drop("shard") if by.lower() != "shard" else docs
    return kept.withColumn("shard", shard_of(key_of(F.col(by)), shards))


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS, by: str = "doc_id", files: int = 8) -> None:
    """Parquet in a folder shard=k for each shard, in some `files` files each: a shard is dealt to as many tasks."""
    out = sharded(docs, shards, by)
    salt = free_name(out.columns, "salt")
    out = out.withColumn(salt, F.pmod(F.xxhash64(*[c for c, kind in docs.dtypes if not kind.startswith("map")]), F.lit(files)))
    out.repartition(max(partitions(docs.sparkSession), shards * files), "shard", salt).drop(salt).write.partitionBy("shard").parquet(path)


def with_slots(rows: DataFrame, group: str, order: list[str], slot: str) -> DataFrame:
    """Adds each row's place in its group by the order, gapless from 0.

    The rows should be a written table, read back: their numbers must not change
    when a task runs again.
    """
    tie, at, part, n, first, before = (free_name([*rows.columns, slot], s) for s in ("tie", "at", "part", "n", "first", "before"))
    spark = rows.sparkSession
    numbered = materialise(rows.withColumn(tie, F.monotonically_increasing_id()), "numbered")
    by = [group, *order, tie]
    sorted_ = numbered.repartitionByRange(partitions(spark), *by).sortWithinPartitions(*by).drop(tie)
    placed = materialise(sorted_.withColumn(at, F.monotonically_increasing_id()), "sorted")
    placed = placed.withColumn(part, F.shiftright(at, _INDEX_BITS)).withColumn(at, F.col(at).bitwiseAND((1 << _INDEX_BITS) - 1))
    ends = placed.groupBy(group, part).agg(F.min(at).alias(first), F.count("*").alias(n))  # partitions plus groups rows at most
    earlier = Window.partitionBy(group).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.withColumn(before, F.coalesce(F.sum(n).over(earlier), F.lit(0))).drop(n)
    out = placed.join(F.broadcast(ends), [group, part])
    return out.withColumn(slot, F.col(before) + F.col(at) - F.col(first)).select(*rows.columns, slot)


def placed(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard (the shard if there were one more) of every row."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    made = docs.select("doc_id", (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), key_of(F.col("doc_id")).alias("key"))
    made = made.withColumn("shard", shard_of(F.col("key"), shards)).withColumn("grown_shard", shard_of(F.col("key"), shards + 1))
    out = with_slots(made, "shard", ["key", "text_crc32", "size", "doc_id"], "slot")
    return out.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def op11_sharding(spark, sf_dir: str) -> DataFrame:
    """Every document's shard of 24, its place there, and its shard of 25."""
    return placed(table(spark, sf_dir, "documents"))


ORACLE_SQL = f"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t, ('0x' || left(md5(coalesce(doc_id::VARCHAR, '')), 16))::UBIGINT::HUGEINT AS key FROM documents),
j AS (SELECT rid, 0::BIGINT AS bucket, key AS state FROM d
  UNION ALL SELECT rid, floor((bucket + 1)::DOUBLE * (2147483648::DOUBLE / ((next >> 33) + 1)::DOUBLE))::BIGINT, next FROM (SELECT rid, bucket, (state * {MULTIPLIER} + 1) % 18446744073709551616 AS next FROM j) WHERE bucket < {SHARDS + 1}),
s AS (SELECT rid, max(bucket) FILTER (bucket < {SHARDS}) AS shard, max(bucket) FILTER (bucket < {SHARDS + 1}) AS grown FROM j GROUP BY rid),
m AS (SELECT rid, doc_id, (octet_length(encode(t)) + 8)::BIGINT AS size, {crc32_sql("t")} AS text_crc32, CASE WHEN key >= 9223372036854775808 THEN key - 18446744073709551616 ELSE key END AS key FROM d)
SELECT doc_id, size, text_crc32, 'key' AS law, shard::INT AS shard, row_number() OVER (PARTITION BY shard ORDER BY key, text_crc32, size, doc_id NULLS FIRST) - 1 AS slot, grown::INT AS grown_shard
FROM m JOIN s USING (rid)"""
