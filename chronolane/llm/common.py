"""Small helpers that the text operators share."""

from __future__ import annotations

import re
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Separators between words; everything else belongs to a word.
SEPARATORS = " \t\n\x0b\f\r"
SEPARATOR_PATTERN = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(text: Column) -> Column:
    """The words of a text as an array; null and blank texts have none."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(SEPARATORS))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SEPARATOR_PATTERN, -1))


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir; where it is unset, in local mode only, a new local one."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        found = tempfile.mkdtemp(prefix="chronolane-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(found)
    return found


def shared_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing else uses."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write a frame as Parquet to the shared folder and read it back.

    It cuts the lineage; the copy survives lost executors. The folder's owner
    empties it: a later stage may still read the copy when this returns.
    """
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a path of the shared folder, through the file system that holds it."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def free_name(taken: list[str], stem: str) -> str:
    """A column name that none of the taken ones equals, whatever the case."""
    lower = {c.lower() for c in taken}
    while stem.lower() in lower:
        stem += "_"
    return stem


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def small_batches(spark: SparkSession, size: int) -> None:
    """From now on the session hands Python batches of about `size` bytes at most: fewer rows at once, the same rows."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(size))


def crc32_sql(text: str) -> str:
    """DuckDB's SQL for the unsigned CRC-32 of a text's UTF-8 bytes; its table of 256 comes from the polynomial."""
    step = lambda c: f"xor({c} >> 1, CASE WHEN {c} & 1 = 1 THEN 3988292384 ELSE 0 END)"
    made = f"list_transform(range(256), lambda i: list_reduce(list_concat([i], range(8)), lambda c, k: {step('c')}))"
    octets = f"list_transform(regexp_extract_all(hex(encode({text})), '..'), lambda x: ('0x' || x)::BIGINT)"
    return f"(SELECT xor(list_reduce(list_concat([4294967295], {octets}), lambda c, x: xor(c >> 8, made.v[(xor(c, x) & 255) + 1])), 4294967295) FROM (SELECT {made} AS v) made)"


def nullable(kind: pa.DataType) -> pa.DataType:
    """The type with fields that may be null, as a schema in words has them."""
    if pa.types.is_struct(kind):
        return pa.struct([pa.field(f.name, nullable(f.type)) for f in kind])
    return pa.list_(nullable(kind.value_type)) if pa.types.is_list(kind) else kind
