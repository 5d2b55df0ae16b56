"""Times of the headline queries: one JSON line, the total in seconds and each query's own.

`recording` has, apart from the total, seconds and MiB of payload a second over a
recording that is written from the events first, with payloads of some 2 KB: a full
scan, a sparse topic, a time slice, and a rewrite without one topic.
"""

from __future__ import annotations

import json
import os
import shutil
import tempfile
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from chronolane import registry
from chronolane.plans.recording import messages
from chronolane.sources import recording

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")


def session() -> SparkSession:
    made = (
        SparkSession.builder.master(f"local[{CPUS}]")
        .config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    made.sparkContext.setLogLevel("ERROR")
    return made


def timed(spark: SparkSession, query) -> float:
    """Seconds until every row and column of the result is made; nothing is collected."""
    began = time.perf_counter()
    query(spark, SF_DIR).write.format("noop").mode("overwrite").save()
    return round(time.perf_counter() - began, 3)


def over_recording(spark: SparkSession) -> dict:
    """Seconds and MiB a second of what is done to a written recording."""
    recording.register(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    folder = tempfile.mkdtemp(prefix="chronolane-bench-")
    try:
        m = messages(spark, SF_DIR)
        text = F.concat_ws("", "payload", F.sha2(F.col("seq").cast("string"), 256))
        m = m.withColumn("payload", F.encode(F.left(F.repeat(text, 40), F.lit(2048)), "UTF-8"))
        low, high, n = m.agg(F.min("timestamp_ns"), F.max("timestamp_ns"), F.sum(F.octet_length("payload"))).first()
        rare = m.groupBy("topic").count().orderBy("count").first()["topic"]
        source, out = f"{folder}/source", {}

        def took(name: str, size: int, work) -> None:
            began = time.perf_counter()
            work()
            s = time.perf_counter() - began
            out[name] = {"sec": round(s, 3), "mib_per_sec": round(size / s / 2**20, 1)}

        noop = lambda df: df.write.format("noop").mode("overwrite").save()
        took("write", n, lambda: recording.repack(m, source, "mcap", int(CPUS)))
        opened = spark.read.format("recording").load(source)
        took("full_scan", n, lambda: noop(opened))
        took("sparse_topic", n, lambda: noop(opened.where(F.col("topic") == rare)))
        middle = (F.col("timestamp_ns") >= low + (high - low) // 2) & (F.col("timestamp_ns") < low + (high - low) * 6 // 10)
        took("time_slice", n, lambda: noop(opened.where(middle)))
        took("rewrite_without_a_topic", n, lambda: recording.repack(opened.where(F.col("topic") != rare).drop("shard"), f"{folder}/rewritten", "mcap", int(CPUS)))
        return {"payload_mib": round(n / 2**20, 1), **out}
    finally:
        shutil.rmtree(folder, ignore_errors=True)


def main() -> None:
    spark, queries = session(), registry.queries()
    timed(spark, queries[min(queries)])  # starts the JVM's machinery; not counted
    took = {name: timed(spark, queries[name]) for name in sorted(queries)}
    sf = os.path.basename(SF_DIR.rstrip("/")).removeprefix("sf")
    print(json.dumps({"metric": "all recording queries, total time", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": float(sf) if sf.replace(".", "", 1).isdigit() else sf, "recording": over_recording(spark)}))
    spark.stop()


if __name__ == "__main__":
    main()
