"""Streams over replayed files."""

import pandas as pd

from chronolane.streaming import grouping as G


BASE = 1_700_000_000 * 10**9


def rows(*items):
    return pd.DataFrame([(c, t, k, 0.0, 0.0) for k, (c, t) in enumerate(items)], columns=["camera_id", "stamp_ns", "track_id", "u", "v"])


def test_groups_wait_for_the_slowest_camera():
    out, rest, late, done = G.ready_groups(rows((0, 0), (1, 5), (0, 100)), 0, 100, 3, 2, False, -1)
    assert not len(out) and len(rest) == 3
    out, rest, late, done = G.ready_groups(rows((0, 0), (1, 5), (0, 100), (1, 101)), 0, 100, 3, 2, False, -1)
    assert list(out["stamp_ns"]) == [0, 5] and (late, done) == (0, 100)
    out, _, late, _ = G.ready_groups(rows((1, 50), (0, 120), (0, 700)), 0, 100, 3, 2, False, 100)
    assert list(out["stamp_ns"]) == [120] and late == 1  # the idle camera is overruled
    out, rest, _, _ = G.ready_groups(rows((0, 0), (0, 100)), 0, 100, 3, 2, True, -1)
    assert len(out) == 2 and not len(rest)


def run(query_frame, name, mode="append"):
    q = query_frame.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start()
    try:
        assert q.awaitTermination(90)
    finally:
        q.stop()


def test_grouped_stream(spark, tmp_path):
    schema = "rig string, camera_id int, stamp_ns long, track_id long, u double, v double"
    for k, part in enumerate([[(0, 0), (1, 5)], [(0, 100), (1, 101)], [(0, 210), (1, 230), (1, 20)]]):
        spark.createDataFrame([("r", c, BASE + t, k * 10 + i, 0.5, 0.5) for i, (c, t) in enumerate(part)], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    run(G.grouped(G.replay(spark, str(tmp_path / "in"), schema, 10), 0, 100, 2), "groups")
    got = spark.table("groups").collect()
    assert {(r["anchor_ns"] - BASE, r["stamp_ns"] - BASE) for r in got} >= {(0, 0), (0, 5), (0, 20), (100, 100), (100, 101)}


def test_rates_stream(spark, tmp_path):
    schema = "topic string, timestamp_ns long"
    spark.createDataFrame([("/a", k * 600 * 10**9) for k in range(30)], schema).write.parquet(str(tmp_path / "in"))
    run(G.rates(G.replay(spark, str(tmp_path / "in"), schema)), "rates", "complete")
    assert spark.table("rates").agg({"n": "sum"}).first()[0] == 30
