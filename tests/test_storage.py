"""Sources and sinks: round trips, pushdown, schemas and payloads."""

import math
import os
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronolane.functions import cdr
from chronolane.sources import files, mcap, recording

S = 1_000_000_000


@pytest.fixture
def bag(spark):
    recording.register(spark)
    return spark.createDataFrame([("/ab"[: 2 + k % 2], S + k * 1000, k, bytes([k % 256]) * 5) for k in range(500)], "topic string, timestamp_ns long, seq long, payload binary")


@pytest.mark.parametrize("storage", ["mcap", "sqlite3"])
def test_round_trip(spark, bag, tmp_path, storage):
    path = str(tmp_path / "bag")
    recording.repack(bag, path, storage, 3)
    back = spark.read.format("recording").load(path)
    same = lambda d: sorted(map(tuple, d.select("topic", "timestamp_ns", "payload").collect()))
    assert same(back) == same(bag)
    some = (F.col("topic") == "/a") & (F.col("timestamp_ns") >= S + 100_000) & (F.col("timestamp_ns") < S + 200_000)
    assert same(back.where(some)) == same(bag.where(some))
    assert {r["topic"] for r in recording.topics(spark, path).collect()} == {"/a", "/ab"}
    m = recording.metadata(spark, path).first()
    assert (m["n_messages"], m["start_ns"], m["trusted"]) == (500, S, True)
    assert recording.discover(str(tmp_path)) == [path]
    assert spark.read.format("recording").option("payload", "none").load(path).where("payload IS NOT NULL").count() == 0
    with pytest.raises(Exception, match="exists"):
        recording.repack(bag, path, storage)


def test_pushed_topics_and_times_prune_chunks(tmp_path):
    path = str(tmp_path / "x.mcap")
    w = mcap.Writer(path, "", chunk_bytes=200)
    for k in range(100):
        w.write("/a" if k < 50 else "/b", k, b"x" * 20)
    w.close()
    reader = recording.RecordingReader({"path": path})
    everything = sum(len(p.chunks) for p in reader.partitions())
    reader.low, reader.high = 10, 20
    assert 0 < sum(len(p.chunks) for p in reader.partitions()) < everything / 2
    reader.low = reader.high = None
    reader.topics = {"/none"}
    assert reader.partitions() == []


@pytest.mark.parametrize("codec", ["", "zstd", "lz4"])
def test_mcap_codecs_and_missing_summary(tmp_path, codec):
    path = str(tmp_path / "x.mcap")
    w = mcap.Writer(path, codec, chunk_bytes=300)
    for k in range(40):
        w.write("/t", 1000 - k, bytes([k]))
    w.close()
    for cut in (0, 60):
        if cut:
            os.truncate(path, os.path.getsize(path) - cut)
        s = mcap.summary(path)
        got = [m for c in s["chunks"] for m in mcap.chunk_messages(path, c["offset"], c["length"])]
        assert sorted(p[0] for _, _, _, p in got) == list(range(40))


def test_slices_cover():
    got = recording.slices(5, 104, 10 * recording.SLICE_BYTES)
    assert got[0][0] == 5 and got[-1][1] == 105 and all(a[1] == b[0] for a, b in zip(got, got[1:], strict=False)) and len(got) == 10


SCHEMA = """std_msgs/Header header
uint8[] data
float64[3] v  # a comment
uint64 big
string name
int16 LIMIT=5
Point[<=2] points
bool ok
===
MSG: std_msgs/Header
builtin_interfaces/Time stamp
string frame_id
===
MSG: geometry_msgs/Point
float32 x
float64 y
"""
VALUE = {"header": {"stamp": {"sec": 7, "nanosec": 250}, "frame_id": "map"}, "data": b"\x01\x02\x03", "v": [1.0, -2.0, 0.5], "big": 2**63 + 1, "name": "é", "points": [{"x": 1.5, "y": 2.5}], "ok": True}


def test_payloads(spark):
    data = cdr.encode(SCHEMA, VALUE)
    rows = [("/t", 1, 0, data), ("/t", 2, 1, data[:9]), ("/t", 3, 2, None)]
    df = spark.createDataFrame(rows, "topic string, timestamp_ns long, seq long, payload binary")
    a, b, c = cdr.decoded(df, SCHEMA).orderBy("seq").collect()
    m = a["message"]
    assert (m["header"]["frame_id"], m["data"], m["v"], int(m["big"]), m["name"], m["points"][0]["y"], m["ok"]) == ("map", b"\x01\x02\x03", [1.0, -2.0, 0.5], 2**63 + 1, "é", 2.5, True)
    assert b["error"] and b["message"] is None and c["error"]
    assert [r[0] for r in df.orderBy("seq").select(cdr.header_stamp()).collect()] == [7_000_000_250, None, None]
    assert cdr.leads_with_header(SCHEMA) and not cdr.leads_with_header("int32 x")


def test_big_endian():
    data = b"\0\0\0\0" + struct.pack(">ixxxxd", 5, 2.5)
    assert cdr.Reader(data).message(cdr.parse("int32 a\nfloat64 b")) == {"a": 5, "b": 2.5}
    assert cdr.Reader(b"\0\1\0\0\0").message(cdr.parse("")) == {"empty": None}
    for bad in ("wstring x", "Missing m", "int32"):
        with pytest.raises(ValueError):
            cdr.parse(bad)


def test_pcd(spark, tmp_path):
    pts = spark.createDataFrame([(k, float(k), k / 2, -float(k), float(k % 3)) for k in range(100)], "idx long, x double, y double, z double, intensity double")
    files.write_pcd(pts, str(tmp_path / "map"), 3)
    back = files.read_pcd(spark, str(tmp_path / "map"))
    assert sorted((r["x"], r["y"], r["z"], r["intensity"]) for r in back.collect()) == sorted((r["x"], r["y"], r["z"], r["intensity"]) for r in pts.collect())
    text = b"VERSION 0.7\nFIELDS x y z\nSIZE 4 4 4\nTYPE F F F\nCOUNT 1 1 1\nPOINTS 1\nDATA ascii\n1 2 3\n"
    assert files.parse_pcd(text)["z"].tolist() == [3.0]


def test_static_tree():
    leaf = dict.fromkeys(files.TREE_KEYS, 0.0)
    assert [e[:2] for e in files.static_tree({"sensors": {"base": {"cam": leaf, "lidar": leaf}}})] == [("base", "cam"), ("base", "lidar")]
    for bad in ({"base": {"cam": leaf | {"w": 1}}}, {"cam": leaf}, {"base": {"cam": {"x": 1}}}, {"base": 3}):
        with pytest.raises(ValueError):
            files.static_tree(bad)


def test_clouds(spark):
    from chronolane.operators import clouds

    data = b"".join(struct.pack("<ffff", k, 2 * k, 3 * k, k / 10) for k in range(4))
    fields = [{"name": n, "offset": 4 * i, "datatype": 7} for i, n in enumerate(("x", "y", "z", "t"))]
    row = {"cloud_seq": 1, "header_stamp_ns": S, "fields": fields, "data": data, "width": 2, "height": 2, "point_step": 16, "row_step": 32, "is_bigendian": False}
    kind = "cloud_seq long, header_stamp_ns long, fields array<struct<name:string,offset:int,datatype:int>>, data binary, width int, height int, point_step int, row_step int, is_bigendian boolean"
    got = clouds.points(spark.createDataFrame([row], kind)).orderBy("point_idx").collect()
    assert [r["z"] for r in got] == [0.0, 3.0, 6.0, 9.0] and math.isclose(got[3]["t"], 0.3, rel_tol=1e-6)
    for change in ({"is_bigendian": True}, {"row_step": 16}, {"point_step": 12}):
        with pytest.raises(ValueError):
            clouds.unpack(row | change)
    assert np.allclose(clouds.seconds(np.array([5], "u4"), 6), 5e-9)


def reordered(arrivals, reserved):
    """A plain writer that holds back what is later than the next reservation."""
    out, held, waiting = [], [], sorted(reserved)

    def release():
        held.sort(key=lambda m: m[0])
        while held and (not waiting or held[0][0] <= waiting[0]):
            out.append(held.pop(0))

    for m in arrivals:
        if waiting and m[0] == waiting[0]:
            out.append(m)
            waiting.pop(0)
            release()
        elif not waiting or m[0] < waiting[0]:
            out.append(m)
        else:
            held.append(m)
    waiting.clear()
    release()
    return out


@pytest.mark.parametrize("storage", ["mcap", "sqlite3"])
def test_time_order_with_reservations(spark, tmp_path, storage):
    import random

    from chronolane.operators import order

    r = random.Random(2)
    arrivals = []
    for k in range(300):  # every tenth comes 25 messages later than it belongs; one never comes
        arrivals.append((k + 25.5 if k % 10 == 0 else k, (2 * k + (k % 10 == 0) if k % 50 else 2 * k - 1 + 2 * (k % 10 == 0)) + 10, k % 10 == 0))
    arrivals = [(t, made) for _, t, made in sorted(arrivals, key=lambda x: x[0])]
    gone = [t for t, made in arrivals if made][3]
    reserved = [t for t, made in arrivals if made]
    arrivals = [a for a in arrivals if a[0] != gone]
    want = reordered(arrivals, reserved)
    assert want == sorted(want, key=lambda m: m[0]) and len(want) == 299
    rows = [("/made" if made else "/t", t, k, bytes([k % 256]), made) for k, (t, made) in enumerate(arrivals)]
    rows += [("/t", 10**6, 1000 + k, bytes([k]), k == 30) for k in range(60)]  # one stamp, over all partitions
    rows = r.sample(rows, len(rows))
    df = spark.createDataFrame(rows, "topic string, timestamp_ns long, seq long, payload binary, made boolean")
    got = order.placed(df, F.col("made")).orderBy("place").collect()
    assert [(x["timestamp_ns"], x["made"]) for x in got[:299]] == want
    assert [x["place"] for x in got] == list(range(359)) and [x["seq"] for x in got[299:]] == [1030, *range(1000, 1030), *range(1031, 1060)]
    recording.register(spark)
    recording.write_in_time_order(df, str(tmp_path / "o"), F.col("made"), 7, storage=storage)
    back = spark.read.format("recording").load(str(tmp_path / "o")).orderBy("shard", "seq").collect()
    assert [(x["topic"], x["timestamp_ns"], bytes(x["payload"])) for x in back] == [(x["topic"], x["timestamp_ns"], bytes(x["payload"])) for x in got]
    assert back[-1]["shard"] > 3
    assert order.placed(df.where("false")).count() == 0


def test_an_output_takes_over_the_storage(spark, tmp_path):
    recording.register(spark)
    df = spark.createDataFrame([("/x", k, k, b"x") for k in range(5)], "topic string, timestamp_ns long, seq long, payload binary")
    for name in ("mcap", "sqlite3"):
        source, out = str(tmp_path / name), str(tmp_path / f"{name}-out")
        recording.repack(df, source, name)
        recording.repack(spark.read.format("recording").load(source), out, reference=source)
        assert recording.storage(recording.shards(out)[0]) == name
        assert spark.read.format("recording").load(out).count() == 5
        assert recording.inherited(source, "/out/a.db3") == "sqlite3" and recording.inherited(source, "/out/a.mcap") == "mcap"
    packed = tmp_path / "packed"
    packed.mkdir()
    (packed / "a_0.mcap.zst").write_bytes(b"")
    with pytest.raises(ValueError, match="compressed whole"):
        recording.inherited(str(packed), "/out/folder")
    with pytest.raises(ValueError):
        recording.inherited(str(tmp_path), "/out/folder")
