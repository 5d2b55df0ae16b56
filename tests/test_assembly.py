"""Clouds joined in groups, in one pass and as streams, and keyframes of a stream."""

import random
import struct

import pytest

from chronolane.functions import cdr
from chronolane.operators import clouds
from chronolane.streaming import assembly
from test_keyframes import plain

BASE = 1_700_000_000 * 10**9
MESSAGES = "topic string, timestamp_ns long, seq long, payload binary"
PICKS = "group_id long, stamp_ns long, part int, topic string, seq long"


def cloud(points, stamp, kind="f", step=16, frame="lidar", **more):
    fields = [{"name": n, "offset": 4 * k, "datatype": 7, "count": 1} for k, n in enumerate("xyz")]
    fields.append({"name": "t", "offset": 12, "datatype": {"f": 7, "I": 6, "d": 8}[kind], "count": 1})
    data = b"".join(struct.pack("<fff" + kind, *p).ljust(step, b"\0") for p in points)
    header = {"stamp": {"sec": stamp // 10**9, "nanosec": stamp % 10**9}, "frame_id": frame}
    return {"header": header, "height": 1, "width": len(points), "fields": fields, "is_bigendian": False, "point_step": step, "row_step": step * len(points), "data": data, "is_dense": True, **more}


def times(c, kind="f", step=16):
    return [struct.unpack_from("<" + kind, c["data"], k * step + 12)[0] for k in range(c["width"])]


def test_times_count_from_the_new_stamp():
    a, b = cloud([(1, 2, 3, 0.0), (4, 5, 6, 0.25)], BASE + 500_000_000), cloud([(7, 8, 9, 0.5)], BASE + 1_000_000_000, is_dense=False)
    out = clouds.merged([a, b], BASE + 750_000_000, "base")
    assert times(out) == [-0.25, 0.0, 0.75] and (out["width"], out["height"], out["row_step"], out["is_dense"]) == (3, 1, 48, False)
    assert out["header"] == {"stamp": {"sec": 1_700_000_000, "nanosec": 750_000_000}, "frame_id": "base"}
    whole = clouds.merged([cloud([(1, 2, 3, 250_000_000)], BASE, "I"), cloud([(1, 2, 3, 0)], BASE + 500_000_000, "I")], BASE + 500_000_000, "base")
    assert times(whole) == [-0.25, 0.0] and whole["fields"][3]["datatype"] == 7
    absolute = cloud([(1, 2, 3, 1_700_000_000.5)], BASE, "d", 20)
    assert clouds.merged([absolute, absolute], BASE + 10**9, "base")["data"] == absolute["data"] * 2
    lost = cloud([(1, 2, 3, float("nan")), (1, 2, 3, float("inf"))], BASE)
    assert clouds.merged([lost], BASE + 10**9, "base")["data"] == lost["data"]


def test_clouds_that_do_not_fit():
    a = cloud([(1, 2, 3, 0.0)], BASE)
    for wrong, says in [([], "no cloud"), ([{**a, "is_bigendian": True}], "big-endian"), ([{**a, "point_step": 0}], "no size"), ([a, {**a, "fields": a["fields"][:3]}], "differ"), ([a, cloud([(1, 2, 3, 0.0)], BASE, "d", 20)], "differ"), ([{**a, "width": 2}], "shorter"), ([{**a, "point_step": 14}], "past")]:
        with pytest.raises(ValueError, match=says):
            clouds.merged(wrong, BASE, "base")
    padded = {**a, "data": a["data"] + b"more"}
    assert clouds.merged([padded, a], BASE, "base")["data"] == a["data"] * 2


def test_clouds_are_moved():
    a = cloud([(1, 0, 0, 0.0), (float("nan"), 0, 0, 0.0)], BASE)
    out = clouds.moved(a, (10, 20, 30, 0, 0, 2**-0.5, 2**-0.5))
    assert struct.unpack_from("<fff", out["data"]) == pytest.approx((10, 21, 30)) and out["data"][16:] == a["data"][16:]
    with pytest.raises(ValueError, match="moved"):
        clouds.moved({**a, "fields": a["fields"][1:]}, (0, 0, 0, 0, 0, 0, 1))


def test_points_there_and_back(spark):
    rows = [(k % 3, BASE + k % 3, k // 3, k * 0.5, -k * 0.25, 1.0, 2.0, None if k % 3 == 1 else k * 0.125) for k in range(30)]
    p = spark.createDataFrame(rows, "cloud_seq long, header_stamp_ns long, point_idx long, x double, y double, z double, intensity double, t double")
    back = clouds.unpacked(clouds.packed(p, "lidar"))
    assert sorted(map(str, back.select(*p.columns).collect())) == sorted(map(str, p.collect()))


def scene(seed=3):
    """Messages of three topics, one payload cut off, and groups that share messages; one group's message never comes."""
    r = random.Random(seed)
    messages = [(f"/t{k}", BASE + 100_000_000 * i + 1_000_000 * k, i, cdr.encode(clouds.POINT_CLOUD, cloud([(r.random(), k, i, 0.0)] * (k + 1), BASE + 100_000_000 * i))) for i in range(12) for k in range(3)]
    messages[7] = (*messages[7][:3], messages[7][3][:30])
    picks = [(g, BASE + 100_000_000 * g, k, f"/t{k}", max(0, g - (k == 2) * (g % 2))) for g in range(12) for k in range(3) if (g, k) != (5, 1)]
    return messages, [*picks, (99, BASE, 0, "/t0", 3), (99, BASE, 1, "/t1", 77)]


POSES = {1: (1.0, 2.0, 3.0, 0.0, 0.0, 0.0, 1.0)}


def plain_groups(messages, picks):
    held, out = {(m[0], m[2]): m[3] for m in messages}, {}
    for g in {p[0] for p in picks}:
        own = sorted((p[2], held.get((p[3], p[4]))) for p in picks if p[0] == g)
        stamp = next(p[1] for p in picks if p[0] == g)
        if any(x is None for _, x in own):
            out[g] = (stamp, None, 0, len(own), ())
            continue
        read, failed = [], []
        for part, payload in own:
            try:
                c = cdr.Reader(payload).message(cdr.parse(clouds.POINT_CLOUD))
                read.append(clouds.moved(c, POSES[part]) if part in POSES else c)
            except (ValueError, struct.error):
                failed.append(part)
        out[g] = (stamp, cdr.encode(clouds.POINT_CLOUD, clouds.merged(read, stamp, "base")), len(read), len(own), tuple(failed))
    return out


def found(rows):
    return {r["group_id"]: (r["stamp_ns"], None if r["payload"] is None else bytes(r["payload"]), r["merged"], r["wanted"], tuple(r["failed"])) for r in rows}


def test_assembled(spark):
    messages, picks = scene()
    got = clouds.assembled(spark.createDataFrame(messages, MESSAGES), spark.createDataFrame(picks, PICKS), "base", POSES).collect()
    assert found(got) == plain_groups(messages, picks) and len(got) == 13
    assert {r["group_id"] for r in got if r["failed"]} == {2} and [r["group_id"] for r in got if r["error"]] == [99]


@pytest.fixture
def rocks(spark):
    spark.conf.set(*assembly.STATE_STORE)
    yield spark
    spark.conf.unset(assembly.STATE_STORE[0])


def streamed(spark, path, parts, schema, made, name):
    for k, part in enumerate(parts):
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(f"{path}/in{k}")
        spark.sparkContext._jvm.java.lang.Thread.sleep(5)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/in*")
    q = made(stream).writeStream.outputMode("append").format("memory").queryName(name).trigger(availableNow=True).option("checkpointLocation", f"{path}/state").start()
    assert q.awaitTermination(200)
    return spark.table(name).collect()


def test_assembled_stream(rocks, tmp_path):
    messages, picks = scene()
    order = random.Random(1).sample(messages, len(messages))
    # one message comes twice; the last rows carry the watermark past all
    parts = [order[:15], [*order[15:], order[0]], [("/end", BASE + 10**12, 0, None)], [("/end", BASE + 2 * 10**12, 1, None)]]
    picks_ = rocks.createDataFrame([*picks, (1000, BASE, 0, "/end", 0), (1000, BASE, 1, "/end", 1)], PICKS)
    got = streamed(rocks, tmp_path, parts, MESSAGES, lambda s: assembly.assembled(s, picks_, "base", POSES, 30_000, "10 minutes"), "assembled_groups")
    want = plain_groups(messages, picks)
    assert {g: v for g, v in found(got).items() if g != 1000} == want
    assert len(got) == len({r["group_id"] for r in got})


def test_keyframe_stream(rocks, tmp_path):
    r = random.Random(8)
    schema = "topic string, timestamp_ns long, seq long, tx double, ty double, tz double, qx double, qy double, qz double, qw double, score double"
    rows, x = [], {"/a": 0.0, "/b": 0.0}
    for k in range(240):
        t = "/a" if k % 3 else "/b"
        x[t] += r.uniform(-0.5, 1.0)
        rows.append((t, BASE + k * 10**8, k, None if k == 50 else x[t], 0.0, 0.0, 0.0, 0.0, 0.0, 1.0, r.choice([1.0, 2.0, 3.0])))
    late = (*rows[5][:2], 5, *rows[5][3:])
    parts = [rows[:80], rows[80:160], [*rows[160:], late], [("/end", BASE + 10**12, 0, *rows[0][3:])], [("/end", BASE + 2 * 10**12, 1, *rows[0][3:])]]
    got = streamed(rocks, tmp_path, parts, schema, lambda s: assembly.keyframes(s, 2.0, 0.3, 30_000, "10 minutes"), "keyframe_stream")
    bucket, best = plain([(t, s, *p) for t, _, s, *p in rows], 2.0, 0.3), {}
    for t, _, s, *_, score in rows:
        b = bucket[t, s]
        key = (t, b) if b is not None else (t, None, s)
        if key not in best or score > best[key][1]:
            best[key] = (s, score)
    assert {(x["topic"], x["seq"], x["score"]) for x in got if x["topic"] != "/end"} == {(k[0], *v) for k, v in best.items()}
    assert sum(x["bucket"] is None for x in got) == 1 and max(x["late"] for x in got if x["topic"] == "/a" or x["topic"] == "/b") <= 1
