"""Recordings as a Spark data source: `spark.read.format("recording").load(path)`.

A recording is a file (.mcap, .db3, or either compressed whole as .zst) or a
folder of such shards. Rows: topic, timestamp_ns, seq (the order within the
shard), shard, payload. Comparisons of topic and timestamp_ns with constants are
pushed down (with spark.sql.python.filterPushdown.enabled): to the selection of
chunks in MCAP, to the statement and the time slices in SQLite. The option
payload=none leaves payloads out. A task reads a group of chunks or a slice.

The path must be one that executors can open.
"""

from __future__ import annotations

import os
import re
import sqlite3
import tempfile
from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage

from chronolane.sources import mcap

SCHEMA = "topic string, timestamp_ns long, seq long, shard int, payload binary"
GROUP_BYTES, SLICE_BYTES, MOST_SLICES = 16 << 20, 64 << 20, 4096
_SUFFIXES = (".mcap", ".db3", ".mcap.zst", ".db3.zst")


def storage(path: str) -> str:
    """mcap or sqlite3, by the first bytes; compressed files by their name."""
    if path.endswith(".zst"):
        return "mcap" if path.endswith(".mcap.zst") else "sqlite3"
    with open(path, "rb") as f:
        head = f.read(16)
    if head.startswith(mcap.MAGIC):
        return "mcap"
    if head.startswith(b"SQLite format 3\0"):
        return "sqlite3"
    raise ValueError(f"{path} is no recording")


def shards(path: str) -> list[str]:
    """The files of a recording, by the number at the end of their names; a folder holds one storage only."""
    if os.path.isfile(path):
        return [path]
    found = [f for f in os.listdir(path) if f.endswith(_SUFFIXES)]
    if not found:
        raise ValueError(f"{path} holds no recording")
    number = lambda f: (int(m[1]) if (m := re.search(r"_(\d+)\.[a-z0-9.]+$", f)) else -1, f)
    out = [os.path.join(path, f) for f in sorted(found, key=number)]
    if len({storage(f) for f in out}) > 1:
        raise ValueError(f"{path} mixes storages")
    return out


def discover(root: str) -> list[str]:
    """Recordings under a folder: folders with metadata.yaml (not looked into further) and loose files."""
    out = set()
    for at, below, names in os.walk(root):
        if "metadata.yaml" in names:
            out.add(at)
            below.clear()
        else:
            out |= {os.path.join(at, n) for n in names if n.endswith(_SUFFIXES)}
    return sorted(out)


class _Opened:
    """A shard as a plain file: one compressed whole is unpacked to a temporary file of this task."""

    def __init__(self, path: str) -> None:
        self.path, self.temp = path, None
        if path.endswith(".zst"):
            import zstandard

            fd, self.temp = tempfile.mkstemp(suffix=path[: -len(".zst")][-5:])
            with open(path, "rb") as src, os.fdopen(fd, "wb") as dst:
                zstandard.ZstdDecompressor().copy_stream(src, dst)
            self.path = self.temp

    def __enter__(self) -> str:
        return self.path

    def __exit__(self, *_: object) -> None:
        if self.temp:
            os.unlink(self.temp)


@dataclass
class Part(InputPartition):
    path: str
    shard: int
    kind: str
    chunks: list = field(default_factory=list)  # (number, offset, length)
    low: int | None = None
    high: int | None = None  # exclusive

    def __post_init__(self) -> None:
        super().__init__(None)


def slices(low: int, high: int, size: int, most: int = MOST_SLICES) -> list[tuple[int, int]]:
    """Even half-open slices of [low, high], one for each SLICE_BYTES."""
    n = max(1, min(size // SLICE_BYTES, most, high - low + 1))
    span = high - low + 1
    return [(low + span * k // n, low + span * (k + 1) // n) for k in range(n)]


class RecordingReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.path, self.payload = options["path"], options.get("payload", "all") != "none"
        self.topics: set[str] | None = None
        self.low, self.high = None, None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802
        for f in filters:
            name = ".".join(f.attribute) if hasattr(f, "attribute") else ""
            if name == "topic" and isinstance(f, (EqualTo, In)):
                values = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.topics = values if self.topics is None else self.topics & values
            elif name == "timestamp_ns" and isinstance(f, (GreaterThan, GreaterThanOrEqual, EqualTo, LessThan, LessThanOrEqual)):
                v = int(f.value)
                if isinstance(f, (GreaterThan, GreaterThanOrEqual, EqualTo)):
                    a = v + isinstance(f, GreaterThan)
                    self.low = a if self.low is None else max(self.low, a)
                if isinstance(f, (LessThan, LessThanOrEqual, EqualTo)):
                    b = v + (not isinstance(f, LessThan))
                    self.high = b if self.high is None else min(self.high, b)
            else:
                yield f

    def partitions(self) -> list[Part]:
        out = []
        for shard, path in enumerate(shards(self.path)):
            if path.endswith(".zst"):
                out.append(Part(path, shard, storage(path), low=self.low, high=self.high))
                continue
            if storage(path) == "mcap":
                s = mcap.summary(path)
                used = {i for i, c in s["channels"].items() if self.topics is None or c["topic"] in self.topics}
                group, size = [], 0
                for k, c in enumerate(s["chunks"]):
                    if (self.low is not None and c["end"] < self.low) or (self.high is not None and c["start"] >= self.high) or (c["channels"] and not used & set(c["channels"])):
                        continue
                    group.append((k, c["offset"], c["length"]))
                    size += c["length"]
                    if size >= GROUP_BYTES:
                        out.append(Part(path, shard, "mcap", group))
                        group, size = [], 0
                if group:
                    out.append(Part(path, shard, "mcap", group))
                if s["loose"]:
                    out.append(Part(path, shard, "mcap", [(-1, 0, 0)]))
            else:
                with sqlite3.connect(f"file:{path}?mode=ro", uri=True) as db:
                    a, b = db.execute("SELECT min(timestamp), max(timestamp) FROM messages").fetchone()
                if a is not None:
                    a, b = max(a, self.low if self.low is not None else a), min(b, self.high - 1 if self.high is not None else b)
                    if a <= b:
                        out += [Part(path, shard, "sqlite3", low=x, high=y) for x, y in slices(a, b, os.path.getsize(path))]
        return out

    def _wanted(self, topic: str, t: int) -> bool:
        return (self.topics is None or topic in self.topics) and (self.low is None or t >= self.low) and (self.high is None or t < self.high)

    def read(self, partition: Part) -> Iterator[tuple]:
        with _Opened(partition.path) as path:
            if partition.kind == "mcap":
                yield from self._mcap(path, partition)
            else:
                yield from self._sqlite(path, partition)

    def _mcap(self, path: str, part: Part) -> Iterator[tuple]:
        s = mcap.summary(path)
        topic = {i: c["topic"] for i, c in s["channels"].items()}
        chunks = part.chunks or [(k, c["offset"], c["length"]) for k, c in enumerate(s["chunks"])]
        for number, offset, length in chunks:
            found = mcap.loose_messages(path) if number < 0 else mcap.chunk_messages(path, offset, length)
            for k, (channel, t, _, payload) in enumerate(found):
                if self._wanted(topic[channel], t):
                    yield topic[channel], t, (max(number, 0) << 32) + k, part.shard, payload if self.payload else None

    def _sqlite(self, path: str, part: Part) -> Iterator[tuple]:
        with sqlite3.connect(f"file:{path}?mode=ro", uri=True) as db:
            where, args = [], []
            if self.topics is not None:
                where.append(f"t.name IN ({','.join('?' * len(self.topics))})")
                args += sorted(self.topics)
            for sign, v in ((">=", part.low), ("<", part.high)):
                if v is not None:
                    where.append(f"m.timestamp {sign} ?")
                    args.append(v)
            data = "m.data" if self.payload else "NULL"
            sql = f"SELECT t.name, m.timestamp, m.id, {data} FROM messages m JOIN topics t ON t.id = m.topic_id" + (" WHERE " + " AND ".join(where) if where else "") + " ORDER BY m.timestamp, m.id"
            for name, t, i, payload in db.execute(sql, args):
                yield name, t, i, part.shard, payload


@dataclass
class Written(WriterCommitMessage):
    path: str
    counts: dict
    start: int
    end: int
    part: int = 0


class RecordingWriter(DataSourceWriter):
    """Each task writes a shard; the commit gives them their numbers and writes metadata.yaml."""

    def __init__(self, options: dict, overwrite: bool) -> None:
        self.path, self.storage = options["path"], options.get("storage", "mcap")
        self.codec = options.get("compression", "zstd")
        if os.path.isdir(self.path) and os.listdir(self.path) and not overwrite:
            raise ValueError(f"{self.path} exists")
        self.overwrite = overwrite
        os.makedirs(self.path, exist_ok=True)

    def write(self, iterator: Iterator) -> Written:
        import uuid

        path = os.path.join(self.path, f".{uuid.uuid4().hex}.tmp")
        counts, start, end = {}, None, None

        def seen() -> Iterator[tuple]:
            nonlocal start, end
            for r in iterator:
                counts[r["topic"]] = counts.get(r["topic"], 0) + 1
                t = r["timestamp_ns"]
                start, end = min(t, t if start is None else start), max(t, t if end is None else end)
                yield r["topic"], t, bytes(r["payload"] or b"")

        if self.storage == "mcap":
            out = mcap.Writer(path, self.codec)
            for topic, t, payload in seen():
                out.write(topic, t, payload)
            out.close()
        else:
            with sqlite3.connect(path) as db:
                db.execute("CREATE TABLE topics(id INTEGER PRIMARY KEY, name TEXT NOT NULL, type TEXT NOT NULL, serialization_format TEXT NOT NULL, offered_qos_profiles TEXT NOT NULL)")
                db.execute("CREATE TABLE messages(id INTEGER PRIMARY KEY, topic_id INTEGER NOT NULL, timestamp INTEGER NOT NULL, data BLOB NOT NULL)")
                ids: dict[str, int] = {}
                for topic, t, payload in seen():
                    if topic not in ids:
                        ids[topic] = len(ids) + 1
                        db.execute("INSERT INTO topics VALUES (?, ?, '', 'cdr', '')", (ids[topic], topic))
                    db.execute("INSERT INTO messages(topic_id, timestamp, data) VALUES (?, ?, ?)", (ids[topic], t, payload))
                db.execute("CREATE INDEX timestamp_idx ON messages(timestamp)")
        from pyspark import TaskContext

        task = TaskContext.get()
        return Written(path, counts, start or 0, end or 0, task.partitionId() if task else 0)

    def commit(self, messages: list[Written | None]) -> None:
        import json

        if self.overwrite:
            for f in os.listdir(self.path):
                if f.endswith(_SUFFIXES) or f == "metadata.yaml":
                    os.unlink(os.path.join(self.path, f))
        full = [m for m in messages if m]
        kept = [m for m in full if m.counts] or full[:1]
        for m in full:
            if m not in kept:
                os.unlink(m.path)
        name, suffix, files = os.path.basename(self.path.rstrip("/")), ".mcap" if self.storage == "mcap" else ".db3", []
        for k, m in enumerate(sorted(kept, key=lambda m: (m.start, m.part))):
            files.append(f"{name}_{k}{suffix}")
            os.replace(m.path, os.path.join(self.path, files[-1]))
        counts: dict[str, int] = {}
        for m in kept:
            for t, n in m.counts.items():
                counts[t] = counts.get(t, 0) + n
        start = min((m.start for m in kept if m.counts), default=0)
        end = max((m.end for m in kept if m.counts), default=0)
        topics = [{"topic_metadata": {"name": t, "type": "", "serialization_format": "cdr", "offered_qos_profiles": ""}, "message_count": n} for t, n in sorted(counts.items())]
        info = {"version": 5, "storage_identifier": self.storage, "relative_file_paths": files, "duration": {"nanoseconds": end - start}, "starting_time": {"nanoseconds_since_epoch": start}, "message_count": sum(counts.values()), "topics_with_message_count": topics, "compression_format": "", "compression_mode": ""}
        temp = os.path.join(self.path, ".metadata.tmp")
        with open(temp, "w") as f:  # JSON is YAML
            json.dump({"rosbag2_bagfile_information": info}, f, indent=1)
        os.replace(temp, os.path.join(self.path, "metadata.yaml"))

    def abort(self, messages: list[Written | None]) -> None:
        for m in messages:
            if m and os.path.exists(m.path):
                os.unlink(m.path)


class RecordingSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "recording"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: object) -> RecordingReader:
        return RecordingReader(dict(self.options))

    def writer(self, schema: object, overwrite: bool) -> RecordingWriter:
        return RecordingWriter(dict(self.options), overwrite)


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(RecordingSource)


def topics(spark: SparkSession, path: str) -> DataFrame:
    """The catalogue: topic, type, serialization_format, schema_encoding, schema_text, without a look at messages."""
    rows = {}
    for f in shards(path):
        with _Opened(f) as plain:
            if storage(f) == "mcap":
                s = mcap.summary(plain)
                for c in s["channels"].values():
                    k = s["schemas"].get(c["schema"], {})
                    rows.setdefault(c["topic"], (c["topic"], k.get("name", ""), c["encoding"], k.get("encoding", ""), k.get("text", "")))
            else:
                with sqlite3.connect(f"file:{plain}?mode=ro", uri=True) as db:
                    texts = {}
                    if db.execute("SELECT 1 FROM sqlite_master WHERE name = 'message_definitions'").fetchone():
                        texts = {t: (e, x) for t, e, x in db.execute("SELECT topic_type, encoding, encoded_message_definition FROM message_definitions")}
                    for n, t, ser in db.execute("SELECT name, type, serialization_format FROM topics"):
                        rows.setdefault(n, (n, t, ser, *texts.get(t, ("", ""))))
    return spark.createDataFrame(sorted(rows.values()), "topic string, type string, serialization_format string, schema_encoding string, schema_text string").orderBy("topic")


def metadata(spark: SparkSession, path: str) -> DataFrame:
    """A recording's own statistics, one row: start_ns, end_ns, n_messages, per_topic, trusted (all three are there)."""
    import json

    file = os.path.join(path, "metadata.yaml")
    with open(file) as f:
        text = f.read()
    try:
        info = json.loads(text)
    except ValueError:
        import yaml

        info = yaml.safe_load(text)
    info = info["rosbag2_bagfile_information"]
    start, length, n = info.get("starting_time", {}).get("nanoseconds_since_epoch"), info.get("duration", {}).get("nanoseconds"), info.get("message_count")
    per = {t["topic_metadata"]["name"]: t["message_count"] for t in info.get("topics_with_message_count", [])}
    trusted = None not in (start, length, n)
    row = (start, start + length if trusted else None, n, per, trusted)
    return spark.createDataFrame([row], "start_ns long, end_ns long, n_messages long, per_topic map<string,long>, trusted boolean")


def inherited(reference: str, path: str) -> str:
    """The storage of an output: by the output's own ending, else that of the recording it is made from.

    A recording whose files are compressed whole has none to pass on: outputs are not compressed so, and it raises.
    """
    for suffix, name in ((".mcap", "mcap"), (".db3", "sqlite3")):
        if path.endswith(suffix):
            return name
    first = shards(reference)[0]
    if first.endswith(".zst"):
        raise ValueError(f"{reference} is compressed whole: name the storage of the output")
    return storage(first)


def repack(source: DataFrame, path: str, storage_: str | None = None, shards_: int = 1, reference: str | None = None) -> None:
    """Write messages as a recording, in time order: a shard for each of `shards_` ranges of time.

    The storage is the one named, else that of the reference (`inherited`), else mcap.
    """
    storage_ = storage_ or (inherited(reference, path) if reference else "mcap")
    ordered = source.select("topic", "timestamp_ns", "payload", F.col("seq"))
    dealt = ordered.repartitionByRange(shards_, "timestamp_ns").sortWithinPartitions("timestamp_ns", "seq")
    dealt.select("topic", "timestamp_ns", "payload").write.format("recording").option("storage", storage_).mode("append").save(path)


def write_in_time_order(messages: DataFrame, path: str, reserved: Column | None = None, partitions: int | None = None, **options: str) -> None:
    """Write topic, timestamp_ns, seq, payload as a recording whose storage order, shard after shard, is time order (`order.in_time`).

    reserved: of messages that were made later than their stamps (a joined cloud,
    an embedded trajectory); they go before others of their stamp. A reservation
    that nothing fills holds nothing back.
    """
    from chronolane.operators import order

    sorted_ = order.in_time(messages, reserved, partitions)
    sorted_.select("topic", "timestamp_ns", "seq", F.lit(0).alias("shard"), "payload").write.format("recording").mode("append").options(**options).save(path)


def embed(messages: DataFrame, added: DataFrame, path: str, replace: bool = False, **options: str) -> None:
    """Write a recording's messages with others among them (topic, timestamp_ns, seq, payload), in time order; of equal stamps the added go first.

    A topic of the added that the recording has messages of already is an error, or
    is replaced by the added ones.
    """
    names = added.select("topic").distinct()
    if not replace and (known := messages.join(names, "topic", "left_semi").select("topic").first()):
        raise ValueError(f"the recording has messages of {known['topic']} already")
    columns = ["topic", "timestamp_ns", "seq", "payload"]
    kept = messages.join(names, "topic", "left_anti").select(*columns, F.lit(False).alias("_added"))
    write_in_time_order(kept.unionByName(added.select(*columns, F.lit(True).alias("_added"))), path, F.col("_added"), **options)
