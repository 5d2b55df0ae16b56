"""The MCAP container, as its public specification has it: reading by chunks, and a chunked writer."""

from __future__ import annotations

import struct
from collections.abc import Iterator

MAGIC = b"\x89MCAP0\r\n"
#: Record kinds: fixed values of the format.
HEADER, FOOTER, SCHEMA, CHANNEL, MESSAGE, CHUNK, MESSAGE_INDEX, CHUNK_INDEX, STATISTICS, DATA_END = 1, 2, 3, 4, 5, 6, 7, 8, 11, 15


def records(data: bytes, at: int = 0, end: int | None = None) -> Iterator[tuple[int, bytes]]:
    end = len(data) if end is None else end
    while at + 9 <= end:
        kind, size = struct.unpack_from("<BQ", data, at)
        if at + 9 + size > end:
            return  # cut off
        yield kind, data[at + 9 : at + 9 + size]
        at += 9 + size


def _text(data: bytes, at: int) -> tuple[str, int]:
    (n,) = struct.unpack_from("<I", data, at)
    return data[at + 4 : at + 4 + n].decode(), at + 4 + n


def _put(text: str | bytes) -> bytes:
    raw = text if isinstance(text, bytes) else text.encode()
    return struct.pack("<I", len(raw)) + raw


def unpack(codec: str, data: bytes, size: int) -> bytes:
    if codec == "":
        return data
    if codec == "zstd":
        import zstandard

        return zstandard.ZstdDecompressor().decompress(data, max_output_size=size)
    if codec == "lz4":
        import pyarrow as pa

        return pa.decompress(data, decompressed_size=size, codec="lz4", asbytes=True)
    raise ValueError(f"unknown chunk codec {codec!r}")


def parse_schema(body: bytes) -> dict:
    (i,) = struct.unpack_from("<H", body)
    name, at = _text(body, 2)
    encoding, at = _text(body, at)
    (n,) = struct.unpack_from("<I", body, at)
    return {"id": i, "name": name, "encoding": encoding, "text": body[at + 4 : at + 4 + n].decode(errors="replace")}


def parse_channel(body: bytes) -> dict:
    i, schema = struct.unpack_from("<HH", body)
    topic, at = _text(body, 4)
    encoding, _ = _text(body, at)
    return {"id": i, "schema": schema, "topic": topic, "encoding": encoding}


def parse_chunk(body: bytes) -> tuple[int, int, bytes]:
    start, end, size, _ = struct.unpack_from("<QQQI", body)
    codec, at = _text(body, 28)
    (n,) = struct.unpack_from("<Q", body, at)
    return start, end, unpack(codec, body[at + 8 : at + 8 + n], size)


def parse_chunk_index(body: bytes) -> dict:
    start, end, offset, length, n = struct.unpack_from("<QQQQI", body)
    channels = [struct.unpack_from("<HQ", body, 36 + k)[0] for k in range(0, n, 10)]
    return {"start": start, "end": end, "offset": offset, "length": length, "channels": channels}


def summary(path: str) -> dict:
    """schemas, channels and chunks of a file: from its summary section, or (where there is none) from a scan of all records."""
    out = {"schemas": {}, "channels": {}, "chunks": [], "loose": False}

    def take(kind: int, body: bytes) -> None:
        if kind == SCHEMA:
            s = parse_schema(body)
            out["schemas"][s["id"]] = s
        elif kind == CHANNEL:
            c = parse_channel(body)
            out["channels"][c["id"]] = c

    with open(path, "rb") as f:
        f.seek(0, 2)
        size = f.tell()
        f.seek(0)
        if f.read(8) != MAGIC:
            raise ValueError(f"{path} is not MCAP")
        f.seek(max(8, size - 37))
        tail = f.read()
        start = struct.unpack_from("<Q", tail, 9)[0] if tail.endswith(MAGIC) and tail[:1] == bytes([FOOTER]) else 0
        if start:
            f.seek(start)
            for kind, body in records(f.read(size - 37 - start)):
                take(kind, body)
                if kind == CHUNK_INDEX:
                    out["chunks"].append(parse_chunk_index(body))
        if not out["chunks"]:
            at = 8
            while at + 9 <= size:
                f.seek(at)
                kind, n = struct.unpack("<BQ", f.read(9))
                if at + 9 + n > size:
                    break
                if kind == CHUNK:
                    body = f.read(n)
                    a, b, inner = parse_chunk(body)
                    used = set()
                    for k, x in records(inner):
                        take(k, x)
                        if k == MESSAGE:
                            used.add(struct.unpack_from("<H", x)[0])
                    out["chunks"].append({"start": a, "end": b, "offset": at, "length": n + 9, "channels": sorted(used)})
                elif kind in (SCHEMA, CHANNEL):
                    take(kind, f.read(n))
                elif kind == MESSAGE:
                    out["loose"] = True
                at += 9 + n
    return out


def chunk_messages(path: str, offset: int, length: int) -> Iterator[tuple[int, int, int, bytes]]:
    """channel, log time, sequence and payload of a chunk's messages, by log time and place."""
    with open(path, "rb") as f:
        f.seek(offset)
        data = f.read(length)
    _, _, inner = parse_chunk(data[9:])
    found = []
    for k, (kind, body) in enumerate(records(inner)):
        if kind == MESSAGE:
            channel, sequence, log, _ = struct.unpack_from("<HIQQ", body)
            found.append((log, k, channel, sequence, body[22:]))
    for log, _, channel, sequence, payload in sorted(found, key=lambda x: x[:2]):
        yield channel, log, sequence, payload


def loose_messages(path: str) -> Iterator[tuple[int, int, int, bytes]]:
    """Messages that stand outside chunks, in the order of the file."""
    with open(path, "rb") as f:
        data = f.read()
    for kind, body in records(data, 8):
        if kind == MESSAGE:
            channel, sequence, log, _ = struct.unpack_from("<HIQQ", body)
            yield channel, log, sequence, body[22:]


class Writer:
    """Writes messages in chunks, with indexes and a summary."""

    def __init__(self, path: str, codec: str = "zstd", chunk_bytes: int = 1 << 20) -> None:
        self.file, self.codec, self.chunk_bytes = open(path, "wb"), codec, chunk_bytes  # noqa: SIM115
        self.file.write(MAGIC)
        self._record(HEADER, _put("ros2") + _put("chronolane"))
        self.channels: dict[str, tuple[int, bytes, bytes]] = {}
        self.chunk, self.index, self.indexes, self.count = bytearray(), {}, [], 0
        self.span = [2**64 - 1, 0]
        self.whole = [2**64 - 1, 0]

    def _record(self, kind: int, body: bytes) -> None:
        self.file.write(struct.pack("<BQ", kind, len(body)) + body)

    def write(self, topic: str, timestamp_ns: int, payload: bytes, type_name: str = "", schema: str = "") -> None:
        if topic not in self.channels:
            i = len(self.channels) + 1
            s = struct.pack("<H", i) + _put(type_name) + _put("ros2msg" if schema else "") + _put(schema)
            c = struct.pack("<HH", i, i) + _put(topic) + _put("cdr") + _put(b"")
            self.channels[topic] = (i, s, c)
            for kind, body in ((SCHEMA, s), (CHANNEL, c)):
                self.chunk += struct.pack("<BQ", kind, len(body)) + body
        i = self.channels[topic][0]
        body = struct.pack("<HIQQ", i, self.count & 0xFFFFFFFF, timestamp_ns, timestamp_ns) + payload
        self.index.setdefault(i, []).append((timestamp_ns, len(self.chunk)))
        self.chunk += struct.pack("<BQ", MESSAGE, len(body)) + body
        self.span = [min(self.span[0], timestamp_ns), max(self.span[1], timestamp_ns)]
        self.whole = [min(self.whole[0], timestamp_ns), max(self.whole[1], timestamp_ns)]
        self.count += 1
        if len(self.chunk) >= self.chunk_bytes:
            self.flush()

    def flush(self) -> None:
        if not self.index:
            return
        import zlib

        raw = bytes(self.chunk)
        packed = raw
        if self.codec == "zstd":
            import zstandard

            packed = zstandard.ZstdCompressor().compress(raw)
        elif self.codec == "lz4":
            import pyarrow as pa

            packed = pa.compress(raw, codec="lz4", asbytes=True)
        offset = self.file.tell()
        head = struct.pack("<QQQI", *self.span, len(raw), zlib.crc32(raw))
        self._record(CHUNK, head + _put(self.codec) + struct.pack("<Q", len(packed)) + packed)
        length, places = self.file.tell() - offset, b""
        begin = self.file.tell()
        for i, entries in self.index.items():
            places += struct.pack("<HQ", i, self.file.tell())
            listed = b"".join(struct.pack("<QQ", *e) for e in entries)
            self._record(MESSAGE_INDEX, struct.pack("<HI", i, len(listed)) + listed)
        tail = struct.pack("<Q", self.file.tell() - begin) + _put(self.codec) + struct.pack("<QQ", len(packed), len(raw))
        self.indexes.append(struct.pack("<QQQQ", *self.span, offset, length) + struct.pack("<I", len(places)) + places + tail)
        self.chunk, self.index, self.span = bytearray(), {}, [2**64 - 1, 0]

    def close(self) -> None:
        self.flush()
        self._record(DATA_END, struct.pack("<I", 0))
        start = self.file.tell()
        for _, s, c in self.channels.values():
            self._record(SCHEMA, s)
            self._record(CHANNEL, c)
        for body in self.indexes:
            self._record(CHUNK_INDEX, body)
        self._record(FOOTER, struct.pack("<QQI", start if self.file.tell() > start else 0, 0, 0))
        self.file.write(MAGIC)
        self.file.close()
