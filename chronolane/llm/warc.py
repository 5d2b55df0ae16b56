"""WARC archives: writing, and a salvage reader.

A record is a version line, header lines, an empty line, a block and two empty
lines. Archives hold a compressed member for each record (or plain text, if asked
for) and land in any file system, as Spark's own text writer writes them: it
copies the bytes it is given and puts a separator after each. The separator is
what every record ends with anyway: the closing lines of plain ones, and of a
member the last byte of the length in its trailer, which is zero for records
under 16 MiB; a larger one is followed by an empty member, which ends so too.
Pages whose payload has an equal one with a smaller page_id become revisit
records, which carry no payload but its digest, its length and the page they
refer to.

Payloads travel once, dealt by their digest to as many archives as their bytes
ask for (ARCHIVE_BYTES and ARCHIVE_ROWS each). Digests with more than one of
HOT_PART rows, which are fewer than HOT_PART (some 10 MB), are broadcast instead;
their rows go anywhere, and all but the first without their payload.

The reader takes whole files and walks from record to record. A record counts
when its member, its version line, its header, its length, its closing lines and
its digests are right. After a failed check it searches for the next version line
at the start of a line, or in compressed archives for the next member whose
content is a record, takes up from there, and logs the bytes between as a
quarantined gap. A broken byte so costs the record that holds it and no other.

Defined results: a null html is an empty payload, and its digest that of no
bytes; a null url writes no target; a null page_id writes no id and is never
referred to while a page with an id has the payload; repeated page_ids each get
their record; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronolane.llm.common import materialise, partitions, remove, shared_path, table

ARCHIVE_ROWS, ARCHIVE_BYTES, HOT_PART = 50_000, 1 << 27, 100_000
END = b"\r\n\r\n"
_PAGE = "urn:page:"
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"
_VERSION = re.compile(rb"^WARC/1\.[01]\r\n", re.MULTILINE)
_MEMBER = b"\x1f\x8b\x08"
_FED = 1 << 16  # bytes that the reader unpacks at a time


def digest(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def member(record: bytes) -> bytes:
    """A record's compressed member (and an empty one, if the record is so large that its member ends otherwise), without the zero at its end."""
    out = gzip.compress(record, mtime=0)
    if out[-1]:
        out += gzip.compress(b"", mtime=0)
    return out[:-1]


def record_head(kind: str, page: int | None, url: str | None, refers: int | None, payload_digest: str, payload_bytes: int, block: bytes) -> str:
    """Version and header lines, with the empty line that ends them."""
    lines = ["WARC/1.1", f"WARC-Type: {kind}"]
    if page is not None:
        lines.append(f"WARC-Record-ID: <{_PAGE}{page}>")
    lines.append("WARC-Date: 1970-01-01T00:00:00Z")
    if url is not None:
        lines.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    lines += [f"WARC-Payload-Digest: sha1:{payload_digest}", f"WARC-Payload-Length: {payload_bytes}", f"WARC-Block-Digest: sha1:{digest(block)}"]
    if kind == "revisit":
        lines.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
        if refers is not None:
            lines.append(f"WARC-Refers-To: <{_PAGE}{refers}>")
    lines += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines) + "\r\n\r\n"


def with_first(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """page_id, url, html, sha1, size and first: of the pages with an equal payload of least_bytes or more, the smallest page_id.

    Payloads are compared by SHA-256. sha1 and size are the payload's; html is
    null where it is known to be some other page's and to have many copies.
    """
    spark = pages.sparkSession
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    slim = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("html"))
    slim = slim.withColumn("size", F.octet_length("html").cast("long")).withColumn("sha", F.unhex(F.sha2(F.col("html").cast("binary"), 256)))
    total = slim.agg(F.count("*").alias("rows"), F.sum("size").alias("bytes")).first()
    again = slim.where(F.col("size") >= least_bytes).groupBy("sha").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1")
    again = materialise(again, "again")
    often = F.col("n") * HOT_PART > total["rows"]
    hot = again.where(often).select("sha", F.col("first").alias("hot_first"), F.lit(True).alias("hot"))  # fewer than HOT_PART rows
    out = slim.join(F.broadcast(hot), "sha", "left")
    other = F.col("hot") & ~F.coalesce(F.col("page_id") == F.col("hot_first"), F.lit(False)) & F.col("hot_first").isNotNull()
    # rows of a hot digest are dealt by what else they hold and by where they were read
    anywhere = F.hash("page_id", "url", F.spark_partition_id()).cast("string").cast("binary")
    out = out.select(
        "page_id",
        "url",
        F.when(F.coalesce(other, F.lit(False)), F.lit(None)).otherwise(F.col("html")).alias("html"),
        F.sha1(F.col("html").cast("binary")).alias("sha1"),
        "size",
        "hot_first",
        F.when(F.col("hot"), anywhere).otherwise(F.col("sha")).alias("key"),
    )
    parts = max(partitions(spark), -(-(total["bytes"] or 0) // ARCHIVE_BYTES), -(-total["rows"] // ARCHIVE_ROWS))
    rest = again.where(~often).select(F.col("sha").alias("key"), "first")
    out = out.repartition(parts, "key").join(rest.hint("shuffle_hash"), "key", "left")
    return out.select("page_id", "url", "html", "sha1", "size", F.coalesce("hot_first", "first").alias("first"))


def write_archives(pages: DataFrame, path: str, least_bytes: int = 0, compression: str | None = "gzip") -> None:
    """Write the pages as WARC archives under the path; compression: gzip for a member for each record, None for plain text."""

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, held = [], 0
            for page, url, html, sha1, size, first in zip(*batch.columns, strict=True):
                page, first, size = page.as_py(), first.as_py(), size.as_py()
                again = first is not None and page != first
                block = _HTTP % size + (b"" if again else html.as_py().encode("utf-8", "surrogatepass"))
                said = base64.b32encode(bytes.fromhex(sha1.as_py())).decode()
                head = record_head("revisit" if again else "response", page, url.as_py(), first if again else None, said, size, block)
                record = head.encode("utf-8", "surrogatepass") + block
                out.append(member(record + END) if compression else record)
                held += len(out[-1])
                if held > 1 << 24:
                    yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["value"])
                    out, held = [], 0
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["value"])

    if compression not in ("gzip", None):
        raise ValueError(f"no compression {compression!r}")
    made = with_first(pages, least_bytes).mapInArrow(records, "value binary")
    text = made.select(F.col("value").cast("string").alias("value"))
    separator = "\0" if compression else END.decode()
    text.write.option("lineSep", separator).option("compression", "none").option("maxRecordsPerFile", ARCHIVE_ROWS).text(path)


def _header(data: bytes, at: int) -> tuple[dict[str, str], int] | None:
    """The header that starts at a version line, and where its block begins."""
    end = data.find(END, at)
    if end < 0 or not _VERSION.match(data[at : at + 10]):
        return None
    fields = {}
    for line in data[at:end].split(b"\r\n")[1:]:
        name, sep, value = line.partition(b":")
        if not sep:
            return None
        fields[name.decode("utf-8", "replace").strip().lower()] = value.decode("utf-8", "replace").strip()
    return fields, end + len(END)


def read_record(data: bytes, at: int) -> tuple[dict, int] | str:
    """The record at a place and where it ends, or what is wrong with it."""
    found = _header(data, at)
    if found is None:
        return "no version line or header"
    fields, begin = found
    size = fields.get("content-length", "")
    if not (size.isascii() and size.isdigit()):
        return "no length"
    end = begin + int(size)
    if data[end : end + len(END)] != END:
        return "no closing lines at the stated length"
    block = data[begin:end]
    if (said := fields.get("warc-block-digest")) and said != f"sha1:{digest(block)}":
        return "wrong block digest"
    payload = block.partition(END)[2] if "http" in fields.get("content-type", "") else block
    kind = fields.get("warc-type", "")
    if kind != "revisit" and (said := fields.get("warc-payload-digest")) and said != f"sha1:{digest(payload)}":
        return "wrong payload digest"
    return {"fields": fields, "kind": kind, "payload": payload}, end + len(END)


def _plain(data: bytes) -> Iterator[tuple[str, int, int, object]]:
    """("record", start, end, record) and ("gap", start, end, reason), in order; they cover all bytes."""
    at = 0
    while at < len(data):
        got = read_record(data, at)
        if isinstance(got, str):
            here = at
            after = _VERSION.search(data, at + 1)
            while after and isinstance(read_record(data, after.start()), str):
                after = _VERSION.search(data, after.start() + 1)
            at = after.start() if after else len(data)
            yield "gap", here, at, got
        else:
            yield "record", at, got[1], got[0]
            at = got[1]


def _member(data: bytes, at: int) -> tuple[bytes, int] | None:
    """The content of the compressed member at a place and where it ends; it is fed in small parts."""
    unpack, view, out = zlib.decompressobj(31), memoryview(data), []
    while not unpack.eof and at < len(data):
        try:
            out.append(unpack.decompress(view[at : at + _FED]))
        except zlib.error:
            return None
        at = min(at + _FED, len(data))
    return (b"".join(out), at - len(unpack.unused_data)) if unpack.eof else None


def _compressed(data: bytes) -> Iterator[tuple[str, int, int, object]]:
    """As _plain, of compressed members; places are those of the members. Empty members are none."""
    at, gap = 0, None
    while at < len(data):
        got = _member(data, at) if data.startswith(_MEMBER, at) else None
        found = list(_plain(got[0])) if got else []
        if any(x[0] == "record" for x in found) or (got and not got[0]):
            if gap is not None:
                yield "gap", gap, at, "no valid member"
                gap = None
            for what, _, _, x in found:
                yield what, at, got[1], x
            at = got[1]
        else:
            gap = at if gap is None else gap
            after = data.find(_MEMBER, at + 1)
            at = after if after >= 0 else len(data)
    if gap is not None:
        yield "gap", gap, len(data), "no valid member"


def salvage(data: bytes) -> Iterator[tuple[str, int, int, object]]:
    """Records and gaps of an archive, plain or compressed by records or whole: whichever of a member and a version line comes first, for its first bytes may be broken."""
    found, packed = _VERSION.search(data), data.find(_MEMBER)
    return _compressed(data) if packed >= 0 and (not found or packed < found.start()) else _plain(data)


def _page(value: str | None) -> int | None:
    m = re.fullmatch(rf"<{_PAGE}(-?\d+)>", value or "")
    return int(m[1]) if m else None


_SCHEMA = pa.schema(
    [("path", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("gap", pa.string()), ("record_type", pa.string()), ("page_id", pa.int64()), ("url", pa.string()), ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("refers_to", pa.int64()), ("payload", pa.binary())]
)


def read_archives(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """A row for each record, and for each quarantined gap (gap: what was wrong, other columns null)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0), batch.column(1), strict=True):
                rows, held = [], 0
                for what, start, end, x in salvage(content.as_py()):
                    row = {"path": name.as_py(), "start": start, "end": end}
                    if what == "gap":
                        row["gap"] = x
                    else:
                        f = x["fields"]
                        size = f.get("warc-payload-length") if x["kind"] == "revisit" else str(len(x["payload"]))
                        row |= {"record_type": x["kind"], "page_id": _page(f.get("warc-record-id")), "url": f.get("warc-target-uri"), "payload_digest": f.get("warc-payload-digest", "").removeprefix("sha1:") or digest(x["payload"])}
                        row |= {"payload_bytes": int(size) if size and size.isdigit() else None, "refers_to": _page(f.get("warc-refers-to")), "payload": x["payload"] if payloads and x["kind"] != "revisit" else None}
                    rows.append(row)
                    held += len(row.get("payload") or b"")
                    if len(rows) == 500 or held > 1 << 24:
                        yield pa.RecordBatch.from_pylist(rows, schema=_SCHEMA)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=_SCHEMA)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")
    schema = "path string, start long, end long, gap string, record_type string, page_id long, url string, payload_digest string, payload_bytes long, refers_to long, payload binary"
    return files.mapInArrow(run, schema)


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's record, as read back from the archives written of them; the archives go when it is."""
    path = shared_path(spark, "warc")
    write_archives(table(spark, sf_dir, "pages"), path)
    out = read_archives(spark, path, payloads=False).where("gap IS NULL")
    out = materialise(out.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"), "records")
    remove(spark, path)
    return out
