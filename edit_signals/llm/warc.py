"""WARC archives with segmented records: writing, and reassembly on reading.

Writing: a record's block is an HTTP response whose payload is framed by chunked transfer coding.
A block longer than ``segment_bytes`` is split: the first segment keeps the record's type, the
others are ``continuation`` records with the origin's id and their segment number, the last one with
the total length. Records are handed to Spark's text writer in bundles of about ``BUNDLE_BYTES``,
``FILE_BUNDLES`` to a gzip file, with the record separator between them, so files stay small
however long a page is.

Reading: every file is parsed by Content-Length; continuation records are grouped by origin id and
ordered by segment number, their total length is verified (a record that is not whole fails the
job), and the chunked framing is decoded.

Equal payloads (by digest and length) are stored once: the record with the largest page_id is the
response, the others are revisits that refer to it. Payloads below ``min_bytes`` are always stored.

Edge cases: a null html is the empty payload; a null page_id ranks below every other; rows that share
the largest page_id are all responses (repeated rows come back as often as they came); extra
columns are ignored; an empty table gives an empty archive.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path
from .common import BATCH_BYTES, land, map_batches, text_bytes

SEGMENT_BYTES = 256 << 10
CHUNK_BYTES = 32 << 10
BUNDLE_BYTES = 1 << 20  # records written as one row
FILE_BUNDLES = 16  # rows written to one file
NO_ID = -(1 << 63)
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"  # fixed value of the format
_END = b"\r\n"
_BETWEEN = b"\r\n\r\n"
_RECORDS = "id string, origin string, segment int, total long, type string, page_id long, refers_to long, digest string, block binary"


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def chunked(payload: bytes, size: int = CHUNK_BYTES) -> bytes:
    """Chunked transfer coding."""
    parts = [payload[a:a + size] for a in range(0, len(payload), size)]
    return b"".join(b"%x\r\n%b\r\n" % (len(p), p) for p in parts) + b"0\r\n\r\n"


def unchunked(body: bytes) -> bytes:
    out, at = [], 0
    while True:
        end = body.index(_END, at)
        size = int(body[at:end].split(b";")[0], 16)
        at = end + 2
        if not size:
            return b"".join(out)
        if body[at + size:at + size + 2] != _END:
            raise ValueError("chunk without its end")
        out.append(body[at:at + size])
        at += size + 2


def _header(fields: list[tuple[str, object]], length: int) -> bytes:
    lines = ["WARC/1.1", *(f"{k}: {v}" for k, v in fields if v is not None), f"Content-Length: {length}", "", ""]
    return "\r\n".join(lines).encode()


def record_segments(page_id: int | None, url: str | None, kind: str, refers_to: int | None,
                    payload: bytes, digest: str, segment_bytes: int = SEGMENT_BYTES) -> list[bytes]:
    """The record, or its segments, without the separator that follows each.

    Every record has an id of its own, so repeated pages are records like any others. A task that is
    run again writes other ids, and only one attempt's file is committed.
    """
    record_id = f"uuid:{uuid.uuid4()}"
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"
    block = head + (chunked(payload) if kind == "response" else b"")
    fields = [("WARC-Date", "2024-01-01T00:00:00Z"), ("Content-Type", "application/http; msgtype=response"),
              ("WARC-Target-URI", None if url is None else " ".join(url.split())), ("X-Page-Id", page_id),
              ("X-Refers-To-Page-Id", refers_to), ("WARC-Profile", PROFILE if kind == "revisit" else None), ("WARC-Payload-Digest", f"sha1:{digest}"), ("X-Payload-Length", len(payload))]
    parts = [block[a:a + segment_bytes] for a in range(0, len(block), segment_bytes)]
    if len(parts) == 1:
        return [_header([("WARC-Type", kind), ("WARC-Record-ID", f"<urn:{record_id}>"), *fields], len(block)) + block]
    out = []
    for k, part in enumerate(parts, 1):
        if k == 1:
            own = [("WARC-Type", kind), ("WARC-Record-ID", f"<urn:{record_id}>"), *fields]
        else:
            own = [("WARC-Type", "continuation"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>"),
                   ("WARC-Date", "2024-01-01T00:00:00Z"), ("WARC-Segment-Origin-ID", f"<urn:{record_id}>")]
        own += [("WARC-Segment-Number", k), ("WARC-Segment-Total-Length", len(block) if k == len(parts) else None)]
        out.append(_header(own, len(part)) + part)
    return out


def write_archive(pages: DataFrame, path: str, min_bytes: int = 0, segment_bytes: int = SEGMENT_BYTES) -> None:
    """Write one record per row of ``pages(page_id, url, html)`` under ``path``."""
    html = pages.select(F.coalesce(F.col("page_id").cast("long"), F.lit(NO_ID)).alias("page_id"),
                        F.col("url").cast("string").alias("url"), text_bytes("html").alias("html"))

    def digest(batch: pa.RecordBatch) -> pa.RecordBatch:
        payloads = batch.column("html").to_pylist()
        return pa.RecordBatch.from_arrays(
            [batch.column("page_id"), batch.column("url"), pa.array([payload_digest(p) for p in payloads]),
             pa.array([len(p) for p in payloads], pa.int64())], ["page_id", "url", "digest", "size"])

    rows = land(map_batches(html, digest, "page_id long, url string, digest string, size long"), "page-digests")
    owner = land(rows.where(F.col("size") >= min_bytes).groupBy("digest", "size")
                 .agg(F.max("page_id").alias("owner")), "payload-owners")
    # responses take their html by page id and digest, a key no payload makes hot; revisits need none
    joined = rows.join(owner, ["digest", "size"], "left")
    revisits = joined.where("page_id < owner")
    stored = html.join(owner.select("owner", F.col("digest").alias("_digest"), F.col("size").alias("_size")),
                       F.col("page_id") == F.col("owner"))

    def make(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        for page_id, url, payload, want in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "html", "_digest")),
                                               strict=True):
            found = payload_digest(payload)
            if want in (None, found):
                pid = None if page_id == NO_ID else page_id
                out += record_segments(pid, url, "response", None, payload, found, segment_bytes)
        return _bundles(out)

    def revisit(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        for page_id, url, found, size, owner_id in zip(*(batch.column(c).to_pylist() for c in
                                                          ("page_id", "url", "digest", "size", "owner")), strict=True):
            pid = None if page_id == NO_ID else page_id
            out += record_segments(pid, url, "revisit", owner_id, _Sized(size), found, segment_bytes)
        return _bundles(out)

    records = map_batches(stored.select("page_id", "url", "html", "_digest"), make, "records binary").union(
        map_batches(revisits.select("page_id", "url", "digest", "size", "owner"), revisit, "records binary"))
    if min_bytes > 0:
        small = html.where(F.octet_length("html") < min_bytes).withColumn("_digest", F.lit(None).cast("string"))
        records = records.union(map_batches(small.select("page_id", "url", "html", "_digest"), make, "records binary"))
    (records.select(F.col("records").cast("string").alias("value")).write.option("lineSep", _BETWEEN.decode())
     .option("maxRecordsPerFile", FILE_BUNDLES).option("compression", "gzip").text(path))


def _bundles(records: list[bytes]) -> pa.RecordBatch:
    """Rows of neighbouring records, with the separator between them."""
    rows: list[bytes] = []
    held: list[bytes] = []
    size = 0
    for k, record in enumerate(records, 1):
        held.append(record)
        size += len(record)
        if size >= BUNDLE_BYTES or k == len(records):
            rows.append(_BETWEEN.join(held))
            held, size = [], 0
    return pa.RecordBatch.from_arrays([pa.array(rows, pa.binary())], ["records"])


class _Sized(bytes):
    """An empty payload that reports the length of the payload a revisit stands for."""

    def __new__(cls, size: int) -> _Sized:
        self = super().__new__(cls)
        self.size = size
        return self

    def __len__(self) -> int:
        return self.size


def parse_records(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header fields in lower case, block) of the records of one uncompressed file."""
    at = 0
    while at < len(data):
        if not data.startswith(b"WARC/1.", at):
            raise ValueError("no WARC record where one should start")
        end = data.index(b"\r\n\r\n", at)
        lines = data[at:end].decode().split("\r\n")[1:]
        fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
        size = int(fields["content-length"])
        block = data[end + 4:end + 4 + size]
        if len(block) != size:
            raise ValueError("record cut short")
        yield fields, block
        at = end + 4 + size
        if data[at:at + 4] != b"\r\n\r\n":
            raise ValueError("no separator after a record")
        at += 4


def _inflate(parts: bytes) -> bytes:
    """All gzip members of a file."""
    out = []
    while parts:
        member = zlib.decompressobj(wbits=31)
        out.append(member.decompress(parts))
        parts = member.unused_data
    return b"".join(out)


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """Every record of the archive, segments as they are."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column("content"):
                rows, held = [], 0
                for f, block in parse_records(_inflate(content.as_py())):
                    number = lambda k, f=f: int(f[k]) if k in f else None
                    rows.append((f["warc-record-id"], f.get("warc-segment-origin-id", f["warc-record-id"]),
                                 number("warc-segment-number"), number("warc-segment-total-length"), f["warc-type"],
                                 number("x-page-id"), number("x-refers-to-page-id"),
                                 f.get("warc-payload-digest", "").removeprefix("sha1:"), number("x-payload-length"), block))
                    held += len(block)
                    if held > BATCH_BYTES:
                        yield _record_batch(rows)
                        rows, held = [], 0
                if rows:
                    yield _record_batch(rows)

    return files.select("content").mapInArrow(run, _RECORDS.replace("digest string", "digest string, length long"))


def _record_batch(rows: list[tuple]) -> pa.RecordBatch:
    types = (pa.string(), pa.string(), pa.int32(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(),
             pa.binary())
    names = ["id", "origin", "segment", "total", "type", "page_id", "refers_to", "digest", "length", "block"]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)


def reassemble(records: DataFrame) -> DataFrame:
    """Whole records: page_id, type, refers_to, digest, length, payload.

    Only segmented records are shuffled, by origin id. A stored record whose bytes do not give its
    digest, or a segmented one with a missing segment or another total length, fails the job.
    An id is one record's alone, so a group is never larger than one record.
    """
    whole = records.where("segment is null").select("type", "page_id", "refers_to", "digest", "length", "block")
    parts = records.where("segment is not null").groupBy("origin").agg(
        F.collect_list(F.struct("segment", "total", "block", "type", "page_id", "refers_to", "digest", "length")).alias("parts"))

    def join(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for origin, segments in zip(batch.column("origin").to_pylist(), batch.column("parts").to_pylist(), strict=True):
            segments.sort(key=lambda s: s["segment"])
            first, last = segments[0], segments[-1]
            block = b"".join(s["block"] for s in segments)
            if [s["segment"] for s in segments] != list(range(1, len(segments) + 1)) or last["total"] != len(block):
                raise ValueError(f"{origin}: segments do not make the record")
            rows.append((first["type"], first["page_id"], first["refers_to"], first["digest"], first["length"], block))
        types = (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.binary())
        names = ["type", "page_id", "refers_to", "digest", "length", "block"]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

    fields = "type string, page_id long, refers_to long, digest string, length long"
    both = whole.union(map_batches(parts, join, f"{fields}, block binary"))

    def decode(batch: pa.RecordBatch) -> pa.RecordBatch:
        payloads = []
        for kind, digest, length, block in zip(*(batch.column(c).to_pylist() for c in ("type", "digest", "length", "block")),
                                               strict=True):
            _, _, body = block.partition(b"\r\n\r\n")
            payload = unchunked(body) if kind == "response" else b""
            if kind == "response" and (payload_digest(payload) != digest or len(payload) != length):
                raise ValueError("payload does not give its digest")
            payloads.append(payload)
        names = ["type", "page_id", "refers_to", "digest", "length"]
        return pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(payloads, pa.binary())],
                                          [*names, "payload"])

    return map_batches(both, decode, f"{fields}, payload binary")


def archive_report(pages: DataFrame, min_bytes: int = 0, segment_bytes: int = SEGMENT_BYTES) -> DataFrame:
    """Write ``pages`` as an archive in the shared folder, read it back: one row per record.

    page_id, payload_bytes, payload_digest, record_type, refers_to.
    """
    path = scratch_path(pages.sparkSession, "warc")
    write_archive(pages, path, min_bytes, segment_bytes)
    records = reassemble(read_records(pages.sparkSession, path))
    return records.select("page_id", F.col("length").alias("payload_bytes"), F.col("digest").alias("payload_digest"),
                          F.col("type").alias("record_type"), "refers_to")
