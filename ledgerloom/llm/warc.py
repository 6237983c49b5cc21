"""WARC volumes: a writer with revisit records, and a reader that salvages what damage leaves.

Volumes are rows of a table (``volume string, content binary``), so they live in any store that
Spark reaches. ``files_as_volumes`` reads archives that are files.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import as_bytes, map_batches

#: Records with payloads below this many bytes are never revisits.
MIN_REVISIT = 1000
#: A volume is closed once it has this many bytes; only a single larger record exceeds it by much.
VOLUME_BYTES = 4 << 20
GZIP_LEVEL = 1
#: Compressed bytes given to the decompressor at once.
CHUNK = 1 << 14

VERSION = b"WARC/1.1"
MAGIC = b"\x1f\x8b\x08"
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
NO_ID = "none"
#: Fields that every record has, in lower case.
MANDATORY = ("warc-type", "warc-record-id", "warc-date", "content-length")


# --------------------------------------------------------------------------- writing


def revisits(pages: DataFrame) -> DataFrame:
    """``page_id, url, payload, digest, n_bytes, refers_to``: refers_to is null for responses.

    Of equal payloads of MIN_REVISIT bytes or more that with the largest page_id is the response (all rows
    of that page_id, if it is repeated). Only digests that occur twice get a row in the joined
    side; counting combines before its shuffle, and the join is one whose large partitions Spark can split.

    Null html is an empty payload, null urls and page_ids stay null (a null page_id is never the response others refer to, unless all
    of its payload's are null; then each is a response). Repeated rows repeat, an empty table gives none, other columns are ignored.
    """
    p = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.coalesce(F.col("html"), F.lit("")).cast("binary").alias("payload"))
    p = p.select("*", F.sha1("payload").alias("digest"), F.octet_length("payload").cast("long").alias("n_bytes"))
    keepers = p.where(F.col("n_bytes") >= MIN_REVISIT).groupBy("digest").agg(F.max("page_id").alias("keeper"), F.count(F.lit(1)).alias("n")).where("n > 1").select("digest", "keeper")
    return p.join(keepers, "digest", "left").select(
        "page_id", "url", "payload", "digest", "n_bytes", F.when(~F.col("page_id").eqNullSafe(F.col("keeper")), F.col("keeper")).alias("refers_to")
    )


def _line(text: object) -> bytes:
    """A header value: line ends are percent-encoded, as they would end it."""
    return as_bytes(str(text)).replace(b"\r", b"%0D").replace(b"\n", b"%0A")


def make_record(page_id: int | None, url: str | None, payload: bytes, digest: str, n_bytes: int, refers_to: int | None) -> bytes:
    """One record. A revisit's block has the HTTP header alone, whose Content-Length is the full payload's."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % n_bytes
    block = http if refers_to is not None else http + payload
    name = NO_ID if page_id is None else page_id
    head = [
        VERSION,
        b"WARC-Type: " + (b"response" if refers_to is None else b"revisit"),
        b"WARC-Record-ID: <urn:page:%s>" % _line(name),
        b"WARC-Date: " + DATE.encode(),
        b"WARC-Target-URI: " + _line(url or ""),
        b"Content-Type: application/http;msgtype=response",
        b"WARC-Payload-Digest: sha1:" + digest.encode(),
        b"WARC-Block-Digest: sha1:" + hashlib.sha1(block).hexdigest().encode(),
    ]
    if refers_to is not None:
        head += [b"WARC-Refers-To: <urn:page:%d>" % refers_to, b"WARC-Profile: " + PROFILE.encode()]
    head.append(b"Content-Length: %d" % len(block))
    return b"\r\n".join(head) + b"\r\n\r\n" + block + b"\r\n\r\n"


def gzip_member(data: bytes) -> bytes:
    z = zlib.compressobj(GZIP_LEVEL, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def write_volumes(records: DataFrame, compress: bool = True) -> DataFrame:
    """``volume, content``: each record a gzip member of its own (or plain), about VOLUME_BYTES a volume.

    Takes the columns of ``revisits``; others are ignored. Map-only; a worker holds one volume, which a very long payload exceeds alone.
    No rows make no volume.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, n, held = TaskContext.get().partitionId(), 0, bytearray()
        out = lambda: pa.RecordBatch.from_arrays([pa.array([f"{task:06d}-{n:06d}"]), pa.array([bytes(held)], pa.binary())], names=["volume", "content"])
        for batch in batches:
            for row in batch.to_pylist():
                record = make_record(row["page_id"], row["url"], row["payload"], row["digest"], row["n_bytes"], row["refers_to"])
                held += gzip_member(record) if compress else record
                if len(held) >= VOLUME_BYTES:
                    yield out()
                    n, held = n + 1, bytearray()
        if held:
            yield out()

    return map_batches(records.select("page_id", "url", "payload", "digest", "n_bytes", "refers_to"), run, "volume string, content binary")


def files_as_volumes(spark: SparkSession, path: str) -> DataFrame:
    """Archive files (.warc, .warc.gz) as volumes named by their paths."""
    return spark.read.format("binaryFile").load(path).select(F.col("path").alias("volume"), "content")


# --------------------------------------------------------------------------- reading


@dataclass
class Found:
    """A record at a byte range of its volume, or a gap: a range without a valid record and the first failure in it.

    What is inside a gzip member has the member's range (up to the next start, if the member is broken), and its own in the member's plain bytes.
    """

    start: int
    end: int
    reason: str | None = None
    inner_start: int | None = None
    inner_end: int | None = None
    headers: dict[str, str] = field(default_factory=dict)
    block: bytes = b""


class Damaged(ValueError):
    pass


def parse_record(data: bytes, at: int) -> tuple[Found, int]:
    """The record whose version line is at ``at``, and where it ends. Raises Damaged if any check fails."""
    if data[at : at + 7] != b"WARC/1.":
        raise Damaged("no version line")
    stop = data.find(b"\r\n\r\n", at)
    if stop < 0:
        raise Damaged("header doesn't end")
    headers = {}
    for line in data[at:stop].split(b"\r\n")[1:]:
        name, colon, value = line.partition(b":")
        if not colon:
            raise Damaged("bad header line")
        headers[name.strip().lower().decode("latin-1")] = value.strip().decode("utf-8", "replace")
    if not all(headers.get(name) for name in MANDATORY):
        raise Damaged("mandatory field missing")
    length = headers["content-length"]
    if not length.isascii() or not length.isdigit():
        raise Damaged("bad content length")
    body = stop + 4
    end = body + int(length)
    if data[end : end + 4] != b"\r\n\r\n":
        raise Damaged("record end isn't where its length says")
    block = data[body:end]
    digest = headers.get("warc-block-digest", "")
    if digest.startswith("sha1:") and len(digest) == 45 and digest[5:].lower() != hashlib.sha1(block).hexdigest():
        raise Damaged("block digest differs")
    return Found(at, end + 4, headers=headers, block=block), end + 4


def _member(data: bytes, at: int) -> tuple[bytes, int, str | None]:
    """The plain bytes of the gzip member at ``at``, where it ends, and what is wrong with it.

    Of a broken member, all bytes that the decompressor gives before it fails: the failing part is given again byte by byte.
    """
    view, first = memoryview(data), at

    def inflate(step: int, until: int) -> tuple[list[bytes], int, object, str | None]:
        z, plain, here = zlib.decompressobj(31), [], first
        while not z.eof and here < len(data):
            size = CHUNK if here + CHUNK <= until else step
            try:
                plain.append(z.decompress(view[here : here + size]))
            except zlib.error as e:
                return plain, here, z, "gzip: " + str(e)
            here += size
        return plain, min(here, len(data)), z, None if z.eof else "gzip member doesn't end"

    plain, here, z, reason = inflate(CHUNK, len(data))
    if reason and reason.startswith("gzip: "):
        plain, here, z, reason = inflate(1, here)
    return b"".join(plain), here if reason else here - len(z.unused_data), reason


def _next_start(data: bytes, at: int) -> int:
    """The next place from ``at`` on that looks like a member or a version line; damage can have joined that to what precedes it."""
    return min((p for p in (data.find(MAGIC, at), data.find(b"WARC/1.", at)) if p >= 0), default=len(data))


def _plain_records(plain: bytes) -> Iterator[Found]:
    """Records and gaps of plain bytes; after a failed check the next version line is tried."""
    at, gap = 0, None
    while at < len(plain):
        try:
            one, end = parse_record(plain, at)
        except Damaged as e:
            end = plain.find(b"WARC/1.", at + 1)
            end = len(plain) if end < 0 else end
            gap = gap or Found(at, at, str(e))
            gap.end = end
        else:
            if gap is not None:
                yield gap
                gap = None
            yield one
        at = end
    if gap is not None:
        yield gap


def _inside(parts: list[Found], at: int, end: int) -> Iterator[Found]:
    for one in parts:
        one.inner_start, one.inner_end, one.start, one.end = one.start, one.end, at, end
        yield one


def salvage(data: bytes) -> Iterator[Found]:
    """All valid records in order; each range between them is one gap with the first failure's reason.

    A gzip member may hold many records: those that are valid in it come out whatever is wrong with others, with its checksum
    or with its end. Gaps inside a member say so by their inner range; a broken member is a gap itself, from its first byte on.
    """
    at = 0
    gap: Found | None = None
    while at < len(data):
        inner: list[Found] = []
        try:
            if data[at : at + 3] == MAGIC:
                plain, end, reason = _member(data, at)
                inner = list(_plain_records(plain))
                if not any(f.reason is None for f in inner):
                    raise Damaged(reason or (inner[0].reason if inner else "gzip member is empty"))
                if reason:  # where it would have ended is unknown
                    end = _next_start(data, at + 1)
            else:
                one, end = parse_record(data, at)
                inner, reason = [one], None
        except Damaged as e:
            if gap is None:
                gap = Found(at, at, str(e))
            at = _next_start(data, at + 1)
            gap.end = at
            continue
        if gap is not None:
            yield gap
            gap = None
        if data[at : at + 3] == MAGIC:
            yield from _inside(inner, at, end)
            if reason:
                gap = Found(at, end, reason)
        else:
            yield inner[0]
        at = end
    if gap is not None:
        yield gap


def _id(value: str | None) -> int | None:
    tail = (value or "").removeprefix("<urn:page:").removesuffix(">")
    return int(tail) if tail.lstrip("-").isdigit() else None


READ_SCHEMA = (
    "volume string, start long, end long, inner_start long, inner_end long, gap string, record_type string, page_id long, url string, refers_to long, "
    "payload_digest string, payload_bytes long, payload binary"
)


def _row(volume: str, f: Found, with_payload: bool) -> tuple:
    if f.reason is not None:
        return (volume, f.start, f.end, f.inner_start, f.inner_end, f.reason, *[None] * 7)
    h, (http, _, payload) = f.headers, f.block.partition(b"\r\n\r\n")
    kind = h.get("warc-type")
    if kind == "revisit":
        digest = h.get("warc-payload-digest", "").removeprefix("sha1:").lower()
        sizes = [x.split(b":")[1].strip() for x in http.lower().split(b"\r\n") if x.startswith(b"content-length:")]
        n = int(sizes[0]) if sizes and sizes[0].isdigit() else None
        payload = None
    else:
        digest, n = hashlib.sha1(payload).hexdigest(), len(payload)
    return (volume, f.start, f.end, f.inner_start, f.inner_end, None, kind, _id(h.get("warc-record-id")), h.get("warc-target-uri"), _id(h.get("warc-refers-to")), digest, n, payload if with_payload else None)


def read_volumes(volumes: DataFrame, with_payload: bool = True) -> DataFrame:
    """A row for each record, and for each quarantined gap (``gap`` has the reason, start and end its bytes, inner_start and inner_end its
    bytes in a member's plain ones).

    Responses' lengths and digests are computed from what was read; revisits' are those of the response that
    they name, from their headers. Null and empty content has no rows, an empty table none either; a null volume name stays null,
    repeated rows repeat, other columns are ignored. A worker holds one volume and one member's plain bytes.
    """
    kinds = [pa.string(), *[pa.int64()] * 4, pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary()]
    names = [x.split()[0] for x in READ_SCHEMA.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                volume, content = batch.column(0)[i].as_py(), batch.column(1)[i].as_py()
                rows = [_row(volume, f, with_payload) for f in salvage(content or b"")]
                for k in range(0, len(rows), 1000):
                    cols = zip(*rows[k : k + 1000], strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, kinds, strict=True)], names=names)

    return map_batches(volumes.select("volume", "content"), run, READ_SCHEMA)
