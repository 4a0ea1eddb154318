"""WARC in seekable Zstandard bundles.

Records are gathered into independent Zstandard frames; a bundle is its frames and, as a skippable frame at the end, the
seek table of the public seekable format (compressed and raw size and checksum of each frame). Any Zstandard reader
unpacks a whole bundle; with the seek table and the index (record id to frame, offset in the frame, length) one record
costs one frame. Bundles are rows of a table that Spark writes and reads, so commits, retries and lost executors are Spark's.

Of records with equal payloads of at least ``REVISIT_FROM`` bytes the one with the smallest page id is the response, the others
revisit it. Equal payloads meet as counts per digest, never as payloads.

Results: a null payload is empty; a null url is written as ``about:blank``; line breaks in a url are percent-encoded; rows that
repeat a page id are each a record; a null page id stays null and is never referred to; an empty table gives no bundle and no record.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import fresh_path
from .arrow import over_batches

REVISIT_FROM = 100
FRAME_BYTES = 256 << 10
BUNDLE_BYTES = 8 << 20
LEVEL = 3
DATE = "2000-01-01T00:00:00Z"

# fixed values: the public seekable Zstandard format
SKIPPABLE, SEEKABLE, CHECKSUMS = 0x184D2A5E, 0x8F92EAB1, 0x80
# fixed values: the profile of a revisit in WARC 1.1
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

INDEX = "array<struct<record_id: string, frame: int, offset: int, length: int>>"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, size: int, refers_to: int | None) -> bytes:
    """A WARC/1.1 record; a revisit (``refers_to`` given) carries the HTTP head alone."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    target = "".join(f"%{ord(c):02X}" if c in "\r\n" else c for c in url) if url else "about:blank"
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{page_id}>",
            f"WARC-Date: {DATE}", f"WARC-Target-URI: {target}", f"WARC-Payload-Digest: sha256:{digest}"]
    if refers_to is not None:
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Profile: {REVISIT_PROFILE}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(raw: bytes) -> tuple[dict[str, str], bytes, bytes]:
    """(WARC fields in lower case, HTTP head, payload) of a record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode("utf-8").split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError("not a WARC/1.1 record")
    fields = {k.lower(): v for k, v in (x.split(": ", 1) for x in lines[1:])}
    block = rest[:int(fields["content-length"])]
    if rest[len(block):] != b"\r\n\r\n":
        raise ValueError("a record does not end where its length says")
    http, _, payload = block.partition(b"\r\n\r\n")
    return fields, http, payload


class Bundle:
    """Gathers records into frames and frames into one archive."""

    def __init__(self):
        import zstandard

        self.packer = zstandard.ZstdCompressor(level=LEVEL)
        self.frames: list[bytes] = []
        self.table: list[tuple[int, int, int]] = []
        self.index: list[tuple[str, int, int, int]] = []
        self.open, self.size = bytearray(), 0

    def add(self, record_id: str, raw: bytes) -> None:
        if self.open and len(self.open) + len(raw) > FRAME_BYTES:
            self.close_frame()
        self.index.append((record_id, len(self.frames), len(self.open), len(raw)))
        self.open += raw

    def close_frame(self) -> None:
        import xxhash

        if self.open:
            packed = self.packer.compress(bytes(self.open))
            self.table.append((len(packed), len(self.open), xxhash.xxh64_intdigest(bytes(self.open)) & 0xFFFFFFFF))
            self.frames.append(packed)
            self.size += len(packed)
            self.open = bytearray()

    def data(self) -> bytes:
        self.close_frame()
        body = b"".join(struct.pack("<III", *x) for x in self.table) + struct.pack("<IBI", len(self.table), CHECKSUMS, SEEKABLE)
        return b"".join(self.frames) + struct.pack("<II", SKIPPABLE, len(body)) + body


class Seekable:
    """Reads single frames of a bundle by its seek table."""

    def __init__(self, data: bytes):
        import zstandard

        count, flags, magic = struct.unpack("<IBI", data[-9:])
        if magic != SEEKABLE:
            raise ValueError("no seek table")
        width = 12 if flags & CHECKSUMS else 8
        body = data[-9 - count * width:-9]
        if struct.unpack("<II", data[-17 - count * width:-9 - count * width]) != (SKIPPABLE, len(body) + 9):
            raise ValueError("the seek table is damaged")
        self.data, self.unpacker, self.at, start = data, zstandard.ZstdDecompressor(), [], 0
        for i in range(count):
            packed, raw = struct.unpack_from("<II", body, i * width)
            check = struct.unpack_from("<I", body, i * width + 8)[0] if width == 12 else None
            self.at.append((start, packed, raw, check))
            start += packed
        self.held = (-1, b"")

    def frame(self, i: int) -> bytes:
        import xxhash

        if self.held[0] != i:
            start, packed, raw, check = self.at[i]
            out = self.unpacker.decompress(self.data[start:start + packed], max_output_size=raw)
            if len(out) != raw or check is not None and xxhash.xxh64_intdigest(out) & 0xFFFFFFFF != check:
                raise ValueError(f"frame {i} is damaged")
            self.held = (i, out)
        return self.held[1]

    def record(self, frame: int, offset: int, length: int) -> bytes:
        return self.frame(frame)[offset:offset + length]


def bundles(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """(bundle, data, index): a record per row of ``pages``, in bundles of about ``BUNDLE_BYTES``."""
    payload = F.coalesce(F.col(payload_col).cast("binary"), F.lit("").cast("binary"))
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), payload.alias("payload")).withColumns(
        {"digest": F.sha2("payload", 256), "size": F.octet_length("payload")})
    shared = (
        rows.filter(F.col("size") >= REVISIT_FROM).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
        .filter("n > 1 AND first IS NOT NULL").select(F.col("digest").alias("_digest"), "first")
    )
    named = rows.join(shared, F.col("digest") == F.col("_digest"), "left").withColumn(
        "refers_to", F.expr("CASE WHEN first <> page_id OR page_id IS NULL THEN first END")).select(
        "page_id", "url", "payload", "digest", "size", "refers_to")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number, bundle = TaskContext.get().partitionId(), 0, Bundle()

        def close():
            name = f"{part:06d}-{number:06d}.warc.zst"
            index = pa.array([[dict(zip(("record_id", "frame", "offset", "length"), x)) for x in bundle.index]], pa.list_(pa.struct(
                [("record_id", pa.string()), ("frame", pa.int32()), ("offset", pa.int32()), ("length", pa.int32())])))
            return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([bundle.data()], pa.binary()), index], ["bundle", "data", "index"])

        for b in batches:
            for page_id, url, payload, digest, size, refers in zip(*(b.column(c) for c in ("page_id", "url", "payload", "digest", "size", "refers_to"))):
                page = page_id.as_py()
                bundle.add(f"<urn:page:{page}>", record(page, url.as_py(), payload.as_py(), digest.as_py(), size.as_py(), refers.as_py()))
                if bundle.size >= BUNDLE_BYTES:
                    yield close()
                    number, bundle = number + 1, Bundle()
        if bundle.index:
            yield close()

    return over_batches(named, write, f"bundle string, data binary, index {INDEX}")


def _number(urn: str | None) -> int | None:
    text = (urn or "<urn:page:None>")[len("<urn:page:"):-1]
    return None if text == "None" else int(text)


def records(archives: DataFrame, wanted: list[str] | None = None) -> DataFrame:
    """(page_id, url, payload, payload_bytes, payload_digest, record_type, refers_to) per record of ``archives``.

    ``wanted`` names record ids to read; only frames that hold one of them are unpacked. The payload of a revisit is
    null. Every response is held against its digest.
    """
    names = frozenset(wanted) if wanted is not None else None
    rows = archives.select("data", "index")
    if wanted is not None:
        rows = rows.filter(F.arrays_overlap(F.col("index.record_id"), F.array(*[F.lit(x) for x in wanted])))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload", pa.binary()), ("payload_bytes", pa.int64()),
                            ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])
        for b in batches:
            for data, index in zip(b.column("data"), b.column("index")):
                archive, out, size = Seekable(data.as_py()), [], 0
                for x in index.as_py():
                    if names is not None and x["record_id"] not in names:
                        continue
                    fields, http, payload = parse(archive.record(x["frame"], x["offset"], x["length"]))
                    length = int(dict(h.split(": ", 1) for h in http.decode().split("\r\n")[1:])["Content-Length"])
                    digest = fields["warc-payload-digest"].removeprefix("sha256:")
                    kind = fields["warc-type"]
                    if kind == "response" and hashlib.sha256(payload).hexdigest() != digest:
                        raise ValueError(f"the payload of {x['record_id']} does not match its digest")
                    url = fields["warc-target-uri"]
                    out.append((_number(fields["warc-record-id"]), None if url == "about:blank" else url, payload if kind == "response" else None,
                                length, digest, kind, _number(fields.get("warc-refers-to"))))
                    size += len(payload)
                    if size > BUNDLE_BYTES:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), schema.types)], schema=schema)
                        out, size = [], 0
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), schema.types)], schema=schema)

    return over_batches(rows, read, "page_id long, url string, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to long")


def stored(archives: DataFrame, path: str | None = None) -> DataFrame:
    """Writes ``archives`` to ``path`` (a new one in the shared folder by default) and gives the table back as read from there."""
    spark = archives.sparkSession
    path = path or fresh_path(spark, "warc")
    archives.write.parquet(path)
    return spark.read.schema(archives.schema).parquet(path)
