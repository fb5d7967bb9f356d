"""WARC archives as seekable Zstandard bundles.

Each task writes one bundle or more: WARC records are grouped into independent
Zstandard frames, and a skippable frame at the end holds a seek table with the
sizes of all frames (the public seekable format). An index maps each record to
its bundle, frame and offset inside the frame, so one record is read by
decompressing one frame.

Bundles are written under names that no other attempt uses and the index is
written to the shared folder from the tasks that succeeded, so a lost executor
or a repeated task leaves an unlisted file behind and nothing else.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Workspace, ship

#: Fixed values of the seekable format.
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
NAMESPACE = uuid.UUID("6f0c2f7e-7f7a-4a55-9a35-5d1f7ad0c3a1")
FRAME_BYTES, BUNDLE_BYTES, FRAMES_A_TASK = 1 << 18, 1 << 28, 64


#: Schemes of Hadoop's connectors and the names that Arrow has for the same stores.
SCHEMES = {"s3a": "s3", "s3n": "s3", "gs": "gs", "hdfs": "hdfs", "viewfs": "viewfs", "abfss": "abfss", "file": "file", "s3": "s3"}


def file_system(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system and path of a URI or a plain path; a scheme that Arrow can't write is an error that names it."""
    if uri.startswith("file:/") and not uri.startswith("file://"):
        uri = "file://" + uri[5:]
    scheme, found, rest = uri.partition("://")
    if found and scheme not in SCHEMES:
        raise ValueError(f"WARC bundles can't be written to {scheme}://; give a folder= of one of {', '.join(SCHEMES)}")
    return pafs.FileSystem.from_uri(f"{SCHEMES[scheme]}://{rest}" if found else uri)


def digest32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page: int | None, salt: str) -> str:
    """The name of a response follows from its page id alone, so that revisits can refer to it."""
    return f"<urn:uuid:{uuid.uuid5(NAMESPACE, f'page:{page}' if page is not None and not salt else f'{page}:{salt}')}>"


def _clean(value: str | None) -> str:
    return "".join(f"%{ord(c):02X}" if c < " " or c == "\x7f" else c for c in value or "")


def encode_record(page: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool, salt: str, date: str) -> bytes:
    """One WARC/1.1 record: an HTTP response with its payload, or a revisit with the HTTP head only."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head if revisit else head + payload
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {record_id(page, salt)}", f"WARC-Date: {date}", f"WARC-Target-URI: {_clean(url)}", f"WARC-Payload-Digest: sha1:{digest32(payload)}", "Content-Type: application/http; msgtype=response"]
    if page is not None:
        lines.append(f"X-Page-Id: {page}")
    if revisit:
        lines.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
        if refers_to is not None:
            lines += [f"WARC-Refers-To: {record_id(refers_to, '')}", f"X-Refers-To-Page: {refers_to}"]
    lines.append(f"Content-Length: {len(block)}")
    return "\r\n".join(lines).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n"


def decode_records(data: bytes) -> Iterator[dict]:
    """The records of one frame: their headers (lower-case names), offset, payload and the payload's declared size."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        version, *lines = data[at:end].decode("utf-8", "surrogatepass").split("\r\n")
        if version != "WARC/1.1":
            raise ValueError(f"no WARC record at {at}")
        headers = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines)}
        start, size = end + 4, int(headers["content-length"])
        block = data[start : start + size]
        http, _, payload = block.partition(b"\r\n\r\n")
        length = next(int(x.partition(b": ")[2]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length: "))
        yield {"headers": headers, "offset": at, "payload": payload, "payload_bytes": length}
        at = start + size + 4


class BundleWriter:
    """Writes frames one after another; only the current frame is held in memory."""

    def __init__(self, uri: str, level: int = 3):
        self.fs, path = file_system(uri)
        self.final, self.temporary = path, f"{path}.part"
        self.out = self.fs.open_output_stream(self.temporary)
        self.zip, self.table, self.frame, self.size = zstandard.ZstdCompressor(level=level), [], [], 0
        self.written = 0

    def add(self, record: bytes) -> tuple[int, int]:
        """Frame and offset of the record."""
        if self.size and self.size + len(record) > FRAME_BYTES:
            self.flush()
        at = self.size
        self.frame.append(record)
        self.size += len(record)
        return len(self.table), at

    def flush(self) -> None:
        if self.frame:
            packed = self.zip.compress(b"".join(self.frame))
            self.out.write(packed)
            self.table.append((len(packed), self.size))
            self.written += len(packed)
            self.frame, self.size = [], 0

    def close(self) -> None:
        self.flush()
        body = b"".join(struct.pack("<II", *x) for x in self.table) + struct.pack("<IBI", len(self.table), 0, SEEKABLE)
        self.out.write(struct.pack("<II", SKIPPABLE, len(body)) + body)
        self.out.close()
        self.fs.move(self.temporary, self.final)


class BundleReader:
    """Random access to the frames of a bundle by its seek table."""

    def __init__(self, uri: str):
        self.fs, path = file_system(uri)
        self.file = self.fs.open_input_file(path)
        end = self.file.size()
        frames, _, magic = struct.unpack("<IBI", self.file.read_at(9, end - 9))
        if magic != SEEKABLE:
            raise ValueError(f"{uri} has no seek table")
        sizes = list(struct.iter_unpack("<II", self.file.read_at(8 * frames, end - 9 - 8 * frames)))
        self.frames, at = [], 0
        for packed, size in sizes:
            self.frames.append((at, packed, size))
            at += packed

    def frame(self, number: int) -> bytes:
        at, packed, size = self.frames[number]
        return zstandard.ZstdDecompressor().decompress(self.file.read_at(packed, at), max_output_size=max(1, size))

    def record(self, frame: int, offset: int) -> dict:
        return next(decode_records(self.frame(frame)[offset:]))

    def close(self) -> None:
        self.file.close()


def mark_revisits(pages: DataFrame, least_bytes: int = 0, page_id: str = "page_id", url: str = "url", html: str = "html", most_broadcast: int = 100_000) -> DataFrame:
    """page_id, url, payload, refers_to, revisit for each row of ``pages``.

    Payloads are equal if their SHA-256 digests and sizes are. Only groups of
    two or more are joined back: broadcast up to ``most_broadcast`` groups,
    otherwise by a shuffle that AQE splits where a group is large.
    """
    rows = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), F.coalesce(F.col(html), F.lit("")).cast("binary").alias("payload"))
    keyed = rows.withColumn("_d", F.sha2("payload", 256)).withColumn("_b", F.octet_length("payload"))
    groups = Workspace(pages.sparkSession, "payloads").stored(keyed.groupBy("_d", "_b").agg(F.min("page_id").alias("_first"), F.count(F.lit(1)).alias("_n")).where((F.col("_n") > 1) & (F.col("_b") >= least_bytes)).select("_d", "_b", "_first"), "payloads")
    small = groups.count() <= most_broadcast
    joined = keyed.join(F.broadcast(groups) if small else groups, ["_d", "_b"], "left")
    revisit = F.col("_first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("_first"))
    return joined.select("page_id", "url", "payload", F.when(revisit, F.col("_first")).alias("refers_to"), revisit.alias("revisit"))


def write_bundles(marked: DataFrame, folder: str, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Write the rows of ``mark_revisits`` as bundles below ``folder``; returns the index.

    The index has page_id, bundle, frame, offset and length of each record.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer, name = None, ""
        for batch in batches:
            found: list[tuple] = []
            for page, url, payload, refers, revisit in zip(*(batch.column(i) for i in range(5)), strict=True):
                if writer is None:
                    name = f"{folder}/{uuid.uuid4().hex}.warc.zst"
                    writer, number = BundleWriter(name), 0
                page, again = page.as_py(), revisit.as_py()
                salt = f"{name}:{number}" if again or page is None else ""
                record = encode_record(page, url.as_py(), payload.as_py(), refers.as_py(), again, salt, date)
                frame, offset = writer.add(record)
                found.append((page, name, frame, offset, len(record)))
                number += 1
                if writer.written >= BUNDLE_BYTES:
                    writer.close()
                    writer = None
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*found, strict=True), (pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.int64()), strict=True)] if found else [pa.array([], k) for k in (pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.int64())], ["page_id", "bundle", "frame", "offset", "length"])
        if writer is not None:
            writer.close()

    ship(marked.sparkSession)
    fs, path = file_system(folder)
    fs.create_dir(path, recursive=True)
    given = marked.select(F.col("page_id").cast("long"), "url", "payload", F.col("refers_to").cast("long"), "revisit")
    return Workspace(marked.sparkSession, "warc-index").stored(given.mapInArrow(run, "page_id long, bundle string, frame int, offset long, length long"), "index")


def read_bundles(index: DataFrame) -> DataFrame:
    """All records of the bundles an index names: page_id, url, payload_bytes, payload_digest, record_type, refers_to.

    The work is dealt in runs of frames, found by the seek tables. A response
    whose payload doesn't match its digest or size raises an error.
    """
    ship(index.sparkSession)
    runs = index.groupBy("bundle").agg(F.max("frame").alias("last")).select("bundle", F.explode(F.sequence(F.lit(0), F.col("last"), F.lit(FRAMES_A_TASK))).alias("first"))
    names, kinds = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to"], [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64()]

    def rows(bundle: str, first: int) -> Iterator[pa.RecordBatch]:
        reader = BundleReader(bundle)
        for number in range(first, min(first + FRAMES_A_TASK, len(reader.frames))):
            found: list[tuple] = []
            for r in decode_records(reader.frame(number)):
                h = r["headers"]
                digest = h["warc-payload-digest"].removeprefix("sha1:")
                if h["warc-type"] == "response" and (len(r["payload"]) != r["payload_bytes"] or digest32(r["payload"]) != digest):
                    raise ValueError(f"{bundle}, frame {number}: a payload doesn't match its digest")
                whole = lambda name, h=h: int(h[name]) if name in h else None
                found.append((whole("x-page-id"), h["warc-target-uri"], r["payload_bytes"], digest, h["warc-type"], whole("x-refers-to-page")))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*found, strict=True), kinds, strict=True)], names)
        reader.close()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for bundle, first in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                yield from rows(bundle, first)

    return runs.repartition(F.col("bundle"), F.col("first")).mapInArrow(run, "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long")


def archive(pages: DataFrame, folder: str | None = None, least_bytes: int = 0, page_id: str = "page_id", url: str = "url", html: str = "html") -> tuple[DataFrame, DataFrame]:
    """Write ``pages`` as bundles and return (index, the records read back).

    Of records with equal payloads of at least ``least_bytes`` the one with the
    smallest id is the response, the others are revisits of it.

    Edge cases: null html is an empty payload; a row with a null id is a revisit
    if an equal payload has an id, else a response; rows that repeat the smallest
    id of a payload are all responses; control characters in URLs are
    percent-encoded; an empty table writes no bundle; other columns are ignored.
    Ids are integers.
    """
    folder = folder or Workspace(pages.sparkSession, "warc").folder
    index = write_bundles(mark_revisits(pages, least_bytes, page_id, url, html), folder)
    return index, read_bundles(index)
