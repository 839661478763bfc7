"""WARC records in ZIP-packaged archives: a writer, and a reader that never extracts.

A task writes archives into the shared folder, each a ZIP file with two stored members: the records (one gzip member
each, so that any can be read alone) and an index with the place of each record. An archive is closed at ARCHIVE_BYTES or
ARCHIVE_RECORDS, which bounds its index. Names are unique for each attempt and only the attempts that a written
manifest lists are read, so a repeated task leaves an orphan but never a second copy.

The reader parses the end-of-directory record, its ZIP64 locator and record, the central directory with ZIP64 fields, and the
local header that tells where a stored member begins. It reads the index member, and then ranges of whole records.

Defined results: a null html is an empty payload; records of equal payloads of at least `least` bytes refer to the one with the
largest page_id, and repeated rows of that page_id are all responses; a null page_id is kept, and revisits unless all
pages with its payload have none; a null url has no target line.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import json
import struct
import uuid
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veristrata.llm.common import fresh_path, lean, materialise, open_uri, partitions

ARCHIVE_BYTES = 32 << 20
ARCHIVE_RECORDS = 20_000
#: Bytes of records that are read at once.
RANGE_BYTES = 4 << 20
RECORDS, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
DATE = "2024-01-01T00:00:00Z"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_ID = "urn:veristrata:page:"


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _line(text: str) -> str:
    return "".join(c if c.isprintable() else "".join(f"%{b:02X}" for b in c.encode()) for c in text)


def warc_record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """A response, or with refers_to a revisit, which has the HTTP header but not the payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <{_ID}{'' if page_id is None else page_id}>", f"WARC-Date: {DATE}"]
    if url is not None:
        head.append(f"WARC-Target-URI: {_line(url)}")
    head.append(f"WARC-Payload-Digest: sha1:{payload_digest(payload)}")
    if refers_to is not None:
        head += [f"WARC-Profile: {_PROFILE}", f"WARC-Refers-To: <{_ID}{refers_to}>"]
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(data: bytes) -> dict:
    """Header fields by lower-case name, and the block."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    out = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines[1:])}
    return out | {"block": rest[: int(out["content-length"])]}


class ArchiveWriter:
    """One archive at a time in a folder; closed ones are listed as (path, records)."""

    def __init__(self, folder: str, most_bytes: int = ARCHIVE_BYTES, most_records: int = ARCHIVE_RECORDS):
        self.folder, self.most_bytes, self.most_records = folder, most_bytes, most_records
        self.closed: list[tuple[str, int]] = []
        self.file = None

    def _open(self) -> None:
        self.path = f"{self.folder}/{uuid.uuid4().hex}.wacz"
        system, path = open_uri(self.path)
        self.file = system.open_output_stream(path)
        self.zip = zipfile.ZipFile(self.file, "w", zipfile.ZIP_STORED, allowZip64=True)
        self.member = self.zip.open(RECORDS, "w", force_zip64=True)
        self.index: list[str] = []
        self.size = 0

    def add(self, page_id: int | None, record: bytes) -> None:
        if self.file is None:
            self._open()
        packed = gzip.compress(record, 6, mtime=0)
        self.member.write(packed)
        self.index.append(json.dumps({"page": page_id, "offset": self.size, "length": len(packed)}))
        self.size += len(packed)
        if self.size >= self.most_bytes or len(self.index) >= self.most_records:
            self.close()

    def close(self) -> None:
        if self.file is None:
            return
        self.member.close()
        self.zip.writestr(INDEX, "\n".join(self.index))
        self.zip.close()
        self.file.close()
        self.closed.append((self.path, len(self.index)))
        self.file = None


class ZipDirectory:
    """Where the stored members of a ZIP file lie; read(offset, size) gives its bytes."""

    def __init__(self, read, size: int):
        self.read = read
        tail_at = max(0, size - 65_557)
        tail = read(tail_at, size - tail_at)
        at = tail.rfind(b"PK\x05\x06")
        # a comment may hold the same four bytes: the true record's comment ends the file
        while at >= 0 and at + 22 + int.from_bytes(tail[at + 20 : at + 22], "little") != len(tail):
            at = tail.rfind(b"PK\x05\x06", 0, at)
        if at < 0:
            raise ValueError("no end of central directory")
        count, length, start = struct.unpack("<HII", tail[at + 10 : at + 20])
        if at >= 20 and tail[at - 20 : at - 16] == b"PK\x06\x07":
            place = struct.unpack("<Q", tail[at - 12 : at - 4])[0]
            end = read(place, 56)
            if end[:4] != b"PK\x06\x06":
                raise ValueError("no ZIP64 end of central directory")
            count, length, start = struct.unpack("<QQQ", end[32:56])
        self.members: dict[str, tuple[int, int]] = {}
        data, at = read(start, length), 0
        for _ in range(count):
            if data[at : at + 4] != b"PK\x01\x02":
                raise ValueError("broken central directory")
            method, packed, whole, names, extras, comments, offset = (struct.unpack("<H", data[at + 10 : at + 12])[0], *struct.unpack("<II", data[at + 20 : at + 28]), *struct.unpack("<HHH", data[at + 28 : at + 34]), struct.unpack("<I", data[at + 42 : at + 46])[0])
            name = data[at + 46 : at + 46 + names].decode()
            extra = data[at + 46 + names : at + 46 + names + extras]
            packed, offset = self._wide(extra, whole, packed, offset)
            if method == 0:
                self.members[name] = (offset, packed)
            at += 46 + names + extras + comments

    @staticmethod
    def _wide(extra: bytes, whole: int, packed: int, offset: int) -> tuple[int, int]:
        """Sizes and places of 0xFFFFFFFF stand in the ZIP64 field, in this order and only if they are so marked."""
        at = 0
        while at + 4 <= len(extra):
            kind, size = struct.unpack("<HH", extra[at : at + 4])
            if kind == 1:
                values = iter(struct.unpack(f"<{size // 8}Q", extra[at + 4 : at + 4 + size // 8 * 8]))
                if whole == 0xFFFFFFFF:
                    next(values)
                packed = next(values) if packed == 0xFFFFFFFF else packed
                offset = next(values) if offset == 0xFFFFFFFF else offset
            at += 4 + size
        return packed, offset

    def locate(self, name: str) -> tuple[int, int]:
        """(first byte, size) of a stored member."""
        offset, size = self.members[name]
        head = self.read(offset, 30)
        if head[:4] != b"PK\x03\x04":
            raise ValueError("no local header")
        names, extras = struct.unpack("<HH", head[26:30])
        return offset + 30 + names + extras, size


def _opened(path: str):
    system, own = open_uri(path)
    file = system.open_input_file(own)
    return file, lambda at, size: file.read_at(size, at)


def _writer(folder: str):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = ArchiveWriter(folder)
        for batch in batches:
            for page, url, html, refers in zip(*(c for c in batch.columns)):
                page, refers = page.as_py(), refers.as_py()
                out.add(page, warc_record(page, url.as_py(), html.as_py() or b"", refers))
        out.close()
        yield pa.record_batch([pa.array([x[0] for x in out.closed], pa.string()), pa.array([x[1] for x in out.closed], pa.int64())], names=["path", "n_records"])

    return write


def write_archives(pages: DataFrame, folder: str, least: int = 0) -> DataFrame:
    """The manifest (path, n_records) of the archives that hold one record of each row of page_id, url, html."""
    system, path = open_uri(folder)
    system.create_dir(path, recursive=True)
    source = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce(F.col("html").cast("binary"), F.lit(b"")).alias("html"))
    source = source.withColumn("digest", F.sha1("html")).withColumn("size", F.octet_length("html"))
    named = source.groupBy("digest", "size").agg(F.max("page_id").alias("named"))
    source = source.join(named.hint("merge"), ["digest", "size"])
    refers = F.when((F.col("size") >= least) & F.col("named").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("named")), F.col("named"))
    written = source.select("page_id", "url", "html", refers.alias("refers_to")).mapInArrow(lean(_writer(folder)), "path string, n_records long")
    return materialise(written, "manifest")


def _locator(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path in batch.column(0).to_pylist():
            file, read = _opened(path)
            with file:
                directory = ZipDirectory(read, file.size())
                start, _ = directory.locate(RECORDS)
                at, size = directory.locate(INDEX)
                places = [json.loads(line) for line in read(at, size).decode().split("\n") if line]
            rows, i = [], 0
            while i < len(places):
                j = i + 1
                while j < len(places) and places[j]["offset"] + places[j]["length"] - places[i]["offset"] <= RANGE_BYTES:
                    j += 1
                rows.append((path, start + places[i]["offset"], [p["length"] for p in places[i:j]]))
                i = j
            yield pa.record_batch([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.list_(pa.int64()))], names=["path", "at", "lengths"])


def _record_reader(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, at, lengths in zip(*(c.to_pylist() for c in batch.columns)):
            file, read = _opened(path)
            with file:
                data = io.BytesIO(read(at, sum(lengths)))
            rows = []
            for length in lengths:
                record = parse_record(gzip.decompress(data.read(length)))
                head, _, payload = record["block"].partition(b"\r\n\r\n")
                digest = record["warc-payload-digest"].removeprefix("sha1:")
                size = next(int(x.split(b":")[1]) for x in head.split(b"\r\n") if x.lower().startswith(b"content-length:"))
                if record["warc-type"] == "response" and (len(payload) != size or payload_digest(payload) != digest):
                    raise ValueError(f"damaged record {record['warc-record-id']} in {path}")
                ids = [record[k].removeprefix(f"<{_ID}").removesuffix(">") if k in record else "" for k in ("warc-record-id", "warc-refers-to")]
                rows.append((int(ids[0]) if ids[0] else None, record.get("warc-target-uri"), size, digest, record["warc-type"], int(ids[1]) if ids[1] else None, payload if record["warc-type"] == "response" else None))
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]
            yield pa.record_batch([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names=["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"])


def read_archives(manifest: DataFrame) -> DataFrame:
    """page_id, url, payload_bytes, payload_digest, record_type, refers_to and payload (of responses) of each record of the archives at path."""
    n = partitions(manifest.sparkSession)
    ranges = manifest.select("path").repartition(n).mapInArrow(lean(_locator), "path string, at long, lengths array<long>")
    return ranges.repartition(n).mapInArrow(lean(_record_reader), "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary")


def archive_round_trip(pages: DataFrame, least: int = 0) -> DataFrame:
    """What read_archives finds in archives of pages, written to the shared folder."""
    return read_archives(write_archives(pages, fresh_path(pages.sparkSession, "archives"), least))
