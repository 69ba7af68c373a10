"""WARC records in ZIP archives: writing, and reading without extraction.

An archive has two stored members: the records, each a gzip member of its own,
and an index of their places. The reader takes the end of the file, the central
directory (with its ZIP64 parts), the index, and then only the ranges of the
records that are wanted; nothing is unpacked to disk.

Files are opened through pyarrow's file systems, by URI, in the folder that the
cluster shares. A task that is run again writes a new file, and only the files
of the run that ended are in the table of archives.
"""

from __future__ import annotations

import base64
import hashlib
import io
import json
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waymark.llm.common import scratch_path, table, written

#: Payloads of at least so many bytes are written once.
REVISIT_BYTES = 1000
#: Bytes of records after which an archive ends; bytes read ahead in one request.
ARCHIVE_BYTES, AHEAD = 32 << 20, 1 << 20
DATA, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
DATE = "2000-01-01T00:00:00Z"
RECORD_ID, NO_URI = "urn:page:", "urn:page:no-uri"
#: ZIP's signatures and extra field; fixed values.
END, END64, LOCATOR64, ENTRY, LOCAL, EXTRA64 = b"PK\x05\x06", b"PK\x06\x06", b"PK\x06\x07", b"PK\x01\x02", b"PK\x03\x04", 1


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One WARC record: a response with its payload, or a revisit without it."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    revisit = refers_to is not None
    block = http if revisit else http + payload
    uri = "".join(c if c.isprintable() and not c.isspace() else "".join(f"%{b:02X}" for b in c.encode()) for c in url or NO_URI)
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <{RECORD_ID}{'' if page_id is None else page_id}>", f"WARC-Date: {DATE}", f"WARC-Target-URI: {uri}", f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(digest)).decode()}"]
    if revisit:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <{RECORD_ID}{refers_to}>"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(data: bytes) -> dict:
    """Headers and payload of a record; checks the digest of a response's."""
    head, block = data.split(b"\r\n\r\n", 1)
    version, *lines = head.decode().split("\r\n")
    if not version.startswith("WARC/"):
        raise ValueError("no WARC record")
    headers = {k.lower(): v.strip() for k, v in (x.split(":", 1) for x in lines)}
    block = block[: int(headers["content-length"])]
    http, payload = block.split(b"\r\n\r\n", 1)
    length = next(int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
    digest = base64.b32decode(headers["warc-payload-digest"].removeprefix("sha1:")).hex()
    kind = headers["warc-type"]
    if kind == "response" and (len(payload) != length or hashlib.sha1(payload).hexdigest() != digest):
        raise ValueError(f"{headers['warc-record-id']}: the payload does not have the digest")
    number = lambda x: int(n) if (n := x.strip("<>").removeprefix(RECORD_ID)) else None
    refers_to = headers.get("warc-refers-to")
    uri = headers["warc-target-uri"]
    return {
        "page_id": number(headers["warc-record-id"]), "url": None if uri == NO_URI else uri, "record_type": kind, "payload": payload if kind == "response" else None,
        "payload_bytes": length, "payload_digest": digest, "refers_to": number(refers_to) if refers_to else None,
    }


class RangeFile:
    """Reads of ranges of a file; what lies just ahead comes along."""

    def __init__(self, file: pa.NativeFile) -> None:
        self.file, self.size = file, file.size()
        self.at, self.held = 0, b""

    def read(self, at: int, n: int) -> bytes:
        if at < self.at or at + n > self.at + len(self.held):
            self.at, self.held = at, self.file.read_at(max(0, min(max(n, AHEAD), self.size - at)), at)
        out = self.held[at - self.at : at - self.at + n]
        if len(out) != n:
            raise ValueError("the archive is cut off")
        return out


def central_directory(file: RangeFile) -> dict[str, tuple[int, int, int]]:
    """(local header's offset, size, method) of each member."""
    tail_size = min(file.size, 22 + 0xFFFF)
    tail = file.read(file.size - tail_size, tail_size)
    at = tail.rfind(END)
    while at >= 0 and at + 22 + int.from_bytes(tail[at + 20 : at + 22], "little") != len(tail):
        at = tail.rfind(END, 0, at)
    if at < 0:
        raise ValueError("no ZIP archive")
    count, size, offset = struct.unpack("<HII", tail[at + 10 : at + 20])
    place = file.size - tail_size + at
    if place >= 20 and (locator := file.read(place - 20, 20))[:4] == LOCATOR64:
        end64 = file.read(struct.unpack("<Q", locator[8:16])[0], 56)
        if end64[:4] != END64:
            raise ValueError("no ZIP64 directory where its locator points")
        count, size, offset = struct.unpack("<QQQ", end64[32:56])
    data, members, at = file.read(offset, size), {}, 0
    for _ in range(count):
        if data[at : at + 4] != ENTRY:
            raise ValueError("the central directory is damaged")
        method = struct.unpack("<H", data[at + 10 : at + 12])[0]
        packed, whole, n_name, n_extra, n_note = struct.unpack("<IIHHH", data[at + 20 : at + 34])
        local = struct.unpack("<I", data[at + 42 : at + 46])[0]
        name = data[at + 46 : at + 46 + n_name].decode("utf-8")
        extra = data[at + 46 + n_name : at + 46 + n_name + n_extra]
        while len(extra) >= 4:  # the 64-bit values stand for those that are all ones, in this order
            kind, n = struct.unpack("<HH", extra[:4])
            if kind == EXTRA64:
                values = iter(struct.unpack(f"<{n // 8}Q", extra[4 : 4 + n // 8 * 8]))
                whole, packed, local = (next(values) if x == 0xFFFFFFFF else x for x in (whole, packed, local))
            extra = extra[4 + n :]
        members[name] = (local, packed, method)
        at += 46 + n_name + n_extra + n_note
    return members


def stored_member(file: RangeFile, member: tuple[int, int, int]) -> tuple[int, int]:
    """Where the bytes of a stored member begin, and how many they are."""
    local, size, method = member
    if method != 0:
        raise ValueError("the member is compressed: its records cannot be read by range")
    head = file.read(local, 30)
    if head[:4] != LOCAL:
        raise ValueError("no member where the directory points")
    n_name, n_extra = struct.unpack("<HH", head[26:30])
    return local + 30 + n_name + n_extra, size


def read_records(file: RangeFile, wanted=None) -> Iterator[dict]:  # noqa: ANN001
    """The records of an archive in order; wanted(index entry) says which."""
    members = central_directory(file)
    start, size = stored_member(file, members[INDEX])
    entries = [json.loads(line) for line in file.read(start, size).decode().splitlines()]
    base, size = stored_member(file, members[DATA])
    for entry in entries:
        if wanted is None or wanted(entry):
            if entry["offset"] + entry["length"] > size:
                raise ValueError("the index points behind the records")
            yield parse_record(zlib.decompress(file.read(base + entry["offset"], entry["length"]), wbits=31))


def archive_bytes(packed: list[bytes], index: list[dict]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as archive:
        archive.writestr(zipfile.ZipInfo(DATA), b"".join(packed))
        archive.writestr(zipfile.ZipInfo(INDEX), "".join(json.dumps(x) + "\n" for x in index))
    return out.getvalue()


def _opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path.removeprefix("file:"))


def with_revisits(pages: DataFrame, least: int = REVISIT_BYTES) -> DataFrame:
    """(page_id, url, payload, digest, refers_to) of pages (page_id, url, html)."""
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select("page_id", "url", payload.alias("payload")).withColumn("digest", F.sha1("payload"))
    large = F.octet_length("payload") >= least
    first = rows.where(large).groupBy("digest").agg(F.max("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").select(F.col("digest").alias("key"), "first")
    # written, so that the join deals both sides anew and can split a payload that recurs
    first = written(first, "first")
    # short payloads get keys of their own, so that they do not meet in one task
    rows = rows.withColumn("key", F.when(large, F.col("digest")).otherwise(F.concat(F.lit("-"), F.xxhash64("page_id", "digest").cast("string"))))
    refers_to = F.when(F.col("page_id").isNull() | (F.col("page_id") != F.col("first")), F.col("first"))
    return rows.join(first, "key", "left").select("page_id", "url", "payload", "digest", refers_to.alias("refers_to"))


def write_archives(pages: DataFrame, folder: str, archive_size: int = ARCHIVE_BYTES) -> DataFrame:
    """Write a record for every row of pages (page_id, url, html) into archives
    in the folder; gives the archives (path, n_records). A null html is an empty
    payload, a null url is left out, a null page_id is an empty name. Of equal
    payloads of at least 1000 bytes that of the largest page_id is a response
    (rows that repeat it too), the others are revisits of it. Other columns are
    not looked at; an empty table has no archives."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, place = _opened(folder)
        system.create_dir(place, recursive=True)
        packed: list[bytes] = []
        index: list[dict] = []
        size = 0

        def ended() -> pa.RecordBatch:
            nonlocal packed, index, size
            name = f"{uuid.uuid4().hex}.zip"
            with system.open_output_stream(f"{place}/{name}") as out:
                out.write(archive_bytes(packed, index))
            batch = pa.RecordBatch.from_arrays([pa.array([f"{folder}/{name}"]), pa.array([len(index)], pa.int64())], ["path", "n_records"])
            packed, index, size = [], [], 0
            return batch

        for batch in batches:
            for page_id, url, payload, digest, refers_to in zip(*(c.to_pylist() for c in batch.columns)):
                pack = zlib.compressobj(3, wbits=31)
                data = pack.compress(record(page_id, url, payload, digest, refers_to)) + pack.flush()
                packed.append(data)
                index.append({"page_id": page_id, "offset": size, "length": len(data), "type": "response" if refers_to is None else "revisit"})
                size += len(data)
                if size >= archive_size:
                    yield ended()
        if index:
            yield ended()

    return with_revisits(pages).mapInArrow(write, "path string, n_records long")


def read_archives(archives: DataFrame, payloads: bool = True) -> DataFrame:
    """(page_id, url, record_type, payload_bytes, payload_digest, refers_to,
    payload) of every record of the archives (path), one task or more for each
    32 of them. The payload is null for revisits, and where payloads is false."""
    schema = "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, payload binary"
    names = [x.split()[0] for x in schema.split(", ")]

    def batch_of(rows: list[dict]) -> pa.RecordBatch:
        types = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array([None if n == "payload" and not payloads else r[n] for r in rows], t) for n, t in zip(names, types)], names)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                system, place = _opened(path)
                with system.open_input_file(place) as file:
                    rows: list[dict] = []
                    for row in read_records(RangeFile(file)):
                        rows.append(row)
                        if len(rows) == 512:
                            yield batch_of(rows)
                            rows = []
                    yield batch_of(rows)

    spread = max(1, archives.sparkSession.sparkContext.defaultParallelism, archives.count() // 32)
    return archives.select("path").repartition(spread).mapInArrow(read, schema)


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch_path(spark, "warc")
    archives = written(write_archives(table(spark, sf_dir, "pages"), folder), "archives")
    return read_archives(archives, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE = """
WITH p AS (
  SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest,
    max(page_id) OVER (PARTITION BY coalesce(html, '')) AS first
  FROM pages
)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 1000 AND page_id IS DISTINCT FROM first AND first IS NOT NULL THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 1000 AND page_id IS DISTINCT FROM first THEN first END AS refers_to
FROM p
"""
