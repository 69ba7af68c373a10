import hashlib
import io
import random
import zipfile

import pyarrow as pa
import pytest

from waymark.llm import common
from waymark.llm import warczip as W


def test_round_trip(spark, tmp_path):
    big, other = "é" * 600, "x" * 1000
    pages = [(1, "http://a/", big, 0), (2, "http://b/ c\r\nX: y", big, 0), (3, None, None, 0), (4, "u", "", 0), (5, "u", other, 0), (6, "u", other[:-1], 0), (7, "u", other[:-1], 0), (8, "u", "a\r\n\r\nb" * 500, 0), (None, "n", other, 0), (8, "u", "a\r\n\r\nb" * 500, 0), (9, "u", "\x00WARC/1.1\r\n", 0)]
    frame = spark.createDataFrame(pages, "page_id long, url string, html string, digest int")
    archives = W.write_archives(frame, f"file://{tmp_path}/w", archive_size=300)
    archives = spark.createDataFrame(archives.collect(), archives.schema)
    assert archives.agg({"n_records": "sum"}).first()[0] == len(pages) and archives.count() > 1
    rows = W.read_archives(archives).collect()
    got = sorted((r.page_id or 0, r.record_type, r.refers_to, r.payload_bytes, r.payload_digest, bytes(r.payload or b"").decode()) for r in rows)
    want = []
    for i, _, html, _ in pages:
        data = (html or "").encode()
        first = max((j for j, _, h, _ in pages if (h or "") == (html or "") and j is not None), default=None)
        revisit = len(data) >= 1000 and i != first
        want.append((i or 0, "revisit" if revisit else "response", first if revisit else None, len(data), hashlib.sha1(data).hexdigest(), "" if revisit else html or ""))
    assert got == sorted(want)
    assert {r.page_id: r.url for r in rows}[3] is None
    empty = W.write_archives(frame.limit(0), f"file://{tmp_path}/e")
    assert empty.count() == 0


def reader(data):
    return W.RangeFile(pa.BufferReader(data))


def sample(n=5):
    packed, index, at = [], [], 0
    import zlib

    for i in range(n):
        payload = f"page {i}".encode() * 50
        pack = zlib.compressobj(wbits=31)
        data = pack.compress(W.record(i, "u", payload, hashlib.sha1(payload).hexdigest(), None)) + pack.flush()
        packed.append(data)
        index.append({"page_id": i, "offset": at, "length": len(data), "type": "response"})
        at += len(data)
    return packed, index


def test_zip64_and_comments(monkeypatch):
    monkeypatch.setattr(zipfile, "ZIP64_LIMIT", 10)
    monkeypatch.setattr(zipfile, "ZIP_FILECOUNT_LIMIT", 1)
    data = W.archive_bytes(*sample())
    assert W.END64 in data and W.LOCATOR64 in data
    assert [r["page_id"] for r in W.read_records(reader(data))] == list(range(5))
    assert [r["page_id"] for r in W.read_records(reader(data), lambda e: e["page_id"] == 3)] == [3]
    monkeypatch.undo()
    out = io.BytesIO(W.archive_bytes(*sample()))
    with zipfile.ZipFile(out, "a") as archive:
        archive.comment = b"PK\x05\x06 is no end" * 9
    assert len(list(W.read_records(reader(out.getvalue())))) == 5


def test_damage_is_reported():
    data = W.archive_bytes(*sample())
    for bad in (b"", data[:-30], b"PK" * 40):
        with pytest.raises(ValueError):
            list(W.read_records(reader(bad)))
    payload = b"x"
    with pytest.raises(ValueError):
        W.parse_record(W.record(1, "u", payload, hashlib.sha1(b"y").hexdigest(), None))


def test_payloads_beyond_the_read_ahead(spark, tmp_path):
    rng = random.Random(5)
    long = "".join(chr(rng.randrange(32, 1000)) for _ in range(1_500_000))
    rows = [(1, "u", long), (2, "v", long), (3, None, "é" * 600), (4, "w", None), (5, "w", "")]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string")
    found = {r.page_id: r for r in W.read_archives(common.written(W.write_archives(frame, f"file://{tmp_path}/a"), "archives")).collect()}
    assert found[2].payload.decode() == long and found[1].record_type == "revisit" and found[1].refers_to == 2 and found[1].payload_bytes == len(long.encode())
    assert found[3].payload.decode() == "é" * 600 and found[4].payload_bytes == found[5].payload_bytes == 0


def test_query_is_its_sql(spark, sql_rows):
    sql_rows(W.op7_warc, W.ORACLE)
