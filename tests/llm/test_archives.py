"""Archives: exact round trips, ZIP64 directories, revisits."""

import base64
import hashlib
import io
import zipfile

import pytest

from veristrata.llm import web_archives as A

PAGES = [(1, "http://a/x", "same"), (2, "http://b/y", "same"), (9, None, "same"), (4, "http://c/z\nq", "é\r\n\r\nbody"), (5, "http://d", None), (6, "http://e", ""), (7, "http://f", "x" * 100_000), (7, "http://f", "x" * 100_000), (None, "http://g", "lonely"), (None, "http://h", "same")]


def _digest(html):
    return base64.b32encode(hashlib.sha1((html or "").encode()).digest()).decode()


@pytest.mark.parametrize("least", [0, 3, 5])
def test_round_trip(spark, least):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string").repartition(3)
    got = sorted((r.page_id or -1, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to, r.payload) for r in A.archive_round_trip(pages, least).collect())
    named = {}
    for i, _, html in PAGES:
        if i is not None:
            named[html or ""] = max(named.get(html or "", i), i)
    want = []
    for i, _, html in PAGES:
        payload = (html or "").encode()
        to = named.get(html or "")
        refers = to if len(payload) >= least and to is not None and to != i else None
        want.append((i or -1, len(payload), _digest(html), "response" if refers is None else "revisit", refers, bytearray(payload) if refers is None else None))
    assert got == sorted(want)


def test_empty(spark):
    assert A.archive_round_trip(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def _directory(data):
    return A.ZipDirectory(lambda at, n: data[at : at + n], len(data))


def test_directory_finds_stored_members_only():
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("a.txt", b"hello", zipfile.ZIP_STORED)
        z.writestr("b.txt", b"hello" * 50, zipfile.ZIP_DEFLATED)
        with z.open("c.bin", "w", force_zip64=True) as f:
            f.write(b"wide")
        z.comment = b"a comment"
    data = out.getvalue()
    found = _directory(data)
    assert set(found.members) == {"a.txt", "c.bin"}
    for name, want in (("a.txt", b"hello"), ("c.bin", b"wide")):
        at, size = found.locate(name)
        assert data[at : at + size] == want


def test_directory_reads_zip64(monkeypatch):
    monkeypatch.setattr(zipfile, "ZIP64_LIMIT", 10)
    monkeypatch.setattr(zipfile, "ZIP_FILECOUNT_LIMIT", 1)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("first", b"0123456789abcdef")
        z.writestr("second", b"fedcba9876543210!")
    data = out.getvalue()
    assert b"PK\x06\x06" in data
    found = _directory(data)
    at, size = found.locate("second")
    assert data[at : at + size] == b"fedcba9876543210!"


def test_damage_is_seen():
    with pytest.raises(ValueError):
        _directory(b"not a zip file")
    with pytest.raises(ValueError):
        A.parse_record(b"HTTP/1.1 200 OK\r\n\r\n")


def test_comments_that_look_like_the_end(tmp_path):
    """An archive comment with an end record's four bytes in it doesn't mislead the reader."""
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w", zipfile.ZIP_STORED) as z:
        z.writestr("a", b"first")
        z.writestr("b", b"second")
        z.comment = b"note PK\x05\x06 and " + b"PK\x05\x06" + bytes(30)
    data = buffer.getvalue()
    directory = A.ZipDirectory(lambda at, size: data[at : at + size], len(data))
    at, size = directory.locate("b")
    assert data[at : at + size] == b"second" and set(directory.members) == {"a", "b"}
