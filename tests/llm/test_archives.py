"""Operator 1: archives, their directories, and the round trip."""

import io
import zipfile

import brute
import pytest

from hexweave.llm import warc

SF = "/root/testdata/sf0.01"


class Bytes:
    def __init__(self, raw):
        self.raw = raw

    def read_at(self, n, at):
        return self.raw[at : at + n]


def _zip(force):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as z:
        z.comment = b"a note"
        for name, body in (("a", b"first"), ("b/c", b"second" * 100)):
            with z.open(name, "w", force_zip64=force) as f:
                f.write(body)
    return out.getvalue()


@pytest.mark.parametrize("force", [False, True])
def test_members(force):
    f = Bytes(_zip(force))
    found = warc.members(f, len(f.raw))
    assert {n: f.read_at(m.size, warc.data_offset(f, m)) for n, m in found.items()} == {"a": b"first", "b/c": b"second" * 100}


def test_zip64_directory(monkeypatch):
    """Sizes, places and counts that the old records cannot hold."""
    monkeypatch.setattr(zipfile, "ZIP64_LIMIT", 10)
    monkeypatch.setattr(zipfile, "ZIP_FILECOUNT_LIMIT", 1)
    f = Bytes(_zip(True))
    assert b"PK\x06\x06" in f.raw and b"PK\x06\x07" in f.raw
    found = warc.members(f, len(f.raw))
    assert {n: f.read_at(m.size, warc.data_offset(f, m)) for n, m in found.items()} == {"a": b"first", "b/c": b"second" * 100}


def test_damaged_archives():
    with pytest.raises(ValueError):
        warc.members(Bytes(b"no archive" * 50), 500)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("a", "x" * 100)
    f = Bytes(out.getvalue())
    with pytest.raises(ValueError):
        warc.data_offset(f, warc.members(f, len(f.raw))["a"])


@pytest.mark.parametrize("refers_to", [None, 9])
def test_record(refers_to):
    raw = warc.record(7, "http://x/a b", b"\r\n\r\nbody\xff", "cf23df2207d99a74fbe169e3eba035e633b65d94", refers_to)
    if refers_to is None:
        with pytest.raises(ValueError):  # not its digest
            warc.parse(raw)
    else:
        got = warc.parse(raw)
        assert (got["page_id"], got["record_type"], got["refers_to"], got["payload_bytes"], got["url"]) == (7, "revisit", 9, 9, "http://x/a%20b")


def test_round_trip(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    want = brute.warc([(r.page_id, r.html) for r in pages.select("page_id", "html").collect()])
    got = {r.page_id: (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.round_trip(pages).collect()}
    assert got == want


def test_payloads_and_odd_rows(spark):
    big = "é" * 500
    rows = [(1, None, None, 1), (2, "u", "", 1), (3, "u\r\nx", big, 2), (4, "u", big, 2), (5, "u", big + "x", 2), (6, "u", "\r\n\r\n", 3), (7, "u", "y" * 999, 3), (8, "u", "y" * 999, 3), (9, "u", "z" * 3_000_000, 4)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, digest int")
    got = {r.page_id: r for r in warc.round_trip(pages, with_payload=True).collect()}
    assert {i: (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for i, r in got.items()} == brute.warc([(r[0], r[2]) for r in rows])
    assert all(got[r[0]].payload == (r[2] or "").encode() for r in rows if r[0] != 3) and got[3].payload is None
    assert warc.round_trip(pages.limit(0)).count() == 0


def test_null_ids_and_repeated_rows(spark):
    big = "w" * 2000
    pages = spark.createDataFrame([(None, "u", big), (2, "u", big), (2, "u", big), (1, "u", big)], "page_id long, url string, html string")
    got = sorted((r.page_id or 0, r.record_type, r.refers_to or 0) for r in warc.round_trip(pages).collect())
    assert got == [(0, "revisit", 2), (1, "revisit", 2), (2, "response", 0), (2, "response", 0)]
