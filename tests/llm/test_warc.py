"""ARC parsing, conversion to WARC and the round trip of pages."""

from __future__ import annotations

import base64
import gzip
import hashlib

import pytest
from basalt.llm import warc

BLOCKS = [("http://a.example/", warc.http_block(b"one\r\n\r\ntwo\n", 1)), ("http://b.example/x y", warc.http_block(b"", 2)), ("dns:c.example", b"20200101 c.example\n")]


@pytest.mark.parametrize("version", [1, 2])
def test_arc_round_trip(version):
    found = list(warc.parse_arc(warc.arc_file(BLOCKS, version)))
    assert [b for _, _, b in found] == [b for _, b in BLOCKS]
    assert [f["URL"] for f, _, _ in found] == ["http://a.example/", "http://b.example/x%20y", "dns:c.example"]
    assert [list(f) for f, _, _ in found] == [warc.ARC_FIELDS[version].split()] * 3


def test_declared_fields_rule():
    """A version block may declare its own fields."""
    body = b"1 0 Other\nURL IP-address Archive-date Archive-length\n"
    data = b"filedesc://x 0.0.0.0 20200101000000 text/plain %d\n" % len(body) + body + b"\n\nhttp://q/ 1.2.3.4 19990131235959 3\nabc\n"
    ((fields, _, block),) = warc.parse_arc(data)
    assert block == b"abc" and fields["Archive-date"] == "19990131235959"


@pytest.mark.parametrize("bad", [b"http://a/ 0 0 0 3\nabc\n", b"filedesc://x 0 0 0 9\n1 0 x\n", b"filedesc://x 0.0.0.0 2 t x\n"])
def test_broken_arc_files_raise(bad):
    with pytest.raises(ValueError):
        list(warc.parse_arc(bad))


def test_warc_record_of_an_arc_record():
    fields, _, block = next(warc.parse_arc(warc.arc_file(BLOCKS[:1], 1, date="19970203040506")))
    record = warc.warc_record(fields, block)
    ((headers, got),) = warc.parse_warc(record + b"\r\n\r\n")
    assert got == block and headers["WARC-Type"] == "response" and headers["WARC-Date"] == "1997-02-03T04:05:06Z"
    payload = base64.b32encode(hashlib.sha1(b"one\r\n\r\ntwo\n").digest()).decode()
    assert headers["WARC-Payload-Digest"] == "sha1:" + payload
    assert headers["WARC-Record-ID"] == warc.parse_warc(warc.warc_record(fields, block)).__next__()[0]["WARC-Record-ID"]


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("19970203040506", "1997-02-03T04:05:06Z"), ("199702030405", "1997-02-03T04:05:00Z"), ("1997020304", "1997-02-03T04:00:00Z"), ("19970203", "1997-02-03T00:00:00Z"), ("199702", "1997-02-01T00:00:00Z"),
        ("1997", "1997-01-01T00:00:00Z"), ("19970203040506123", "1997-02-03T04:05:06Z"), ("", None), ("-", None), ("19", None), ("19971", None), ("19971340", None), ("199702x3", None), (None, None),
    ],
)
def test_dates(text, want):
    assert warc.warc_date(text) == want


def test_types_of_records():
    """HTTP is a response, a DNS answer a resource, the version block the warcinfo; version 2 keeps its fields."""
    found = {}
    for fields, _, block in warc.arc_records(warc.arc_file(BLOCKS, 2, date="2001")):
        ((headers, body),) = warc.parse_warc(warc.warc_record(fields, block))
        found[fields["URL"]] = (headers, body)
    info, body = found.pop("filedesc://pages.arc")
    assert (info["WARC-Type"], info["Content-Type"], info["WARC-Date"]) == ("warcinfo", "application/warc-fields", "2001-01-01T00:00:00Z")
    assert b"software: Basalt\r\n" in body and b"x-arc-version: 2\r\n" in body
    dns, body = found["dns:c.example"]
    assert dns["WARC-Type"] == "resource" and dns["Content-Type"] == "text/html" and body == BLOCKS[2][1]
    assert {h["WARC-Type"] for u, (h, _) in found.items() if u.startswith("http")} == {"response"}
    assert dns["X-Archive-Result-code"] == "200" and dns["X-Archive-Checksum"] == warc._b32(BLOCKS[2][1])


def test_broken_dates_keep_what_stood_there():
    fields = {"URL": "http://a/", "IP-address": "1.2.3.4", "Archive-date": "9 9", "Content-type": "text/html", "Archive-length": "1"}
    ((headers, _),) = warc.parse_warc(warc.warc_record(fields, b"x", date="2002-01-01T00:00:00Z"))
    assert (headers["WARC-Date"], headers["X-Archive-Date"]) == ("2002-01-01T00:00:00Z", "9%209")


def test_records_over_chunks():
    data = b"\r\n\r\n".join(warc.warc_record(f, b) for f, _, b in warc.arc_records(warc.arc_file(BLOCKS, 1))) + b"\r\n\r\n"
    whole = list(warc.parse_warc(data))
    for size in (1, 2, 3, 50):
        assert list(warc.parse_warc(data[i : i + size] for i in range(0, len(data), size))) == whole
    with pytest.raises(ValueError):
        list(warc.parse_warc(data[:-30]))


def brute(rows):
    payload = [(h or "").encode() for _, _, h in rows]
    out = []
    for (i, _, _), p in zip(rows, payload, strict=True):
        ids = [j for (j, _, _), q in zip(rows, payload, strict=True) if q == p and j is not None]
        top = max(ids, default=None)
        revisit = top is not None and top != i
        out.append((i, len(p), base64.b32encode(hashlib.sha1(p).digest()).decode(), "revisit" if revisit else "response", top if revisit else None))
    return sorted(out, key=repr)


def test_pages_round_trip(spark):
    rows = [(1, "http://a/", "<p>x</p>"), (2, None, "<p>x</p>"), (7, "http://b/\n c", "<p>x</p>"), (3, "u", None), (4, "u", ""), (5, "é", "日本\r\n\r\nWARC/1.0\r\n\r\n")]
    rows += [(6, "long", "ab\r\n" * 50000), (8, "dup", "same"), (8, "dup", "same"), (None, "none", "only"), (None, "none", "<p>x</p>")]
    pages = spark.createDataFrame([(*r, 1, "s", b"r") for r in rows], "page_id long, url string, html string, origin long, s string, record binary")
    got = warc.archive_round_trip(pages).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()
    assert sorted(map(tuple, got), key=repr) == brute(rows)


def test_revisits_refer_to_their_response(spark):
    pages = spark.createDataFrame([(i, f"http://x/{i}", "same" if i % 2 else f"own {i}") for i in range(20)], "page_id long, url string, html string")
    rows = warc.archive_round_trip(pages).collect()
    assert len({r.record_id for r in rows}) == 20
    assert {r.refers_to for r in rows if r.record_type == "revisit"} == {19}
    assert {r.page_id: bytes(r.payload) for r in rows if r.payload is not None}[19] == b"same"


def test_arc_files_on_disk(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.arc").write_bytes(warc.arc_file(BLOCKS, 1))
    (tmp_path / "in/b.arc.gz").write_bytes(b"".join(gzip.compress(x) for x in (warc.arc_file(BLOCKS, 2),)))
    warc.convert_arc(spark, str(tmp_path / "in"), str(tmp_path / "out"))
    rows = warc.read_warc(spark, str(tmp_path / "out")).collect()
    assert sorted(r.record_type for r in rows) == ["resource"] * 2 + ["response"] * 4
    kinds = [h["WARC-Type"] for f in sorted((tmp_path / "out").glob("*.gz")) for h, _ in warc.parse_warc(gzip.decompress(f.read_bytes()))]
    assert kinds.count("warcinfo") == 2
    assert sorted(bytes(r.payload) for r in rows) == sorted(2 * [b"one\r\n\r\ntwo\n", b"", b"20200101 c.example\n"])


def test_empty_table(spark):
    assert warc.archive_round_trip(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []
