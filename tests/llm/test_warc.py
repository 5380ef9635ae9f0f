from __future__ import annotations

import base64
import gzip
import hashlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from spanscope.llm import warc

from .cases import ordered


def _pages():
    long = "<p>é日🙂\r\n\r\nWARC/1.1\r\n</p>" * 6000
    rows = [(5, "http://a/1", "x" * 100), (3, "http://a/2", "x" * 100), (9, None, "x" * 100), (1, "u", "x" * 99), (2, "u\r\nX: y", "x" * 99), (4, "u", None), (6, "u", ""), (7, "u", long), (8, "u", long), (10, "u", "é" * 49), (11, "u", "é" * 50), (12, "u", "é" * 50), (None, "u", "x" * 100), (None, "u", "lone" * 40)]
    return rows + [(3, "http://a/2", "x" * 100)]


def _want(rows):
    out = []
    for i, _, html in rows:
        p = (html or "").encode()
        same = [j for j, _, h in rows if (h or "").encode() == p and j is not None]
        first = min(same) if same and len(p) >= 100 and sum((h or "").encode() == p for _, _, h in rows) > 1 else None
        revisit = first is not None and first != i
        out.append((i, len(p), hashlib.sha256(p).hexdigest(), "revisit" if revisit else "response", first if revisit else None, True))
    return out


@pytest.mark.parametrize("broadcast_rows", [0, 1000])
def test_round_trip(spark, broadcast_rows):
    d = spark.createDataFrame([(*r, 1) for r in _pages()], "page_id bigint, url string, html string, `HTML` int").repartition(3)
    path = warc.archive_path(spark)
    warc.write_archives(d, path, segment=4096, records_per_file=5, broadcast_rows=broadcast_rows)
    assert ordered(warc.read_archives(spark, path).collect()) == ordered(_want(_pages()))


def test_files_are_archives(spark, tmp_path):
    d = spark.createDataFrame(_pages(), "page_id bigint, url string, html string").coalesce(1)
    path = f"{tmp_path}/w"
    warc.write_archives(d, f"file://{path}", segment=4096)
    kinds = []
    for f in (tmp_path / "w").glob("part-*"):
        kinds += [h["warc-type"] for h, _ in warc.parse(gzip.decompress(f.read_bytes()))]
    assert {"response", "revisit", "continuation"} == set(kinds)


def test_empty(spark):
    path = warc.archive_path(spark)
    warc.write_archives(spark.createDataFrame([], "page_id bigint, url string, html string"), path)
    assert warc.read_archives(spark, path).count() == 0


@settings(max_examples=100, deadline=None)
@given(st.binary(max_size=300), st.integers(1, 50))
def test_chunks(payload, size):
    assert warc.unchunked(warc.chunked(payload, size)) == payload


def test_reassembly_checks():
    parts = [(2, None, b"b"), (1, None, b"aa"), (3, 4, b"c")]
    assert warc.reassemble(parts) == b"aabc"
    assert warc.reassemble(parts[:2]) is None
    assert warc.reassemble([(1, None, b"aa"), (3, 3, b"c")]) is None
    assert warc.reassemble([*parts[:2], (3, 5, b"c")]) is None
    with pytest.raises(ValueError):
        warc.unchunked(b"5\r\nab\r\n")


def test_archives_with_a_member_per_record(spark, tmp_path):
    """The usual form of foreign archives, and plain ones; a broken chunk is an incomplete record, not a failure."""
    out = []
    for i, html in ((1, "a" * 200), (2, "b" * 150), (3, "c")):
        digest = hashlib.sha256(html.encode()).hexdigest()
        text = warc.records(i, "http://x", html.encode(), digest, None, f"0-{i}", 1 << 15)
        out.append(b"".join(bytes(r) + warc._CLOSE.encode() for r in text))
    (tmp_path / "a.warc.gz").write_bytes(b"".join(gzip.compress(x) for x in out))
    assert ordered((r["page_id"], r["payload_bytes"], r["complete"]) for r in warc.read_archives(spark, str(tmp_path)).collect()) == [(1, 200, True), (2, 150, True), (3, 1, True)]
    assert warc.inflate(b"".join(out)) == b"".join(out) == warc.inflate(b"".join(gzip.compress(x) for x in out))
    with pytest.raises(ValueError):
        warc.inflate(gzip.compress(out[0])[:-9])
    assert warc._checked(b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\nzz\r\n", "x") == (None, None, False)


def _foreign() -> list[bytes]:
    def record(kind, block, **fields):
        head = "".join(f"{k.replace('_', '-')}: {v}\r\n" for k, v in fields.items())
        return f"WARC/1.0\r\nWARC-Type: {kind}\r\n{head}Content-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"

    http = b"HTTP/1.1 200 OK\r\n\r\n"
    sha1 = "sha1:" + base64.b32encode(hashlib.sha1(b"x" * 120).digest()).decode()
    return [
        record("warcinfo", b"software: none\r\n"),
        record("request", b"GET / HTTP/1.1\r\n\r\n", X_Page_Id=1),
        record("response", http + b"x" * 120, X_Page_Id=1, WARC_Payload_Digest=sha1),
        record("metadata", b"fetchTimeMs: 3", X_Page_Id=1),
        record("revisit", http, X_Page_Id=2, WARC_Payload_Digest=sha1),
        record("revisit", http, X_Page_Id=3, WARC_Payload_Digest="sha1:" + "A" * 32),
        record("revisit", http, X_Page_Id=4),
        record("response", http + b"y", X_Page_Id=5),
        record("response", http + b"y", X_Page_Id=6, WARC_Payload_Digest=sha1),
        record("resource", b"ab", WARC_Record_ID="<r>", WARC_Segment_Number=1, X_Page_Id=7),
        record("continuation", b"c", WARC_Segment_Origin_ID="<r>", WARC_Segment_Number=2, WARC_Segment_Total_Length=3),
        record("response", http + b"z", WARC_Record_ID="<s>", WARC_Segment_Number=1, X_Page_Id=8, WARC_Block_Digest="sha1:" + "A" * 32),
        record("continuation", b"z", WARC_Segment_Origin_ID="<s>", WARC_Segment_Number=2, WARC_Segment_Total_Length=len(http) + 2),
    ]


def _sha(payload: bytes) -> str:
    return hashlib.sha256(payload).hexdigest()


@pytest.mark.parametrize("packed", [True, False])
def test_foreign_archives(spark, tmp_path, packed):
    """Other record types are no pages; revisits without a page go by digest; SHA-1, no digest, a broken segment."""
    out = _foreign()
    (tmp_path / "a.warc").write_bytes(b"".join(gzip.compress(x) if packed else x for x in out))
    x = _sha(b"x" * 120)
    want = [
        (1, 120, x, "response", None, True),
        (2, 120, x, "revisit", 1, True),
        (3, None, None, "revisit", None, False),
        (4, None, None, "revisit", None, False),
        (5, 1, _sha(b"y"), "response", None, True),
        (6, 1, _sha(b"y"), "response", None, False),
        (8, None, None, "response", None, False),
    ]
    assert ordered(warc.read_archives(spark, str(tmp_path)).collect()) == ordered(want)


@pytest.mark.parametrize("packed", [True, False])
def test_archives_that_are_cut_off(spark, tmp_path, packed):
    """Whole records before the cut count; the one that is cut is not complete; other archives are read."""
    http = b"HTTP/1.1 200 OK\r\n\r\n"
    rng = np.random.default_rng(0)
    noise = rng.integers(0, 256, 3000, dtype=np.uint8).tobytes()

    def record(i, body):
        return f"WARC/1.0\r\nWARC-Type: response\r\nX-Page-Id: {i}\r\nContent-Length: {len(http + body)}\r\n\r\n".encode() + http + body + b"\r\n\r\n"

    pack = gzip.compress if packed else bytes
    (tmp_path / "a.warc").write_bytes(pack(record(1, b"a")) + pack(record(2, noise))[:-1000])
    (tmp_path / "b.warc").write_bytes(pack(record(3, b"c")) + pack(b"WARC/1.0\r\nWARC-Ty"))
    (tmp_path / "c.warc").write_bytes(b"")
    (tmp_path / "d.warc").write_bytes(b"no archive")
    want = [(1, 1, _sha(b"a"), "response", None, True), (2, None, None, "response", None, False), (3, 1, _sha(b"c"), "response", None, True)]
    assert ordered(warc.read_archives(spark, str(tmp_path)).collect()) == ordered(want)


def test_stated_digests():
    d = hashlib.sha256(b"q")
    for text in (d.hexdigest(), "sha256:" + d.hexdigest().upper(), "SHA-256:" + base64.b32encode(d.digest()).decode(), None, "", "md5:00"):
        assert warc.agrees(b"q", text)
    assert not warc.agrees(b"r", d.hexdigest()) and not warc.agrees(b"q", "sha1:??")
