"""Web-archive derivatives: links between records, digests, text, odd input."""

import gzip
import hashlib
import zlib

import pytest
from annolith.llm import warc as W
from hypothesis import given, settings
from hypothesis import strategies as st

PAGE = '<!DOCTYPE html><html><head><title>A &amp;\n B</title><style>p{}</style><script>var t="</p>";</script></head><body><p>One <b>bold</b>&nbsp;word<br>two</p><!-- no <p>x</p> --><ul><li><a HREF="/x">L1</a></li><li>5 < 6 &lt;b&gt;</li></ul></body></html>'
SCHEMA = "page_id long, url string, html string, record string, date int"


def test_text_and_title():
    assert W.plain_text(PAGE) == "One bold word\ntwo\nL1\n5 < 6 <b>"
    assert W.title_of(PAGE) == "A & B"
    assert W.plain_text("") == W.title_of("") == ""
    assert W.plain_text("a<script>x") == W.plain_text("a<!-- x <p>b") == "a"


def test_long_and_unclosed_pages_are_linear():
    assert W.plain_text("<!--" * 200_000) == ""
    assert W.plain_text("<p " * 20_000 + "x") .endswith("x")
    assert len(W.plain_text("<p>word</p>" * 100_000)) == 500_000 - 1


def test_serialised_records_round_trip():
    block = b"\r\n\r\nWARC/1.0\r\n" * 3
    data = W.serialise([("WARC-Type", "x"), ("A", "1\r\nB: 2"), ("N", None)], block) * 2
    got = list(W.parse(data))
    assert len(got) == 2 and got[0] == ({"warc-type": "x", "a": "1 B: 2", "content-length": str(len(block))}, block)
    assert list(W.parse(b"")) == list(W.parse(b"junk")) == list(W.parse(b"WARC/1.0\r\nContent-Length: x\r\n\r\n")) == []


@pytest.mark.parametrize(("block", "want"), [(b"HTTP/1.1 404 No\r\nA: b\r\n\r\nx", (404, [("A", "b")], b"x")), (b"no http", (0, [], b"no http")), (b"HTTP/1.1 200", (0, [], b"HTTP/1.1 200")), (b"HTTP/1.1 x\r\n\r\n", (0, [], b""))])
def test_http(block, want):
    assert W.http_parts(block) == want


def test_only_responses_derive():
    head = {"warc-type": "response", "warc-record-id": "<a>", "warc-payload-digest": "sha1:KEEP", "warc-date": "D", "warc-target-uri": "u"}
    meta, conv = (next(W.parse(d)) for d in W.derive(head, b"HTTP/1.1 200 OK\r\nX-Own: 7\r\n\r\n<p>\xff\xc3\xa9"))
    assert meta[0]["warc-refers-to"] == conv[0]["warc-refers-to"] == "<a>"
    assert meta[0]["warc-payload-digest"] == "sha1:KEEP" and b"source-payload-digest: sha1:KEEP\r\n" in meta[1] and b"http-header-x-own: 7\r\n" in meta[1]
    assert f"conversion-record-id: {conv[0]['warc-record-id']}".encode() in meta[1]
    assert conv[1] == "�é".encode() and conv[0]["warc-date"] == "D" and conv[0]["warc-target-uri"] == "u"
    assert W.derive(head | {"warc-type": "request"}, b"") == W.derive({"warc-type": "response"}, b"") == []


def test_pages(spark):
    rows = [(1, "http://a/1", PAGE), (2, None, None), (None, "http://b\r\nEvil: 1", ""), (1, "http://a/1", PAGE)]
    got = W.read_back(W.derivatives(W.responses(spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)))).collect()
    assert len(got) == 8 and all(r.digest_ok for r in got)
    assert len({(r.page_id, r.record_id) for r in got}) == 6
    for r in got:
        if r.record_type == "conversion" and r.page_id == 1:
            assert r.block_digest == f"sha256:{hashlib.sha256(W.plain_text(PAGE).encode()).hexdigest()}" and r.target_uri == "http://a/1"
    assert {r.target_uri for r in got if r.page_id == 2} == {None} and {r.target_uri for r in got if r.page_id is None} == {"http://b Evil: 1"}
    assert W.read_back(W.derivatives(W.responses(spark.createDataFrame([], SCHEMA)))).collect() == []


@pytest.mark.parametrize("size", ["-37", "+3", "1_0", "", "x", "\u00b2", "99999999999999999999999", "400"])
def test_damaged_lengths_end_the_data(size):
    data = f"WARC/1.0\r\nContent-Length: {size}\r\n\r\n".encode()
    assert list(W.parse(data + b"abc\r\n\r\n")) == []
    good = W.serialise([("A", "1")], b"xy")
    assert [b for _, b in W.parse(good + data)] == [b"xy"]


@settings(max_examples=600, deadline=None)
@given(st.lists(st.one_of(st.sampled_from([b"WARC/1.0", b"\r\n", b"\r\n\r\n", b"Content-Length: ", b"-", b"7", b"WARC-Type: response\r\nWARC-Record-ID: <a>\r\n", b"HTTP/1.1 200 OK", "²".encode("latin-1"), b"Transfer-Encoding: chunked", b"Content-Encoding: gzip", b"charset=", b"\x1f\x8b\x08", b"<title>", b"&#xD800;"]), st.binary(max_size=3)), max_size=25).map(b"".join))
def test_any_bytes_end_without_an_error(data):
    for records in (W.parse(data), [({"warc-type": "response", "warc-record-id": "<a>"}, b"HTTP/1.1 200 OK\r\n" + data)]):
        for headers, block in records:
            for made in W.derive(headers, block):
                assert len(list(W.parse(made))) == 1


@pytest.mark.parametrize("code", ["²00", "-1", "2_0", "٢٠٠", "9" * 5000])
def test_status_is_plain_digits(code):
    assert W.http_parts(f"HTTP/1.1 {code} OK\r\n\r\n".encode("utf-8"))[0] == 0


def test_codings_and_charsets_are_undone():
    page = "<p>naïve é</p>"
    raw = page.encode()
    chunked = b"5;x=1\r\n" + raw[:5] + b"\r\n" + f"{len(raw) - 5:x}\r\n".encode() + raw[5:] + b"\r\n0\r\n\r\n"
    assert W.page_of([], raw) == page
    assert W.page_of([("Transfer-Encoding", "chunked")], chunked) == page
    assert W.page_of([("transfer-encoding", "chunked")], raw) == page  # decoded already
    for coding, data in (("gzip", gzip.compress(raw)), ("x-gzip", gzip.compress(raw[:4]) + gzip.compress(raw[4:])), ("deflate", zlib.compress(raw)), ("deflate", zlib.compress(raw)[2:-4]), ("br", raw), ("gzip", raw)):
        assert W.page_of([("Content-Encoding", coding)], data) == page
    assert W.page_of([("Content-Type", "text/html; charset=iso-8859-1")], page.encode("latin-1")) == page
    assert W.page_of([("Content-Type", "text/html; charset=punycode")], raw) == page
    assert len(W.page_of([("Content-Encoding", "gzip")], gzip.compress(bytes(5000)), 1000)) < 100  # too large: it stays as it is


def test_compressed_members_are_read():
    data = W.serialise([("WARC-Type", "x")], b"abc")
    assert [b for _, b in W.parse(gzip.compress(data) + gzip.compress(data))] == [b"abc", b"abc"]
    assert [b for _, b in W.parse(gzip.compress(data) + gzip.compress(data)[:-20])] == [b"abc"]
    assert list(W.parse(gzip.compress(data)[:-12])) == list(W.parse(b"\x1f\x8bjunk")) == []
