import base64
import gzip
import hashlib
import json
import re
import time
import zlib
from html.parser import HTMLParser

import pyarrow.parquet as pq
import pytest

from lakestone.llm import warc as W

PAGE = ("<!DOCTYPE html><html><head><title>A &amp; B</title><style>p{}</style><script>var t='</p>';</script></head>"
        "<body><!-- no --><p>First <b>bold</b> <a href='/x?a=1&amp;b=2'>link</a></p><p>Second&nbsp;line<br>third</p></body></html>")


def test_records_round_trip_and_link():
    made = W.response("http://a.example/x", PAGE)
    headers, block = W.parse(made)
    _, http, payload = W.split_http(block)
    assert payload.decode() == PAGE and http["Content-Length"] == str(len(payload))
    assert headers["WARC-Payload-Digest"] == "sha1:" + base64.b32encode(hashlib.sha1(payload).digest()).decode()
    assert headers["WARC-Block-Digest"] == W.digest(block)
    meta, text = W.derive(made)
    for x, kind in ((meta, "metadata"), (text, "conversion")):
        h, b = W.parse(x["record"])
        assert h["WARC-Type"] == kind and h["WARC-Refers-To"] == headers["WARC-Record-ID"] == x["refers_to"]
        assert all(h[k] == headers[k] for k in ("WARC-Date", "WARC-Target-URI", "WARC-Payload-Digest"))
        assert h["WARC-Block-Digest"] == W.digest(b) and b.decode() == x["text"] and h["Content-Length"] == str(len(b))
    assert text["text"] == "First bold link\nSecond line\nthird"
    about = json.loads(meta["text"])
    assert about["html"] == {"title": "A & B", "links": ["/x?a=1&b=2"]} and about["warc"] == headers
    assert len({headers["WARC-Record-ID"], meta["record_id"], text["record_id"]}) == 3
    assert W.derive(made) == W.derive(W.response("http://a.example/x", PAGE))
    assert W.derive(text["record"]) == []


def test_malformed_records_raise():
    made = W.response("u", "p")
    for broken in (made[:-20], b"HTTP/1.1 200 OK\r\n\r\n", made.replace(b"Content-Length: ", b"X: ")):
        with pytest.raises(ValueError):
            W.derive(broken)


def test_plain_text_of_odd_markup():
    assert W.plain_text("") == "" and W.plain_text("a < b and <unclosed") == "a < b and <unclosed"
    assert W.plain_text("<script>x") == "" and W.plain_text("<p>a</p><!-- open") == "a"
    assert W.plain_text("<DIV title='>'>x</DIV>y") == "x\ny"


def test_pages(spark):
    schema = "page_id long, url string, html string, record string, type string"
    rows = [(1, "http://a/", PAGE), (1, "http://a/", PAGE), (2, None, None), (3, "http://b/\r\nX: y", ""), (None, "u", "<p>" * 50_000 + "deep")]
    pages = spark.createDataFrame([(*r, "r", "t") for r in rows], schema)
    got = W.derivatives(W.responses(pages)).collect()
    assert len(got) == 2 * len(rows)
    assert len({r.record_id for r in got if r.page_id == 1}) == 2
    assert {r.target_uri for r in got if r.page_id == 3} == {"http://b/X: y"}
    assert [r.text for r in got if r.page_id is None and r.type == "conversion"] == ["deep"]
    for r in got:
        want = {x["type"]: x for x in W.derive(W.response(*[(u, h) for i, u, h in rows if i == r.page_id][0]))}[r.type]
        assert (r.record, r.refers_to, r.text) == (want["record"], want["refers_to"], want["text"])
    assert W.derivatives(W.responses(pages.limit(0))).count() == 0


def test_repeated_and_tight_headers_are_kept():
    block = b"HTTP/1.1 200 OK\r\nSet-Cookie: a=1\r\nset-cookie:b=2\r\nVia:\tx\r\n y\r\n\r\n<p>t"
    made = W.build([("WARC-Type", "response"), ("WARC-Record-ID", "<urn:x>"), ("WARC-Concurrent-To", "<urn:1>"),
                    ("WARC-Concurrent-To", "<urn:2>")], block).replace(b"WARC-Record-ID: ", b"warc-record-id:")
    meta, text = W.derive(made)
    about = json.loads(meta["text"])
    assert about["http"]["headers"] == [["Set-Cookie", "a=1"], ["set-cookie", "b=2"], ["Via", "x y"]]
    assert [v for k, v in about["warc"] if k == "WARC-Concurrent-To"] == ["<urn:1>", "<urn:2>"]
    assert meta["refers_to"] == text["refers_to"] == "<urn:x>"


class Reader(HTMLParser):
    """The standard library's parser, as an independent reading of text, title and links."""

    INLINE = set("a abbr b bdi bdo cite code data del dfn em i ins kbd label mark q s samp small span strong sub sup time tt u var wbr font".split())

    def __init__(self, page):
        super().__init__(convert_charrefs=True)
        self.parts, self.links, self.title, self.inside = [], [], None, []
        self.feed(page)
        self.close()
        lines = [re.sub(r"\s+", " ", x).strip() for x in "".join(self.parts).split("\n")]
        self.text = "\n".join(x for x in lines if x)

    def handle_starttag(self, tag, attrs):
        if tag in ("script", "style", "template", "noscript", "title"):
            self.inside.append(tag)
        elif tag not in self.INLINE:
            self.parts.append("\n")
        if not self.inside:
            self.links += [v or "" for k, v in attrs if k in ("href", "src")]

    handle_startendtag = handle_starttag

    def handle_endtag(self, tag):
        if self.inside and self.inside[-1] == tag:
            self.inside.pop()
        self.parts.append("" if tag in self.INLINE else "\n")

    def handle_data(self, data):
        if not self.inside:
            self.parts.append(data)
        elif self.inside[-1] == "title" and self.title is None:
            self.title = data.strip()


def test_text_and_links_equal_an_independent_parser():
    table = pq.read_table("/root/testdata/sf0.01/pages.parquet")
    pages = [PAGE] + [p for p in table["html"].to_pylist() if p]
    assert len(pages) > 50
    for page in pages:
        got, want = W.Page(page), Reader(page)
        lines = [re.sub(r"\s+", " ", x).strip() for x in got.text.split("\n")]
        assert [x for x in lines if x] == want.text.split("\n") or not want.text and not got.text, page
        assert got.links == want.links, page
        assert (got.title or None) == (re.sub(r"\s+", " ", want.title).strip() if want.title else None), page


@pytest.mark.parametrize("piece", ["<script ", "<a ", "<a \"", "<a '\"", "<!--", "<!", "<title>", "<script>", "</script ", "<a href=x ", "<", "<a b='>\"", "&lt;<p"])
@pytest.mark.parametrize("end", ["", ">", "\"", "\">"])
def test_time_grows_with_the_page(piece, end):
    page = piece * (2_000_000 // len(piece)) + end
    start = time.monotonic()
    W.Page(page)
    assert time.monotonic() - start < 20  # 2 MB: a second or so


def test_ten_megabytes_of_unclosed_tags():
    page = "<script " * (10_000_000 // 8)
    start = time.monotonic()
    assert W.plain_text(page).startswith("<script <script")
    assert time.monotonic() - start < 15


def response(head, body):
    return W.build([("WARC-Type", "response"), ("WARC-Record-ID", "<urn:r>")], b"HTTP/1.1 200 OK\r\n" + head + b"\r\n\r\n" + body)


def test_bodies_are_decoded_as_their_headers_say():
    page = "<p>Żółć ñ</p>"
    chunked = b"".join(b"%x;ext\r\n%s\r\n" % (len(c), c) for c in (page.encode()[:5], page.encode()[5:])) + b"0\r\n\r\n"
    raw = zlib.compressobj(wbits=-15)
    cases = [(b"Content-Type: text/html; charset=ISO-8859-2", page.encode("iso-8859-2", "replace"), page.encode("iso-8859-2", "replace").decode("iso-8859-2")),
             (b"Content-Type: text/html", b"<meta charset='utf-16-le'>", None), (b"X: y", page.encode(), page),
             (b"Content-Type: text/html; charset=nonsense", page.encode(), page),
             (b"Content-Type: text/html\r\nContent-Encoding: gzip", gzip.compress(page.encode()), page),
             (b"Content-Type: text/html\r\nContent-Encoding: deflate", zlib.compress(page.encode()), page),
             (b"Content-Type: text/html\r\nContent-Encoding: deflate", raw.compress(page.encode()) + raw.flush(), page),
             (b"Content-Type: text/html\r\nTransfer-Encoding: chunked", chunked, page)]
    for head, body, want in cases:
        meta, text = W.derive(response(head, body))
        assert want is None or text["text"] == want[3:-4], head
    latin = '<meta http-equiv="Content-Type" content="text/html; charset=latin-1"><p>ñ</p>'.encode("latin-1")
    assert W.derive(response(b"Content-Type: text/html", latin))[1]["text"] == "ñ"
    plain = W.derive(response(b"Content-Type: text/plain", b"a <b> c\n"))
    assert plain[1]["text"] == "a <b> c\n" and "html" not in json.loads(plain[0]["text"])


def test_bodies_that_are_no_text_have_metadata_only():
    for head, body in ((b"Content-Type: image/png", b"\x89PNG"), (b"Content-Type: application/pdf", b"%PDF"),
                       (b"Content-Type: text/html\r\nContent-Encoding: br", b"x"), (b"Content-Type: text/html\r\nContent-Encoding: gzip", b"no gzip")):
        found = W.derive(response(head, body))
        assert [x["type"] for x in found] == ["metadata"] and found[0]["n_links"] == 0
