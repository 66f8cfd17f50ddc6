"""WARC derivatives: response records become linked metadata and plain-text conversion records.

Each derived record refers to its response by record id and keeps the response's target
URI, date and payload digest; its own block digest covers what it holds.  Record ids are
name-based (SHA-1 of type, source and content), so a task that runs again writes the same
records.
"""

from __future__ import annotations

import base64
import hashlib
import html
import json
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DATE = "2024-01-01T00:00:00Z"
_SPACE = uuid.UUID("6f0d5cbe-8b6a-5f3a-9d43-1c64b0a4f7f2")
_NAME = re.compile(r"[a-zA-Z][a-zA-Z0-9:-]*")
#: A tag without angle brackets inside, quoted or not: the common case, found in one step.
_PLAIN_TAG = re.compile(r"""<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^<>"']|"[^"<>]*"|'[^'<>]*')*+)>""")
_STOP = re.compile(r"""[>"']""")
_ATTRIBUTE = re.compile(r"""(?<=[\s"'/])(?:href|src)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+))""", re.I)
_CHARSET = re.compile(rb"""<meta\b[^>]{0,512}?charset\s*=\s*["']?\s*([A-Za-z0-9_.:-]+)""", re.I)
#: Elements whose content is not shown; that of a title is not part of the text either.
_HIDDEN = frozenset(("script", "style", "template", "noscript"))
_CLOSING = {kind: re.compile(f"</{kind}", re.I | re.A) for kind in (*_HIDDEN, "title")}
_BLANKS = re.compile(r"[^\S\n]+")
_LINES = re.compile(r" ?\n[ \n]*")
#: Elements that stay within a line; every other tag breaks it.
_INLINE = frozenset("a abbr b bdi bdo cite code data del dfn em i ins kbd label mark q s samp small span strong sub sup "
                    "time tt u var wbr font".split())


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(kind: str, *parts: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(_SPACE, chr(0).join((kind, *parts)))}>"


def build(headers: list[tuple[str, str]], block: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in [*headers, ("Content-Length", str(len(block)))])
    return b"WARC/1.1\r\n" + head.encode() + b"\r\n" + block + b"\r\n\r\n"


class Headers(list):
    """[name, value] of each header in order; a name stands for its first value, in any case."""

    def __init__(self, lines: list[str]):
        super().__init__()
        for line in lines:
            name, colon, value = line.partition(":")
            if line[:1] in (" ", "\t") and self:  # goes on from the line before
                self[-1][1] += " " + line.strip(" \t")
            elif colon:
                self.append([name.rstrip(" \t"), value.strip(" \t")])

    def get(self, name: str, default: str | None = None) -> str | None:
        return next((v for k, v in self if k.lower() == name.lower()), default)

    def __getitem__(self, at):
        if not isinstance(at, str):
            return super().__getitem__(at)
        if (found := self.get(at)) is None:
            raise KeyError(at)
        return found

    def __contains__(self, name: object) -> bool:
        return self.get(name) is not None if isinstance(name, str) else super().__contains__(name)


def parse(record: bytes) -> tuple[Headers, bytes]:
    """Headers and block of one record; a malformed one raises ValueError."""
    head, found, rest = record.partition(b"\r\n\r\n")
    first, *lines = head.decode("utf-8", "replace").split("\r\n")
    if not found or not first.startswith("WARC/"):
        raise ValueError("not a WARC record")
    headers = Headers(lines)
    size = int(headers.get("Content-Length", "-1"))
    if size < 0 or len(rest) < size:
        raise ValueError("block shorter than Content-Length")
    return headers, rest[:size]


def split_http(block: bytes) -> tuple[str, Headers, bytes]:
    head, _, payload = block.partition(b"\r\n\r\n")
    status, *lines = head.decode("latin-1").split("\r\n")
    return status, Headers(lines), payload


class Page:
    """What a page shows: ``text``, ``title`` (None without one) and ``links`` (href and src of its tags).

    One scan from left to right.  A tag ends at the first ``>`` outside quotes; a ``<`` that begins
    no tag, or one that never ends, is a character.  Comments and hidden elements that are
    never closed reach to the end of the page.  Time grows with the page's length, whatever
    its markup: a quote from which no end was found is not tried again.
    """

    def __init__(self, page: str):
        self.title: str | None = None
        self.links: list[str] = []
        self._page = page
        self._last, self._next = page.rfind(">"), -1
        # Quotes from which no end was found, and elements that no closing tag follows any more.
        self._dead: set[int] = set()
        self._open: set[str] = set()
        parts: list[str] = []
        at = 0
        while (begin := page.find("<", at)) >= 0:
            parts.append(page[at:begin])
            at, shown = self._markup(begin)
            parts.append(shown)
        parts.append(page[at:])
        self.text = _LINES.sub("\n", _BLANKS.sub(" ", html.unescape("".join(parts)))).strip()

    def _markup(self, begin: int) -> tuple[int, str]:
        """Where the markup at ``begin`` ends, and what stands for it in the text."""
        page = self._page
        if plain := _PLAIN_TAG.match(page, begin):
            closing, kind, inside = plain.groups()
            kind, begin, end = kind.lower(), plain.start(3), plain.end()
            links = "=" in inside
        elif page.startswith("<!--", begin):
            end = page.find("-->", begin + 4)
            return (end + 3 if end >= 0 else len(page)), " "
        elif page[begin + 1:begin + 2] in ("!", "?"):
            end = page.find(">", begin) if begin < self._last else -1
            return (end + 1, "\n") if end >= 0 else (begin + 1, "<")
        else:
            closing, links = page.startswith("/", begin + 1), True
            name = _NAME.match(page, begin + 1 + closing)
            end = self._end(name.end()) if name else -1
            if end < 0:
                return begin + 1, "<"
            kind, begin = name[0].lower(), name.end()
        if closing:
            return end, "" if kind in _INLINE else "\n"
        if kind in _HIDDEN:
            return self._after(kind, end)[1], " "
        if kind == "title":
            inside, after = self._after(kind, end)
            if after > inside:  # closed
                if self.title is None:
                    self.title = _BLANKS.sub(" ", html.unescape(page[end:inside])).strip()
                return after, "\n"
            return end, "\n"
        if links:
            self.links += [html.unescape(a or b or c) for a, b, c in _ATTRIBUTE.findall(page, begin, end)]
        return end, "" if kind in _INLINE else "\n"

    def _end(self, at: int) -> int:
        """After the ``>`` that ends the tag whose name ends at ``at``, or -1."""
        tried: list[int] = []
        while at <= self._last:
            if self._next < at:  # the next stop of an earlier scan serves as long as it lies ahead
                self._next = _STOP.search(self._page, at).start()
            stop = self._next
            if self._page[stop] == ">":
                return stop + 1
            if stop in self._dead:
                break
            tried.append(stop)
            at = self._page.find(self._page[stop], stop + 1) + 1
            if not at:
                break
        self._dead.update(tried)
        return -1

    def _after(self, kind: str, at: int) -> tuple[int, int]:
        """Where the element's content ends, and where its closing tag does; the page's end twice if it is never closed."""
        while kind not in self._open and (found := _CLOSING[kind].search(self._page, at)):
            close, rest = found.span()
            while rest < len(self._page) and self._page[rest].isspace():
                rest += 1
            if self._page.startswith(">", rest):
                return close, rest + 1
            at = rest
        self._open.add(kind)
        return len(self._page), len(self._page)


def plain_text(page: str) -> str:
    """Visible text: scripts, styles and comments go, block elements break lines, entities are resolved."""
    return Page(page).text


def _unchunked(payload: bytes) -> bytes:
    """A chunked body's content, as far as its chunks are whole."""
    out, at = [], 0
    while (line := payload.find(b"\r\n", at)) >= 0:
        try:
            size = int(payload[at:line].split(b";")[0], 16)
        except ValueError:
            break
        if size <= 0:
            break
        out.append(payload[line + 2:line + 2 + size])
        at = line + 4 + size
    return b"".join(out)


def content(http: Headers, payload: bytes) -> tuple[str, str | None]:
    """(media type, text) of an HTTP body; None for what is no text, or encoded in a way that is not known here.

    Chunks are put together and gzip and deflate undone.  The charset is the header's, else
    the page's own, else UTF-8; bytes that it does not know are replaced.  A body without a
    type is taken as HTML.
    """
    media, *params = (http.get("Content-Type") or "text/html").split(";")
    media = media.strip().lower()
    if (http.get("Transfer-Encoding") or "").strip().lower() == "chunked":
        payload = _unchunked(payload)
    coding = (http.get("Content-Encoding") or "identity").strip().lower()
    try:
        if coding in ("gzip", "x-gzip", "deflate"):
            raw = zlib.decompressobj(47 if coding != "deflate" or payload[:1] == b"\x78" else -15)
            payload = raw.decompress(payload)
        elif coding != "identity":
            return media, None
    except zlib.error:
        return media, None
    if not media.startswith("text/") and media != "application/xhtml+xml":
        return media, None
    named = [v.strip().strip("\"'") for k, _, v in (p.partition("=") for p in params) if k.strip().lower() == "charset"]
    meta = _CHARSET.search(payload[:4096]) if media != "text/plain" else None
    charset = named[0] if named else meta[1].decode() if meta else "utf-8"
    try:
        return media, payload.decode(charset, "replace")
    except (LookupError, ValueError):
        return media, payload.decode("utf-8", "replace")


def _uri(url: str) -> str:
    return re.sub(r"[\r\n]", "", url)


def response(url: str | None, page: str | None, date: str = DATE) -> bytes:
    payload = (page or "").encode()
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n"
    block, uri = http.encode() + payload, _uri(url or "")
    return build([("WARC-Type", "response"), ("WARC-Record-ID", record_id("response", uri, date, digest(block))),
                  ("WARC-Date", date), ("WARC-Target-URI", uri), ("WARC-Payload-Digest", digest(payload)),
                  ("WARC-Block-Digest", digest(block)), ("Content-Type", "application/http; msgtype=response")], block)


def derive(record: bytes) -> list[dict]:
    """The metadata and conversion records of a response record; other record types have none.

    A body that is no text (see ``content``) has a metadata record only; plain text is converted as it is.
    """
    source, block = parse(record)
    if source.get("WARC-Type") != "response":
        return []
    status, http, payload = split_http(block)
    media, body = content(http, payload)
    page = Page(body) if body is not None and media != "text/plain" else None
    kept = [(k, source[k]) for k in ("WARC-Date", "WARC-Target-URI", "WARC-Payload-Digest") if k in source]
    kept.insert(0, ("WARC-Refers-To", source["WARC-Record-ID"]))
    about = {"warc": source, "http": {"status": status, "headers": http}}
    if page:
        about["html"] = {"title": page.title, "links": page.links}
    title, n_links = (page.title, len(page.links)) if page else (None, 0)
    texts = [("metadata", "application/json", json.dumps(about, ensure_ascii=False, sort_keys=True))]
    if body is not None:
        texts.append(("conversion", "text/plain; charset=utf-8", page.text if page else body))
    out = []
    for kind, media, body in texts:
        data = body.encode("utf-8", "replace")
        ident = record_id(kind, source["WARC-Record-ID"], digest(data))
        headers = [("WARC-Type", kind), ("WARC-Record-ID", ident), *kept, ("WARC-Block-Digest", digest(data)),
                   ("Content-Type", media)]
        out.append({"type": kind, "record_id": ident, "refers_to": source["WARC-Record-ID"],
                    "target_uri": source.get("WARC-Target-URI"), "date": source.get("WARC-Date"),
                    "payload_digest": source.get("WARC-Payload-Digest"), "block_digest": digest(data),
                    "content_length": len(data), "title": title if kind == "metadata" else None,
                    "n_links": n_links if kind == "metadata" else None, "text": body, "record": build(headers, data)})
    return out


DERIVED = ("type string, record_id string, refers_to string, target_uri string, date string, payload_digest string, "
           "block_digest string, content_length long, title string, n_links int, text string, record binary")
_FIELDS = [f.split()[0] for f in DERIVED.split(", ")]
_ARROW = pa.schema([(n, {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}.get(t, pa.string()))
                    for n, t in (f.split() for f in DERIVED.split(", "))])


def _flushed(keys: list, found: list[dict], key_type: pa.DataType) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(keys, key_type), *(pa.array([f[n] for f in found], _ARROW.field(n).type) for n in _FIELDS)],
        names=["_key", *_FIELDS])


def responses(pages: DataFrame, key: str = "page_id", url: str = "url", page: str = "html", date: str = DATE) -> DataFrame:
    """(key, record): one WARC response record for every page.

    Null URLs and pages are written as empty; repeated rows give equal records.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = [response(u, h, date) for u, h in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(made, pa.binary())], names=["key", "record"])

    kind = pages.schema[key].dataType.simpleString()
    out = pages.select(F.col(key).alias("key"), F.col(url).cast("string").alias("url"), F.col(page).cast("string").alias("html"))
    return out.mapInArrow(run, f"key {kind}, record binary").withColumnRenamed("key", key)


def derivatives(records: DataFrame, key: str = "page_id", record: str = "record") -> DataFrame:
    """Two rows (metadata, conversion) for every response record in ``records``; one where the body is no text.

    Null records and records of other types have none; a malformed record fails the job.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys: list = []
            found: list[dict] = []
            load = 0
            for k, r in zip(b.column(0), b.column(1), strict=True):
                data = r.as_py()
                for x in derive(data) if data is not None else ():
                    keys.append(k.as_py())
                    found.append(x)
                    load += 2 * x["content_length"]
                if load > 1 << 24:
                    yield _flushed(keys, found, b.column(0).type)
                    keys, found, load = [], [], 0
            if keys:
                yield _flushed(keys, found, b.column(0).type)

    kind = records.schema[key].dataType.simpleString()
    out = records.select(F.col(key).alias("_key"), F.col(record).alias("_record")).mapInArrow(run, f"_key {kind}, {DERIVED}")
    return out.withColumnRenamed("_key", key)
