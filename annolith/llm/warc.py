r"""Derivatives of web-archive responses: linked metadata and plain-text conversion records.

A response becomes two records that refer to it (``WARC-Refers-To``) and carry its target, its date and the digests of
the source: a *metadata* record (``application/warc-fields``: the response's HTTP status and headers, title, number of links, digests, and the
conversion's id) and a *conversion* record (``text/plain``).  Ids are derived from the response's, so a run that is repeated, or a task that is
lost, gives the same records.  Records are serialised as they stand in a file and are read back by the same reader as the input.

Text: comments, scripts, styles and the title go (unclosed ones to the end), block tags become line ends, other tags go, character references are
decoded, white space within lines is one space, and empty lines go.  All steps are linear in the page.

Nothing is shuffled: a response's derivatives are made where it is read.

Cases: a null page is an empty payload; a null target is left out of the headers and read back as null.  A response whose block isn't HTTP, or
has no end of head, is all payload, with status 0.  Chunked, gzip and deflate payloads are decoded for the text and the title, by the declared charset or as
UTF-8; digests are of the payload as it stands.  Bytes that the charset doesn't know are replaced.  A damaged record (no length, a length beyond the data) ends its column's value.  Records of other types and records without an id derive nothing.
Repeated responses give repeated derivatives with the same ids.  Other columns are ignored, whatever their names.  An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import html
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VERSION = "WARC/1.1"
DATE = "2024-01-01T00:00:00Z"
#: Tags that end a line.
BLOCK = "address|article|aside|blockquote|body|br|dd|div|dl|dt|fieldset|figcaption|figure|footer|form|h1|h2|h3|h4|h5|h6|head|header|hr|html|li|main|nav|ol|p|pre|section|table|td|th|tr|ul"
DROP = r"(?is)<!--.*?(?:-->|\Z)|<(?:script)\b.*?(?:</script\s*>|\Z)|<(?:style)\b.*?(?:</style\s*>|\Z)|<(?:title)\b.*?(?:</title\s*>|\Z)"
LINE = rf"(?i)</?(?:{BLOCK})\b[^<>]*>"
TAG = r"</?[a-zA-Z!?][^<>]*>"
TITLE = r"(?is)<title\b[^<>]*>(.*?)</title\s*>"
LINK = r"(?i)<a\b[^<>]*\bhref\s*="
_DROP, _LINE, _TAG, _LINK = (re.compile(x) for x in (DROP, LINE, TAG, LINK))
_OPEN, _CLOSE = (re.compile(x, re.IGNORECASE) for x in TITLE.replace("(?is)", "").split("(.*?)"))
_COUNT, _STATUS = re.compile(r"[0-9]{1,18}"), re.compile(r"[0-9]{1,9}")
_CHUNK, _CHARSET = re.compile(rb"([0-9A-Fa-f]{1,12})[^\r\n]{0,1000}\r\n"), re.compile(r"(?i)charset\s*=\s*[\"']?((?:utf-?8|utf-16(?:le|be)?|us-ascii|latin-?1|iso-8859-[0-9]{1,2}|windows-[0-9]{3,4}|cp[0-9]{3,4}|koi8-[ru]|gb2312|gbk|gb18030|big5|shift_jis|euc-(?:jp|kr)|iso-2022-jp)\b)")
#: Compressed data that would take more bytes than this stays as it is.
MOST = 1 << 28
_BLANK, _BREAK = re.compile(r"[ \t\r\f\v\xa0]+"), re.compile(r" ?\n[ \n]*")
_ID = "record_id string, record_type string, refers_to string, target_uri string, date string, content_type string, payload_digest string, block_digest string, content_length long"


def digest(data: bytes) -> str:
    return f"sha256:{hashlib.sha256(data).hexdigest()}"


def urn(*parts: str) -> str:
    h = hashlib.md5("\n".join(parts).encode(), usedforsecurity=False).hexdigest()
    return f"<urn:uuid:{h[:8]}-{h[8:12]}-{h[12:16]}-{h[16:20]}-{h[20:]}>"


def serialise(headers: list[tuple[str, str | None]], block: bytes) -> bytes:
    """A record as bytes; headers without a value are left out, line ends within values become spaces."""
    lines = [f"{k}: {re.sub(r'[\r\n]+', ' ', v)}" for k, v in headers if v is not None]
    return "\r\n".join([VERSION, *lines, f"Content-Length: {len(block)}", "", ""]).encode() + block + b"\r\n\r\n"


def inflated(data: bytes, wbits: int, most: int) -> bytes:
    """Compressed members one after another, as far as they are whole; ValueError beyond ``most`` bytes or without a whole member."""
    out, n = [], 0
    while data:
        member = zlib.decompressobj(wbits)
        try:
            part = member.decompress(data, most - n + 1)
        except zlib.error:
            break
        n += len(part)
        if n > most:
            raise ValueError("more bytes than allowed")
        if not member.eof:
            break
        out.append(part)
        data = member.unused_data
    if not out:
        raise ValueError("not compressed")
    return b"".join(out)


def parse(data: bytes, most: int = MOST) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers by lower-case name, block) of records one after another, gzip members or plain; a record that is damaged or cut off and all that follows it are left."""
    if data.startswith(b"\x1f\x8b"):
        try:
            data = inflated(data, 31, most)
        except ValueError:
            return
    at = 0
    while data.startswith(b"WARC/", at):
        end = data.find(b"\r\n\r\n", at)
        if end < 0:
            return
        lines = data[at:end].decode("utf-8", "replace").split("\r\n")[1:]
        headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
        size = headers.get("content-length", "")
        if not _COUNT.fullmatch(size) or end + 4 + int(size) > len(data):
            return
        at = end + 4 + int(size)
        yield headers, data[end + 4 : at]
        at += 4


def http_parts(block: bytes) -> tuple[int, list[tuple[str, str]], bytes]:
    """Status, headers in order and payload of an HTTP response."""
    end = block.find(b"\r\n\r\n")
    if not block.startswith(b"HTTP/") or end < 0:
        return 0, [], block
    first, *lines = block[:end].decode("latin-1").split("\r\n")
    code = first.split(" ")[1:2]
    return int(code[0]) if code and _STATUS.fullmatch(code[0]) else 0, [(k.strip(), v.strip()) for k, _, v in (x.partition(":") for x in lines)], block[end + 4 :]


def unchunked(body: bytes) -> bytes:
    """A chunked body's data, as far as its chunks are whole; the body itself if it doesn't begin with one."""
    out, at = [], 0
    while m := _CHUNK.match(body, at):
        size = int(m[1], 16)
        if not size or m.end() + size > len(body):
            break
        out.append(body[m.end() : m.end() + size])
        at = m.end() + size + 2
    return b"".join(out) if out or m else body


def page_of(http: list[tuple[str, str]], payload: bytes, most: int = MOST) -> str:
    """The payload as text: transfer and content codings undone (what can't be undone stays), and decoded by the declared charset if the web uses it, else as UTF-8."""
    header = {k.lower(): v for k, v in http}
    if "chunked" in header.get("transfer-encoding", "").lower():
        payload = unchunked(payload)
    for coding in reversed(header.get("content-encoding", "").lower().split(",")):
        for wbits in {"gzip": (31,), "x-gzip": (31,), "deflate": (15, -15)}.get(coding.strip(), ()):
            try:
                payload = inflated(payload, wbits, most)
                break
            except ValueError:
                continue
    named = _CHARSET.search(header.get("content-type", ""))
    try:
        return payload.decode(named[1] if named else "utf-8", "replace")
    except (LookupError, UnicodeError, ValueError):  # no text codec of that name
        return payload.decode("utf-8", "replace")


def plain_text(page: str) -> str:
    text = _TAG.sub("", _LINE.sub("\n", _DROP.sub("", page)))
    return _BREAK.sub("\n", _BLANK.sub(" ", html.unescape(text))).strip(" \n")


def title_of(page: str) -> str:
    a = _OPEN.search(page)
    b = _CLOSE.search(page, a.end()) if a else None
    return _BREAK.sub(" ", _BLANK.sub(" ", html.unescape(page[a.end() : b.start()]))).strip(" ") if b else ""


def derive(headers: dict[str, str], block: bytes) -> list[bytes]:
    """The serialised metadata and conversion records of a response; none for other records."""
    source = headers.get("warc-record-id")
    if headers.get("warc-type") != "response" or not source:
        return []
    status, http, payload = http_parts(block)
    page = page_of(http, payload)
    own = headers.get("warc-payload-digest") or digest(payload)
    text = plain_text(page).encode()
    conversion, metadata = urn(source, "conversion"), urn(source, "metadata")
    fields = [("http-status", str(status)), *[(f"http-header-{k.lower()}", v) for k, v in http], ("title", title_of(page)), ("links", str(len(_LINK.findall(page)))), ("source-payload-digest", own), ("source-block-digest", headers.get("warc-block-digest") or digest(block)), ("source-content-length", str(len(block))), ("conversion-record-id", conversion)]
    about = "".join(f"{k}: {re.sub(r'[\r\n]+', ' ', v)}\r\n" for k, v in fields).encode()
    out = []
    for kind, name, media, body in (("metadata", metadata, "application/warc-fields", about), ("conversion", conversion, "text/plain; charset=UTF-8", text)):
        head = [("WARC-Type", kind), ("WARC-Record-ID", name), ("WARC-Refers-To", source), ("WARC-Target-URI", headers.get("warc-target-uri")), ("WARC-Date", headers.get("warc-date")), ("WARC-Block-Digest", digest(body)), ("WARC-Payload-Digest", own if kind == "metadata" else digest(body)), ("Content-Type", media)]
        out.append(serialise(head, body))
    return out


def responses(pages: DataFrame, page_id: str = "page_id", url: str = "url", body: str = "html", date: str = DATE) -> DataFrame:
    """(page_id, record): pages as serialised HTTP responses."""
    rows = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), F.col(body).alias("html"))

    def run(batches):
        for batch in batches:
            out = []
            for page, target, text in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                payload = (text or "").encode()
                block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode() + payload
                head = [("WARC-Type", "response"), ("WARC-Record-ID", urn("" if page is None else str(page), target or "")), ("WARC-Target-URI", target), ("WARC-Date", date), ("WARC-Block-Digest", digest(block)), ("WARC-Payload-Digest", digest(payload)), ("Content-Type", "application/http; msgtype=response")]
                out.append(serialise(head, block))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], ["page_id", "record"])

    return rows.mapInArrow(run, f"page_id {rows.schema[0].dataType.simpleString()}, record binary")


def derivatives(records: DataFrame, record: str = "record", key: str = "page_id") -> DataFrame:
    """(key, record): a serialised metadata and a conversion record for each response in the column of serialised records."""
    rows = records.select(F.col(key).alias(key), F.col(record).alias("record"))

    def run(batches):
        for batch in batches:
            made = [[d for h, b in parse(r or b"") for d in derive(h, b)] for r in batch.column(1).to_pylist()]
            at = pa.array([i for i, m in enumerate(made) for _ in m], pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), pa.array([d for m in made for d in m], pa.binary())], [key, "record"])

    return rows.mapInArrow(run, f"{key} {rows.schema[0].dataType.simpleString()}, record binary")


def read_back(records: DataFrame, key: str = "page_id") -> DataFrame:
    """Headers of serialised records, the digest of each block as it stands, and whether it equals the one in the headers."""
    names = [f.split()[0] for f in _ID.split(", ")]

    def run(batches):
        for batch in batches:
            at, out, actual = [], [], []
            for i, raw in enumerate(batch.column(1).to_pylist()):
                for h, block in parse(raw or b""):
                    at.append(i)
                    out.append((h.get("warc-record-id"), h.get("warc-type"), h.get("warc-refers-to"), h.get("warc-target-uri"), h.get("warc-date"), h.get("content-type"), h.get("warc-payload-digest"), h.get("warc-block-digest"), len(block)))
                    actual.append(digest(block))
            columns = [pa.array([r[c] for r in out], pa.int64() if n == "content_length" else pa.string()) for c, n in enumerate(names)]
            good = pa.array([a == r[7] for a, r in zip(actual, out, strict=True)], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int32())), *columns, good], [key, *names, "digest_ok"])

    rows = records.select(key, "record")
    return rows.mapInArrow(run, f"{key} {rows.schema[0].dataType.simpleString()}, {_ID}, digest_ok boolean")


def derivatives_sql() -> str:
    """DuckDB SQL of the derivatives of ``pages``; the references decoded are those that the tables hold."""
    q = lambda s: s.replace("'", "''").replace(r"\Z", r"\z")
    decode = lambda c: f"replace(replace(replace(replace(replace(replace({c}, '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&copy;', '©'), '&middot;', '·'), '&amp;', '&')"
    uid = lambda h: f"'<urn:uuid:' || substr({h}, 1, 8) || '-' || substr({h}, 9, 4) || '-' || substr({h}, 13, 4) || '-' || substr({h}, 17, 4) || '-' || substr({h}, 21) || '>'"
    clean = lambda c: rf"trim(regexp_replace(regexp_replace({c}, '[ \t\r\f\v\x{{a0}}]+', ' ', 'g'), ' ?\n[ \n]*', chr(10), 'g'), ' ' || chr(10))"
    nl = "chr(13) || chr(10)"
    head = f"'HTTP/1.1 200 OK' || {nl} || 'Content-Type: text/html; charset=UTF-8' || {nl} || 'Content-Length: ' || CAST(strlen(h) AS VARCHAR) || {nl} || {nl}"
    title = clean(decode(f"regexp_extract(h, '{q(TITLE)}', 1)")).replace("chr(10), 'g')", "' ', 'g')")
    fields = [
        "'http-status: 200'", "'http-header-content-type: text/html; charset=UTF-8'", "'http-header-content-length: ' || CAST(strlen(h) AS VARCHAR)", "'title: ' || title", "'links: ' || CAST(links AS VARCHAR)",
        "'source-payload-digest: sha256:' || sha256(h)", "'source-block-digest: sha256:' || sha256(head || h)", "'source-content-length: ' || CAST(strlen(head || h) AS VARCHAR)", "'conversion-record-id: ' || conv",
    ]
    about = f" || {nl} || ".join(fields) + f" || {nl}"
    return rf"""
WITH p AS (SELECT page_id, url, coalesce(html, '') AS h, md5(coalesce(CAST(page_id AS VARCHAR), '') || chr(10) || coalesce(url, '')) AS m FROM pages),
r AS (SELECT *, {uid("m")} AS source, {head} AS head, {title} AS title, len(regexp_extract_all(h, '{q(LINK)}')) AS links,
  {clean(decode(f"regexp_replace(regexp_replace(regexp_replace(h, '{q(DROP)}', '', 'g'), '{q(LINE)}', chr(10), 'g'), '{q(TAG)}', '', 'g')"))} AS t FROM p),
i AS (SELECT *, md5(source || chr(10) || 'conversion') AS mc, md5(source || chr(10) || 'metadata') AS mm FROM r),
k AS (SELECT *, {uid("mc")} AS conv, {uid("mm")} AS meta FROM i), f AS (SELECT *, {about} AS about FROM k)
SELECT page_id, meta AS record_id, 'metadata' AS record_type, source AS refers_to, url AS target_uri, '{DATE}' AS date, 'application/warc-fields' AS content_type,
  'sha256:' || sha256(h) AS payload_digest, 'sha256:' || sha256(about) AS block_digest, CAST(strlen(about) AS BIGINT) AS content_length, true AS digest_ok FROM f
UNION ALL SELECT page_id, conv, 'conversion', source, url, '{DATE}', 'text/plain; charset=UTF-8', 'sha256:' || sha256(t), 'sha256:' || sha256(t), CAST(strlen(t) AS BIGINT), true FROM f"""
