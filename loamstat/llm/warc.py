"""WARC derivative builder: responses to linked metadata and conversion records.

Every response record yields two derived records that point back to it:

* ``metadata`` (application/warc-fields): title, language, charset, outlinks
  and the source's headers and digests, one field a line;
* ``conversion`` (text/plain): the visible text of the HTML payload.

``WARC-Refers-To`` holds the response's record id, the target URI and date are
carried over, and source headers and digests are preserved both as fields and
as a map column.  They come from the optional columns of ``SOURCE``; where such a
column is absent or null, a date, a plain HTTP head, a record id and digests are
made up from the page (the given pages table has none of them).  Record ids are name-based UUIDs of type, id and URI and
digest, so a rebuilt derivative has the same ids.  All of it is a map over
the responses: no shuffle.

Edge cases: a null URL leaves the target URI out; null HTML is an empty
payload; an unclosed script or comment hides nothing, an unclosed tag is
text, and no page takes more than time in proportion to its length; repeated rows give equal records with equal ids.
"""

from __future__ import annotations

import hashlib
import html
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # the URL namespace of RFC 4122
_HIDDEN = re.compile(r"<!--|<!doctype[^>]*>|<(script|style|noscript|template)\b[^>]*>", re.I)
_HEAD = re.compile(r"<(head)\b[^>]*>", re.I)
_TITLE = re.compile(r"<(title)\b[^>]*>", re.I)
_BLOCK = re.compile(r"</?(?:p|div|br|li|ul|ol|h[1-6]|tr|table|section|article|header|footer|nav|main|aside|blockquote|pre|body|html|title|dd|dt|dl|form|hr)\b[^>]*>", re.I)
_TAG = re.compile(r"<[a-zA-Z/][^>]*>")
_FIELD_TAG = re.compile(r"<(html|meta|a)\b[^>]*>", re.I)
_LANG = re.compile(r"\blang\s*=\s*[\"']?([\w-]+)", re.I)
_CHARSET = re.compile(r"\bcharset\s*=\s*[\"']?([\w-]+)", re.I)
_LINK = re.compile(r"\bhref\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_SPACES, _LINES = re.compile(r"[ \t\r\f\v\xa0]+"), re.compile(r" ?\n[ \n]*")
_CLOSERS = {name: re.compile(rf"</{name}\s*>", re.I) for name in ("script", "style", "noscript", "template", "head", "title")} | {"": re.compile("-->")}


def closed(page: str) -> tuple[str, str]:
    """The page up to its last ``>``, and the rest, which holds no whole tag.

    Before the last ``>`` every ``[^>]*>`` finds its end at the first try, so the
    patterns here take time in proportion to the page.
    """
    end = page.rfind(">") + 1
    return page[:end], page[end:]


def elements(page: str, opener: re.Pattern) -> Iterator[tuple[int, int, int, int]]:
    """``(start, inner from, inner to, end)`` of the elements ``opener`` begins, in order and not nested.

    An element without an end tag is none; that a kind has no further end tag is found out once.
    """
    at, open_ended = 0, set()
    while found := opener.search(page, at):
        at = found.end()
        kind = (found[1] or "").lower()
        if not kind and found[0] != "<!--":
            yield found.start(), at, at, at  # a doctype
            continue
        if kind in open_ended:
            continue
        end = _CLOSERS[kind].search(page, at)
        if end is None:
            open_ended.add(kind)
            continue
        yield found.start(), at, end.start(), end.end()
        at = end.end()


def without(page: str, opener: re.Pattern, instead: str) -> str:
    """The page with the elements replaced."""
    kept, at = [], 0
    for start, _, _, end in elements(page, opener):
        kept += [page[at:start], instead]
        at = end
    return "".join([*kept, page[at:]])


def plain_text(page: str) -> str:
    """Visible text: hidden parts and the head dropped, block tags as line feeds, entities decoded."""
    whole, rest = closed(page)
    whole, more = closed(without(without(whole, _HIDDEN, " "), _HEAD, ""))
    text = _TAG.sub("", _BLOCK.sub("\n", whole)) + more + rest
    return _LINES.sub("\n", _SPACES.sub(" ", html.unescape(text))).strip()


def page_fields(page: str) -> list[tuple[str, str]]:
    """Title, language, charset and outlinks, in this order."""
    whole = closed(page)[0]
    plain = lambda x: _SPACES.sub(" ", html.unescape(x)).replace("\n", " ").strip()
    title = next((plain(whole[a:b]) for _, a, b, _ in elements(whole, _TITLE)), "")
    first: dict[str, str] = {}
    for tag in _FIELD_TAG.finditer(whole):
        name, pattern = {"html": ("language", _LANG), "meta": ("charset", _CHARSET)}.get(tag[1].lower(), ("", None))
        if pattern and name not in first and (m := pattern.search(tag[0])):
            first[name] = plain(m[1])
    found = [("title", title), ("language", first.get("language", "")), ("charset", first.get("charset", ""))]
    shown = closed(without(whole, _HIDDEN, " "))[0]
    tags = [_LINK.search(t[0]) for t in _FIELD_TAG.finditer(shown) if t[1].lower() == "a"]
    links = [html.unescape(next(g for g in m.groups() if g is not None)).strip() for m in tags if m]
    return [f for f in found if f[1]] + [("outlink", x.replace("\n", "").replace("\r", "")) for x in links]


def sha256_label(data: bytes) -> str:
    return "sha256:" + hashlib.sha256(data).hexdigest()


def record_id(kind: str, *parts: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(_SPACE, chr(0).join((kind, *parts)))}>"


def render(headers: list[tuple[str, str]], block: bytes) -> bytes:
    """One WARC/1.1 record."""
    lines = "".join(f"{k}: {v}\r\n" for k, v in headers)
    return b"WARC/1.1\r\n" + lines.encode() + b"\r\n" + block + b"\r\n\r\n"


def parse(record: bytes) -> tuple[list[tuple[str, str]], bytes]:
    """Headers and block of one record; checks the length and the block digest."""
    head, _, rest = record.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError("not a WARC/1.1 record")
    headers = [tuple(x.split(": ", 1)) for x in lines[1:]]
    by = dict(headers)
    block = rest[: int(by["Content-Length"])]
    if rest[len(block) :] != b"\r\n\r\n" or by["WARC-Block-Digest"] != sha256_label(block):
        raise ValueError("a record's length or digest doesn't fit its block")
    return headers, block


#: Optional columns of the source response: its WARC record id and date, its HTTP head as received
#: (status line and headers) and its digests.
SOURCE = ("warc_record_id", "warc_date", "http_head", "payload_digest", "block_digest")

_SCHEMA = pa.schema(
    [
        ("page_id", pa.int64()), ("record_type", pa.string()), ("record_id", pa.string()), ("refers_to", pa.string()), ("target_uri", pa.string()),
        ("warc_date", pa.string()), ("content_type", pa.string()), ("content_length", pa.int64()), ("block_digest", pa.string()), ("payload_digest", pa.string()),
        ("source_headers", pa.string()), ("record", pa.binary()),
    ]
)
_DDL = (
    "page_id long, record_type string, record_id string, refers_to string, target_uri string, warc_date string, content_type string, "
    "content_length long, block_digest string, payload_digest string, source_headers string, record binary"
)


def _line(x: str) -> str:
    return x.replace("\r", " ").replace("\n", " ")


def response_block(page: str, head: str | None = None) -> bytes:
    """The HTTP response: with the head as received, or one that is made up."""
    body = page.encode()
    if head is not None:
        return "\r\n".join(head.strip("\r\n").splitlines()).encode() + b"\r\n\r\n" + body
    return f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(body)}\r\n\r\n".encode() + body


def _build(page_id: int | None, url: str | None, page: str, date: str, responses: bool, given: dict) -> Iterator[dict]:
    block = response_block(page, given.get("http_head"))
    date = given.get("warc_date") or date
    payload = given.get("payload_digest") or sha256_label(block.partition(b"\r\n\r\n")[2])
    http = [(k, v.strip()) for k, _, v in (x.partition(":") for x in block.partition(b"\r\n\r\n")[0].decode().split("\r\n")[1:])]
    source = given.get("warc_record_id") or record_id("response", str(page_id), url or "", payload)
    uri = [("WARC-Target-URI", _line(url))] if url else []

    def made(kind: str, content_type: str, data: bytes, refers: str | None, of_payload: str | None) -> dict:
        name = record_id(kind, str(page_id), url or "", payload) if refers else source
        mark = sha256_label(data)
        headers = [("WARC-Type", kind), ("WARC-Record-ID", name), ("WARC-Date", date), *uri]
        headers += [("WARC-Refers-To", refers)] if refers else []
        headers += [("WARC-Payload-Digest", of_payload)] if of_payload else []
        headers += [("WARC-Block-Digest", mark), ("Content-Type", content_type), ("Content-Length", str(len(data)))]
        return {
            "page_id": page_id, "record_type": kind, "record_id": name, "refers_to": refers, "target_uri": url, "warc_date": date, "content_type": content_type,
            "content_length": len(data), "block_digest": mark, "payload_digest": payload, "source_headers": "\n".join(f"{k}: {v}" for k, v in http), "record": render(headers, data),
        }

    if responses:
        yield made("response", "application/http; msgtype=response", block, None, payload)
    fields = [*page_fields(page), ("source-record-id", source), ("source-payload-digest", payload), ("source-block-digest", given.get("block_digest") or sha256_label(block))]
    fields += [(f"source-header-{k.lower()}", v) for k, v in http]
    yield made("metadata", "application/warc-fields", "".join(f"{k}: {v}\r\n" for k, v in fields).encode(), source, None)
    yield made("conversion", "text/plain; charset=utf-8", plain_text(page).encode(), source, None)


def derivatives(pages: DataFrame, date: str = "2024-01-01T00:00:00Z", responses: bool = False) -> DataFrame:
    """Metadata and conversion records (and, if asked for, the responses) of every page.

    ``record`` holds the serialised record, ``payload_digest`` the digest of
    the response's payload, ``source_headers`` its HTTP headers.  Columns of
    ``SOURCE`` are carried through; ``date`` and the rest stand in where they are absent.
    """
    carried = [c for c in SOURCE if c in pages.columns]

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 128):
                rows = [r for x in b.slice(at, 128).to_pylist() for r in _build(x["page_id"], x["url"], x["html"] or "", date, responses, {c: x[c] for c in carried})]
                yield pa.RecordBatch.from_pylist(rows, schema=_SCHEMA)

    source = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"), *[F.col(c).cast("string").alias(c) for c in carried])
    return source.mapInArrow(build, _DDL)
