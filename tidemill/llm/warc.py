"""WARC derivative builder: responses become linked metadata and plain-text conversion records.

Records are rows (type, id, headers, block); ``warc_bytes`` and ``read_records`` turn them into WARC/1.1 bytes
and back. A derivative keeps its source in WARC-Refers-To, with the source's target URI, date and payload
digest as headers, and has digests of its own. Pages are handled where they lie, without a shuffle, and files
are read record by record.
"""

from __future__ import annotations

import base64
import hashlib
import html
import re
import uuid
import zlib
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Record ids are UUIDs of a record's source and kind under this namespace, so that a rerun links alike.
NAMESPACE = uuid.UUID("6f1c2a52-6a7a-5c0b-8a37-0d6b1a3f7f11")
DEFAULT_DATE = "1970-01-01T00:00:00Z"
CRLF = "\r\n"

#: Comments and elements whose content is no markup: they end with the page if they are not closed.
_RAW = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style|title)\b[^>]*>.*?(?:</\1\s*>|\Z)", re.I | re.S)
#: Elements that are not shown; of one that is not closed, only the tag goes.
_HIDDEN = re.compile(r"<(/?)(template|noscript|svg|iframe|nav)\b[^>]*>", re.I)
_TITLE = re.compile(r"<title\b[^>]*>(.*?)(?:</title\s*>|\Z)", re.I | re.S)
_LANG = re.compile(r"<html\b[^>]*?\blang\s*=\s*[\"']?([A-Za-z0-9-]+)", re.I)
_LINK = re.compile(r"<a\b[^>]*?\bhref\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_BREAK = re.compile(r"<(?:/?(?:p|div|article|section|header|footer|main|aside|h[1-6]|ul|ol|li|table|tr|td|th|thead|tbody|blockquote|pre|form|figure|dl|dt|dd|nav|svg|iframe|template|noscript)|br|hr)\b[^>]*>", re.I)
_TAG = re.compile(r"<[A-Za-z/!?][^>]*(?:>|\Z)")
_BLANK = re.compile(r"[^\S\n]+")


def digest(data: bytes) -> str:
    """A labelled digest as WARC headers carry it: base 32 of SHA-1."""
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(*parts: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(NAMESPACE, '|'.join(parts))}>"


def _shown(page: str) -> str:
    """The page without hidden elements."""
    tags = list(_HIDDEN.finditer(page))
    closed: dict[str, list[tuple[int, int]]] = {}
    for m in tags:
        if m[1]:
            closed.setdefault(m[2].lower(), []).append(m.span())
    out, at = [], 0
    for m in tags:
        ends = closed.get(m[2].lower(), [])
        k = bisect_left(ends, m.span())
        if not m[1] and m.start() >= at and k < len(ends):
            out.append(page[at : m.start()])
            at = ends[k][1]
    return " ".join([*out, page[at:]])


def plain_text(page: str) -> str:
    """Visible text of an HTML page: one line a block, runs of blanks as one space, entities resolved.

    Tags that HTML lets out, as </head>, and elements that are never closed lose no text but scripts, styles and titles.
    """
    text = _TAG.sub("", _BREAK.sub("\n", _shown(_RAW.sub(" ", page))))
    lines = (_BLANK.sub(" ", x).strip() for x in html.unescape(text).split("\n"))
    return "\n".join(x for x in lines if x)


def facts(page: str) -> list[tuple[str, str]]:
    """Fields of a metadata record: title, language and outgoing links of a page."""
    out = []
    if m := _TITLE.search(page):
        out.append(("title", " ".join(html.unescape(m[1]).split())))
    if m := _LANG.search(page):
        out.append(("language", m[1]))
    return out + [("outlink", html.unescape(" ".join(next(filter(None, m.groups()), "").split()))) for m in _LINK.finditer(page)]


def block_of(fields: list[tuple[str, str]]) -> bytes:
    return "".join(f"{k}: {v}{CRLF}" for k, v in fields).encode()


def serialize(headers: list[tuple[str, str]], block: bytes) -> bytes:
    """The bytes of a record."""
    return ("WARC/1.1" + CRLF + "".join(f"{k}: {v}{CRLF}" for k, v in headers) + CRLF).encode() + block + 2 * CRLF.encode()


def parse_record(piece: bytes) -> tuple[list[tuple[str, str]], bytes]:
    """Headers and block of one record, given from behind 'WARC/' up to the next record; raises if it is malformed."""
    head, found, rest = piece.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "replace").split(CRLF)
    headers = [(k.strip(), v.strip()) for k, _, v in (x.partition(":") for x in lines[1:])]
    length = next((v for k, v in headers if k.lower() == "content-length"), "")
    if not found or not length.isdigit():
        raise ValueError(f"a WARC record without an end of headers or a Content-Length: {head[:80]!r}")
    block, behind = rest[: int(length)], rest[int(length) :]
    if len(block) < int(length) or behind.strip(b"\r\n"):
        raise ValueError(f"a WARC record of {len(rest)} bytes, not {length}: {head[:80]!r}")
    return headers, block


#: Media types that have a plain-text conversion.
HTML_TYPES, TEXT_TYPES = ("text/html", "application/xhtml+xml"), ("text/plain",)
_META = re.compile(rb"<meta\b[^>]*?\bcharset\s*=\s*[\"']?([A-Za-z0-9_:.-]+)", re.I)


def _dechunked(data: bytes) -> tuple[bytes, bool]:
    """The body of a chunked transfer, and whether it is well formed; what follows a bad chunk size stays as it is."""
    out, at = [], 0
    while (end := data.find(b"\r\n", at)) >= 0:
        size = data[at:end].split(b";")[0].strip()
        if not re.fullmatch(rb"[0-9A-Fa-f]+", size):
            break
        n = int(size, 16)
        if not n:
            return b"".join(out), True
        out.append(data[end + 2 : end + 2 + n])
        at = end + 4 + n
        if end + 2 + n > len(data):
            return b"".join(out), False
    return b"".join([*out, data[at:]]), False


def _inflated(data: bytes, coding: str) -> bytes:
    """gzip (of one or many members) or deflate undone; raises ``zlib.error``."""
    out = []
    while data:
        bits = -15 if coding == "deflate" and data[:1] != b"\x78" else 47
        z = zlib.decompressobj(bits)
        out.append(z.decompress(data))
        data = z.unused_data if coding != "deflate" else b""
        if data[:2] != b"\x1f\x8b":
            break
    return b"".join(out)


def body(headers: list[tuple[str, str]], payload: bytes) -> tuple[str, str | None, list[str]]:
    """Media type, decoded text and what could not be undone of an HTTP response.

    Transfer and content encodings are undone from the last to the first, the charset is the declared one or UTF-8
    where there is no such text encoding. A response without a type counts as HTML. The text is None for media types
    without text and where an encoding is unknown (br, say), and '' where a known one is malformed.
    """
    named = {k.lower(): v for k, v in headers}
    kind, _, rest = named.get("content-type", "text/html").partition(";")
    kind = kind.strip().lower()
    if kind not in HTML_TYPES + TEXT_TYPES:
        return kind, None, []
    problems = []
    if "chunked" in named.get("transfer-encoding", "").lower():
        payload, good = _dechunked(payload)
        problems += [] if good else ["malformed chunked"]
    codings = [c for c in re.split(r"[,\s]+", named.get("content-encoding", "").lower()) if c and c != "identity"]
    for coding in reversed(codings):
        if coding not in ("gzip", "x-gzip", "deflate"):
            return kind, None, [*problems, f"unknown {coding}"]
        try:
            payload = _inflated(payload, coding)
        except zlib.error:
            return kind, "", [*problems, f"malformed {coding}"]
    declared = re.search(r"charset\s*=\s*[\"']?([\w:.-]+)", rest, re.I)
    meta = None if declared else _META.search(payload[:4096])
    charset = declared[1] if declared else meta[1].decode() if meta else "utf-8"
    try:
        return kind, payload.decode(charset, "replace"), problems
    except (LookupError, ValueError):  # no text encoding, or one that cannot decode at all
        return kind, payload.decode("utf-8", "replace"), [*problems, f"unknown {charset}"]


#: Columns of a record; ``key`` names the row that it comes from.
_FIELDS = [("record_type", pa.string()), ("record_id", pa.string()), ("refers_to", pa.string()), ("target_uri", pa.string()), ("block_digest", pa.string()), ("payload_digest", pa.string()), ("content_length", pa.int64()), ("headers", pa.list_(pa.struct([("name", pa.string()), ("value", pa.string())]))), ("block", pa.binary())]
RECORD = "record_type string, record_id string, refers_to string, target_uri string, block_digest string, payload_digest string, content_length bigint, headers array<struct<name:string,value:string>>, block binary"


def _record(kind: str, name: str, refers: str | None, uri: str, date: str, content_type: str, block: bytes, payload: bytes | None, more: list[tuple[str, str]]) -> dict:
    headers = [("WARC-Type", kind), ("WARC-Record-ID", name), ("WARC-Date", date), ("WARC-Target-URI", uri)]
    if refers:
        headers.append(("WARC-Refers-To", refers))
    own, of_payload = digest(block), None if payload is None else digest(payload)
    headers += more + [("WARC-Block-Digest", own)] + ([("WARC-Payload-Digest", of_payload)] if of_payload else []) + [("Content-Type", content_type), ("Content-Length", str(len(block)))]
    return {"record_type": kind, "record_id": name, "refers_to": refers, "target_uri": uri, "block_digest": own, "payload_digest": of_payload, "content_length": len(block), "headers": [{"name": k, "value": v} for k, v in headers], "block": block}


def _batch(keys: pa.Array, rows: list[int], records: list[dict]) -> pa.RecordBatch:
    columns = [pa.array([r[n] for r in records], t) for n, t in _FIELDS]
    return pa.record_batch([keys.take(pa.array(rows, pa.int32())), *columns], names=["key", *(n for n, _ in _FIELDS)])


def responses(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", date: str = DEFAULT_DATE) -> DataFrame:
    """Response records of fetched pages: column ``key`` (the page's id) and the record's columns.

    The block is an HTTP response with the page as UTF-8 payload. Null pages and urls count as empty. Pages that
    repeat have a record each, with equal ids; an empty table gives no records.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, 500):
                part = batch.slice(first, 500)
                found = []
                for key, url, page in zip(*(part.column(c).to_pylist() for c in range(3)), strict=True):
                    url, payload = " ".join((url or "").split()), (page or "").encode()
                    head = f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: {len(payload)}{CRLF}{CRLF}".encode()
                    found.append(_record("response", record_id("response", str(key), url, digest(payload)), None, url, date, "application/http; msgtype=response", head + payload, payload, []))
                yield _batch(part.column(0), list(range(part.num_rows)), found)

    rows = pages.select(F.col(id_col).alias("key"), F.col(url_col).cast("string").alias("url"), F.col(html_col).alias("html"))
    return rows.mapInArrow(run, f"key {rows.schema['key'].dataType.simpleString()}, {RECORD}")


def derivatives(records: DataFrame) -> DataFrame:
    """A metadata and a conversion record for each response in ``records``; other record types give none.

    Both refer to the response and carry its URI, date and payload digest (``WARC-Source-*``), and its HTTP
    headers (``HTTP-*``). The conversion's block is the visible text of an HTML page, or a plain text as it is;
    responses of other media types (images, say), and those with an unknown content encoding, have a metadata record
    only. Encodings and charsets that could not be undone are named in the metadata (``undecoded``). Responses that
    repeat are each converted; null blocks count as empty pages; very long blocks are handled whole, one at a time;
    an empty table gives no records.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, 200):
                part = batch.slice(first, 200)
                rows, found = [], []
                for r, (name, uri, of_payload, headers, block) in enumerate(zip(*(part.column(c).to_pylist() for c in range(1, 6)), strict=True)):
                    head, _, payload = (block or b"").partition(b"\r\n\r\n")
                    fields = [(k.strip(), v.strip()) for k, _, v in (x.partition(":") for x in head.decode("utf-8", "replace").split(CRLF)[1:])]
                    (media, page, problems), uri = body(fields, payload), uri or ""
                    date = next((h["value"] for h in headers or () if h["name"] == "WARC-Date"), DEFAULT_DATE)
                    source = [("WARC-Source-URI", uri), ("WARC-Source-Date", date), ("WARC-Source-Payload-Digest", of_payload or digest(payload))]
                    source += [(f"HTTP-{k}", v) for k, v in fields]
                    facts_of = (facts(page or "") if media in HTML_TYPES else []) + [("undecoded", x) for x in problems]
                    rows.append(r)
                    found.append(_record("metadata", record_id("metadata", name or ""), name, uri, date, "application/warc-fields", block_of(facts_of), None, source))
                    if page is None:
                        continue
                    text = (plain_text(page) if media in HTML_TYPES else page).encode()
                    rows.append(r)
                    found.append(_record("conversion", record_id("conversion", name or ""), name, uri, date, "text/plain; charset=utf-8", text, text, source))
                yield _batch(part.column(0), rows, found)

    rows = records.where("record_type = 'response'").select("key", "record_id", "target_uri", "payload_digest", "headers", "block")
    return rows.mapInArrow(run, f"key {rows.schema['key'].dataType.simpleString()}, {RECORD}")


def warc_bytes(records: DataFrame) -> Column:
    """A column with the serialized record of each row."""
    lines = F.array_join(F.transform(records["headers"], lambda h: F.concat_ws(": ", h["name"], h["value"])), CRLF)
    return F.concat(F.concat(F.lit("WARC/1.1" + CRLF), lines, F.lit(2 * CRLF)).cast("binary"), records["block"], F.lit(2 * CRLF).cast("binary"))


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """Records of WARC files (plain, or gzip as one or many members): ``key`` is the file, then the record's columns.

    Spark's text source cuts files at the line that begins a record, so plain files are split over tasks and
    memory is bounded by the longest record. Files without records give no rows, records that repeat are each
    read. A malformed record raises, and so does one whose block holds a blank line followed by 'WARC/'.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, 200):
                part, rows, found = batch.slice(first, 200), [], []
                for r, piece in enumerate(part.column(1).to_pylist()):
                    piece = piece.removeprefix(b"WARC/")  # the first record of a file
                    if not piece.strip(b"\r\n"):
                        continue
                    headers, block = parse_record(piece)
                    h = {k.lower(): v for k, v in headers}
                    rows.append(r)
                    found.append({n: h.get("warc-" + n.replace("_", "-")) for n in ("refers_to", "target_uri", "block_digest", "payload_digest")} | {"record_type": h.get("warc-type"), "record_id": h.get("warc-record-id"), "content_length": len(block), "headers": [{"name": k, "value": v} for k, v in headers], "block": block})
                yield _batch(part.column(0), rows, found)

    pieces = spark.read.option("lineSep", "\r\n\r\nWARC/").text(path).select(F.col("_metadata.file_path").alias("key"), F.col("value").cast("binary").alias("piece"))
    return pieces.mapInArrow(run, f"key string, {RECORD}")
