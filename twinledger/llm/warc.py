"""Operator 1, WARC derivatives: response records to linked metadata and plain-text conversion records.

Each response gives two records that name it in WARC-Refers-To, with its target URI and date: a
`conversion` with the plain text of a body of HTML or text, its transfer and content encodings undone, and a `metadata` record (application/warc-fields)
with the source record's header, HTTP status and headers, digests and the links that the body names.
Block digests are SHA-256 of the block; the response's payload digest is carried along.  Record ids
are name-based UUIDs, so that a rebuilt record has the same id.
"""

from __future__ import annotations

import hashlib
import html as html_text
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RECORD = "record_id string, record_type string, refers_to string, target_uri string, warc_date string, content_type string, block_digest string, payload_digest string, source_payload_digest string, source_headers string, content_length long, block string"
_NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")
_DROP = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style|template|noscript)\b[^>]*>.*?(?:</\1\s*>|\Z)", re.S | re.I)
_BREAK = re.compile(r"</?(?:p|div|h[1-6]|ul|ol|li|tr|table|section|article|header|footer|nav|aside|main|br|hr|blockquote|pre|form|title|body|head)\b[^>]*(?:>|\Z)", re.I)
_TAG = re.compile(r"<[/!?a-zA-Z][^>]*(?:>|\Z)")
_LINK = re.compile(r"<(a|img|link|script|iframe)\b[^>]*?\s(?:href|src)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)


def digest(data: bytes) -> str:
    return "sha256:" + hashlib.sha256(data).hexdigest()


def record_id(kind: str, *parts: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(_NAMESPACE, chr(31).join((kind, *parts)))}>"


def plain_text(html: str) -> str:
    """Readable text of HTML: a line for each block, white space as one space."""
    lines = _TAG.sub("", _BREAK.sub("\n", _DROP.sub(" ", html))).split("\n")
    kept = (" ".join(html_text.unescape(x).split()) for x in lines)
    return "\n".join(x for x in kept if x)


def links(html: str) -> list[tuple[str, str]]:
    return [(m[1].lower(), html_text.unescape(m[2] or m[3] or m[4] or "")) for m in _LINK.finditer(html)]


def serialize(headers: list[tuple[str, str]], block: bytes) -> bytes:
    """One WARC/1.1 record."""
    head = "".join(f"{k}: {v}\r\n" for k, v in [*headers, ("Content-Length", str(len(block)))])
    return b"WARC/1.1\r\n" + head.encode() + b"\r\n" + block + b"\r\n\r\n"


def parse(data: bytes) -> list[tuple[dict[str, str], bytes]]:
    """Records of a WARC file: headers and block. A record cut short raises ValueError."""
    out, at = [], 0
    while at < len(data):
        end = data.find(b"\r\n\r\n", at)
        lines = data[at:end].decode().split("\r\n") if end >= 0 else [""]
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no record at byte {at}")
        headers = dict(x.split(": ", 1) for x in lines[1:])
        size = int(headers["Content-Length"])
        block = data[end + 4 : end + 4 + size]
        if len(block) < size:
            raise ValueError("record cut short")
        out.append((headers, block))
        at = end + 4 + size + 4
    return out


def split_http(block: bytes) -> tuple[str, list[tuple[str, str]], bytes]:
    """Status line, headers and body of an HTTP response."""
    head, _, body = block.partition(b"\r\n\r\n")
    lines = head.decode("iso-8859-1").split("\r\n")
    return lines[0], [(k.strip(), v.strip()) for k, _, v in (x.partition(":") for x in lines[1:])], body


def _unchunked(body: bytes) -> bytes:
    """The body of a chunked transfer; one cut short gives what came. ValueError if it isn't chunked at all."""
    out, at = [], 0
    while at < len(body):
        end = body.find(b"\r\n", at)
        size = int(body[at : end if end >= 0 else len(body)].partition(b";")[0].strip() or b"x", 16)
        if size == 0 or end < 0:
            break
        out.append(body[end + 2 : end + 2 + size])
        at = end + 2 + size + 2
    return b"".join(out)


def entity(http: list[tuple[str, str]], body: bytes) -> tuple[bytes | None, str]:
    """The body without its transfer and content encodings, and what went wrong ('' if nothing did).

    A compressed stream that is cut or broken gives what can be read of it; an encoding that isn't known, or a
    chunked body that isn't one, gives None.
    """
    listed = lambda name: [x.strip().lower() for k, v in http if k.lower() == name for x in v.split(",") if x.strip()]
    trouble = ""
    for name in [*reversed(listed("transfer-encoding")), *reversed(listed("content-encoding"))]:
        if name == "identity":
            continue
        if name == "chunked":
            try:
                body = _unchunked(body)
            except ValueError:
                return None, "bad chunks"
        elif name in ("gzip", "x-gzip", "deflate"):
            raw = name == "deflate" and body[:1] != b"x"
            stream, parts = zlib.decompressobj(-15 if raw else 47), []
            try:
                for i in range(0, len(body), 65_536):
                    parts.append(stream.decompress(body[i : i + 65_536]))
                trouble = trouble or ("" if stream.eof else f"{name} cut short")
            except zlib.error:
                trouble = f"bad {name}"
            body = b"".join(parts)
        else:
            return None, f"unknown encoding {name}"
    return body, trouble


def _kind(content_type: str, body: bytes) -> str:
    """html, plain or other, by the media type; without one, by whether the body starts with a tag."""
    media = content_type.partition(";")[0].strip().lower()
    if media in ("text/html", "application/xhtml+xml"):
        return "html"
    if not media:
        return "html" if body.lstrip()[:1] == b"<" else "plain" if b"\0" not in body else "other"
    return "plain" if media.startswith("text/") else "other"


def _field(value: str) -> str:
    return " ".join(value.split())


def derive(headers: dict[str, str], block: bytes) -> list[dict]:
    """The conversion and the metadata record of one response; a body that is no text has only the latter.

    HTML is converted to its plain text, other text is taken as it is.
    """
    status, http, body = split_http(block)
    kind = next((v for k, v in http if k.lower() == "content-type"), "")
    charset = re.search(r"charset=[\"']?([\w-]+)", kind, re.I)
    plain, trouble = entity(http, body)
    form = "other" if plain is None else _kind(kind, plain)
    try:
        text = (plain or b"").decode(charset[1] if charset else "utf-8", "replace")
    except LookupError:
        text = (plain or b"").decode("utf-8", "replace")
    source, uri, date = (headers.get(k, "") for k in ("WARC-Record-ID", "WARC-Target-URI", "WARC-Date"))
    payload = headers.get("WARC-Payload-Digest") or digest(body)
    kept = "\r\n".join(f"{k}: {_field(v)}" for k, v in headers.items())
    conversion = (plain_text(text) if form == "html" else text).encode()
    conversion_id = record_id("conversion", source)
    fields = [("sourceRecord", source), *([("conversionRecord", conversion_id)] if form != "other" else []), ("httpStatus", status), *((f"httpHeader-{k}", v) for k, v in http), ("sourcePayloadDigest", payload), ("sourceBlockDigest", headers.get("WARC-Block-Digest") or digest(block))]
    fields += [("decoding", trouble)] * bool(trouble) + [("outlink", f"{x} {t}") for t, x in (links(text) if form == "html" else [])]
    metadata = "".join(f"{k}: {_field(v)}\r\n" for k, v in fields).encode()
    common = {"refers_to": source, "target_uri": uri, "warc_date": date, "source_payload_digest": payload, "source_headers": kept}
    rows = [(conversion_id, "conversion", "text/plain; charset=utf-8", conversion)] * (form != "other") + [(record_id("metadata", source), "metadata", "application/warc-fields", metadata)]
    return [
        common | {"record_id": i, "record_type": t, "content_type": c, "block_digest": digest(b), "payload_digest": digest(b), "content_length": len(b), "block": b.decode()}
        for i, t, c, b in rows
    ]


def record_bytes(row: dict) -> bytes:
    """A derived row as a WARC record."""
    names = (("WARC-Type", "record_type"), ("WARC-Record-ID", "record_id"), ("WARC-Refers-To", "refers_to"), ("WARC-Target-URI", "target_uri"), ("WARC-Date", "warc_date"), ("WARC-Block-Digest", "block_digest"), ("WARC-Payload-Digest", "payload_digest"), ("Content-Type", "content_type"))
    return serialize([(h, row[c]) for h, c in names if row[c]], row["block"].encode())


def response(uri: str, html: str, key: str, date: str = "2024-01-01T00:00:00Z") -> tuple[dict[str, str], bytes]:
    """A response record around a page's HTML."""
    body = html.encode()
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(body)}\r\n\r\n".encode() + body
    return {"WARC-Type": "response", "WARC-Record-ID": record_id("response", key, uri), "WARC-Target-URI": uri, "WARC-Date": date, "WARC-Payload-Digest": digest(body), "WARC-Block-Digest": digest(block), "Content-Type": "application/http; msgtype=response"}, block


def _batch(keys: list, rows: list[dict], name: str, kind: pa.DataType) -> pa.RecordBatch:
    columns = [x.split() for x in RECORD.split(", ")]
    arrays = [pa.array([r[c] for r in rows], pa.int64() if t == "long" else pa.string()) for c, t in columns]
    return pa.RecordBatch.from_arrays([pa.array(keys, kind), *arrays], [name, *(c for c, _ in columns)])


def derivatives(records: DataFrame) -> DataFrame:
    """(record_key, then the columns of RECORD), two rows, or one without a text, for each response of records (record_key, headers, block).

    headers is a map of the record's WARC headers, block its bytes.  A record of another type gives
    none; without headers it counts as a response without id, URI and date.  A null block is an empty
    one.  Repeated rows give repeated records, with equal ids.  Other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, len(batch), 256):
                part, keys, rows = batch.slice(lo, 256), [], []
                for key, headers, block in zip(*(part.column(c).to_pylist() for c in ("record_key", "headers", "block"))):
                    own = {k: v or "" for k, v in headers or []}
                    if own.get("WARC-Type", "response") == "response":
                        made = derive(own, block or b"")
                        rows += made
                        keys += [key] * len(made)
                yield _batch(keys, rows, "record_key", pa.string())

    return records.select(F.col("record_key").cast("string"), "headers", "block").mapInArrow(run, "record_key string, " + RECORD)


def from_pages(pages: DataFrame) -> DataFrame:
    """(page_id, then the columns of RECORD): pages (page_id, url, html) as responses, and their derivatives.

    A null url or html is the empty one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, len(batch), 256):
                part, keys, rows = batch.slice(lo, 256), [], []
                for key, url, html in zip(*(part.column(c).to_pylist() for c in ("page_id", "url", "html"))):
                    made = derive(*response(url or "", html or "", str(key)))
                    rows += made
                    keys += [key] * len(made)
                yield _batch(keys, rows, "page_id", pa.int64())

    return pages.select("page_id", "url", "html").mapInArrow(run, "page_id long, " + RECORD)
