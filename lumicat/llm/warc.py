"""WARC derivatives: linked metadata and plain-text conversion records of response records.

A record is a row: type, id, the id it refers to, target, date, content type, block, block digest, payload digest and source
headers. Each response gives one ``metadata`` and one ``conversion`` record; both refer to it, keep its target, date and
payload digest and the headers of its source, and have ids that follow from the response's, so a task that runs again
writes the same records. Every step works row by row in tasks, without a shuffle.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import html as _html
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RECORD = (
    "warc_type string, record_id string, refers_to string, target_uri string, date string, content_type string, block binary, "
    "block_digest string, payload_digest string, headers map<string,string>")
_NAMES = [c.split()[0] for c in RECORD.split(", ")]
_KINDS = pa.schema([(n, pa.binary() if n == "block" else pa.map_(pa.string(), pa.string()) if n == "headers" else pa.string()) for n in _NAMES])
#: Header fields of a record that rows hold in columns of their own.
_OWN = {"warc-type": "warc_type", "warc-record-id": "record_id", "warc-refers-to": "refers_to", "warc-target-uri": "target_uri", "warc-date": "date",
        "content-type": "content_type", "warc-block-digest": "block_digest", "warc-payload-digest": "payload_digest"}
_SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # fixed value: the name space of urls

_SKIP = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style|head|noscript|template)\b[^>]*>.*?(?:</\1\s*>|\Z)", re.I | re.S)
_BREAK = re.compile(
    r"</?(?:address|article|aside|blockquote|body|br|dd|div|dl|dt|fieldset|figure|footer|form|h[1-6]|header|hr|li|main|nav|ol|p|pre|section|table|td|th|tr|ul)\b[^>]*>", re.I)
_TAG = re.compile(r"</?[a-z!?][^>]*>", re.I)
_TITLE = re.compile(r"<title\b[^>]*>(.*?)</title", re.I | re.S)
_LINK = re.compile(r"<a\b[^>]*?\bhref\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_CHUNK = re.compile(rb"([0-9a-f]{1,15})\s*(?:;.*)?", re.I | re.S)
_CHARSET = re.compile(r"charset\s*=\s*[\"']?([\w-]+)", re.I)


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def derived_id(source: str, kind: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(_SPACE, f'{source} {kind}')}>"


def plain_text(html: str) -> str:
    """All text of a page, a line per block, without scripts, styles and the head."""
    lines = (" ".join(_html.unescape(x).split()) for x in _TAG.sub("", _BREAK.sub("\n", re.sub(r"\s+", " ", _SKIP.sub(" ", html)))).split("\n"))
    return "\n".join(x for x in lines if x)


def _split_http(block: bytes) -> tuple[str, list[tuple[str, str]], bytes]:
    """Status line, header fields (names folded, in order) and body of an HTTP response."""
    head, found, body = block.partition(b"\r\n\r\n")
    if not found:
        head, _, body = block.partition(b"\n\n")
    if not head.startswith(b"HTTP/"):
        return "", [], block
    lines = head.decode("latin-1").splitlines()
    return lines[0], [(k.strip().lower(), v.strip()) for k, _, v in (x.partition(":") for x in lines[1:])], body


def _joined(fields: list[tuple[str, str]]) -> dict[str, str]:
    """The values of repeated fields in one, in order."""
    out: dict[str, str] = {}
    for k, v in fields:
        out[k] = f"{out[k]}, {v}" if k in out else v
    return out


def _unchunk(data: bytes) -> bytes:
    """A chunked body as one, as far as it goes; a body that does not begin with a chunk is taken as it is."""
    out, at = [], 0
    while at < len(data):
        end = data.find(b"\n", at)
        size = _CHUNK.fullmatch(data[at:end].strip()) if end >= 0 else None
        if not size:
            return b"".join(out) if at else data
        n = int(size[1], 16)
        if not n:
            break
        out.append(data[end + 1: end + 1 + n])
        at = end + 1 + n
        at += 2 if data[at: at + 2] == b"\r\n" else 1
    return b"".join(out)


def _decoded(body: bytes, codings: str) -> bytes | None:
    """What is whole of a body after undoing its codings, the last first; null for a coding that is not known. A body without the beginning
    of a gzip member is no gzip."""
    for coding in reversed([x.strip().lower() for x in codings.split(",")]):
        if coding == "chunked":
            body = _unchunk(body)
        elif coding in ("gzip", "x-gzip"):
            body = _gunzip(body) if body[:2] == b"\x1f\x8b" else body
        elif coding == "deflate":
            wrapped = len(body) > 1 and body[0] & 15 == 8 and not int.from_bytes(body[:2], "big") % 31
            body = _inflated(zlib.decompressobj(15 if wrapped else -15), body)[0]
        elif coding not in ("", "identity"):
            return None
    return body


def derive(row: dict) -> list[dict]:
    """The metadata and conversion records of one response."""
    status, given, body = _split_http(row["block"] or b"")
    fields, kind = _joined(given), dict(given).get("content-type", "")
    body = _decoded(body, fields.get("transfer-encoding", ""))
    body = b"" if body is None else _decoded(body, fields.get("content-encoding", "")) or b""
    is_html = not kind or "html" in kind.lower()
    named = _CHARSET.search(kind) or _CHARSET.search(body[:1024].decode("latin-1"))
    try:
        text = body.decode(named[1] if named else "utf-8", "replace")
    except LookupError:
        text = body.decode("utf-8", "replace")
    title, links = "", []
    if is_html:
        found = _TITLE.search(text)
        title = " ".join(_html.unescape(found[1]).split()) if found else ""
        links = [_html.unescape(next(filter(None, m), "")) for m in _LINK.findall(text)]
        text = plain_text(text)
    elif not kind.lower().startswith("text/"):
        text = ""
    status_code = status.split(" ")[1] if status.count(" ") else ""
    about = [("fetchStatus", status_code), ("sourceContentType", kind), ("sourceLength", str(len(body))), ("title", title), ("charset", named[1].lower() if named else "utf-8")]
    about += [("outlink", x) for x in links]
    lines = "".join(f"{k}: {' '.join(v.split())}\r\n" for k, v in about if v)
    kept = {f"WARC-Source-{k.title()}": v for k, v in fields.items()} | _joined(row["headers"] or [])
    out = []
    for what, content, block in (("metadata", "application/warc-fields", lines.encode()), ("conversion", "text/plain; charset=utf-8", text.encode())):
        out.append({
            "warc_type": what, "record_id": derived_id(row["record_id"] or "", what), "refers_to": row["record_id"], "target_uri": row["target_uri"], "date": row["date"],
            "content_type": content, "block": block, "block_digest": digest(block), "payload_digest": row["payload_digest"] or digest(body), "headers": list(kept.items())})
    return out


def _emit(rows: list[dict]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, schema=_KINDS)


def derivatives(records: DataFrame) -> DataFrame:
    """The derived records of all responses among ``records``; other types give none.

    A null block counts as empty, a null id gives derived ids of the empty id. A block without an HTTP head is all payload.
    Repeated responses give repeated records. Payloads other than text have an empty conversion, and
    so have codings other than chunked, gzip and deflate. Values of repeated header fields are joined with commas, in order.
    """

    def run(batches):
        for batch in batches:
            columns, rows = [batch.column(n) for n in _NAMES], []
            for k in range(batch.num_rows):
                rows += derive({n: c[k].as_py() for n, c in zip(_NAMES, columns)})
                if len(rows) >= 256:
                    yield _emit(rows)
                    rows = []
            yield _emit(rows)

    return records.where("lower(warc_type) = 'response'").select(*_NAMES).mapInArrow(run, RECORD)


def responses(pages: DataFrame, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """Response records of ``pages (page_id, url, html)``; null pages have an empty payload."""

    def run(batches):
        for batch in batches:
            rows = []
            for page, url, html in zip(*(batch.column(k) for k in range(3))):
                body = (html.as_py() or "").encode()
                block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(body) + body
                rows.append({
                    "warc_type": "response", "record_id": derived_id(f"{page.as_py()} {url.as_py()}", "response"), "refers_to": None, "target_uri": url.as_py(), "date": date,
                    "content_type": "application/http; msgtype=response", "block": block, "block_digest": digest(block), "payload_digest": digest(body),
                    "headers": [("WARC-Page-Id", str(page.as_py()))]})
            yield _emit(rows)

    return pages.select(F.col("page_id"), F.col("url"), F.col("html")).mapInArrow(run, RECORD)


def to_bytes(row: dict) -> bytes:
    """A record as a gzip member of a WARC file."""
    fields = [("WARC-Type", row["warc_type"]), ("WARC-Record-ID", row["record_id"]), ("WARC-Refers-To", row["refers_to"]), ("WARC-Target-URI", row["target_uri"]),
              ("WARC-Date", row["date"]), ("WARC-Block-Digest", row["block_digest"]), ("WARC-Payload-Digest", row["payload_digest"]), *(row["headers"] or []),
              ("Content-Type", row["content_type"]), ("Content-Length", str(len(row["block"] or b"")))]
    head = "WARC/1.0\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields if v is not None) + "\r\n"
    return gzip.compress(head.encode() + (row["block"] or b"") + b"\r\n\r\n", 6, mtime=0)


def serialized(records: DataFrame) -> DataFrame:
    """record_id, member: each record as a gzip member; members put together are a WARC file."""

    def run(batches):
        for batch in batches:
            rows = batch.to_pylist()
            yield pa.RecordBatch.from_arrays([pa.array([r["record_id"] for r in rows], pa.string()), pa.array([to_bytes(r) for r in rows], pa.binary())], ["record_id", "member"])

    return records.select(*_NAMES).mapInArrow(run, "record_id string, member binary")


def _inflated(member, data: bytes, at: int = 0) -> tuple[bytes, int, bool]:
    """What ``member`` gives from ``at`` on, up to its end or where it is broken; where it ended; whether it is not broken."""
    out, step = [], 1 << 16
    while at < len(data) and not member.eof:
        piece, before = data[at: at + step], member.copy()
        try:
            out.append(member.decompress(piece))
        except zlib.error:
            if step == 1:
                return b"".join(out), at, False
            member, step = before, max(1, step // 16)  # again in smaller pieces, up to the broken byte
            continue
        at += len(piece) - len(member.unused_data)
    return b"".join(out), at, True


def _gunzip(data: bytes) -> bytes:
    """All gzip members, as far as they are whole."""
    out, at, whole = [], 0, True
    while at < len(data) and whole:
        got, at, whole = _inflated(zlib.decompressobj(31), data, at)
        out.append(got)
    return b"".join(out)


def parse(data: bytes) -> Iterator[dict]:
    """The records of a WARC file, plain or gzip members. A broken end gives what was whole before it."""
    if data[:2] == b"\x1f\x8b":
        data = _gunzip(data)
    at = 0
    while True:
        at = data.find(b"WARC/", at)
        end = data.find(b"\r\n\r\n", at)
        if at < 0 or end < 0:
            return
        fields = [(k.strip(), v.strip()) for k, _, v in (x.partition(":") for x in data[at:end].decode("utf-8", "replace").split("\r\n")[1:])]
        length = next((int(v) for k, v in fields if k.lower() == "content-length" and v.isdigit()), 0)
        block = data[end + 4: end + 4 + length]
        if len(block) < length:
            return
        own = {_OWN[k.lower()]: v for k, v in fields if k.lower() in _OWN}
        yield {n: own.get(n) for n in _NAMES} | {"block": block, "headers": [(k, v) for k, v in fields if k.lower() not in _OWN and k.lower() != "content-length"]}
        at = end + 4 + length


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """Records of all WARC files below ``path``, one file to a task at a time."""

    def run(batches):
        for batch in batches:
            for content in batch.column(0):
                rows = []
                for record in parse(content.as_py()):
                    rows.append(record)
                    if len(rows) >= 256:
                        yield _emit(rows)
                        rows = []
                yield _emit(rows)

    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("content").mapInArrow(run, RECORD)
