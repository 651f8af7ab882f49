"""Operator 7: WARC derivatives: metadata and plain-text conversion records of responses.

Every response record gives two records that refer to it (WARC-Refers-To holds its WARC-Record-ID): a metadata record
(application/warc-fields) with the source's identifiers, digests, status and HTTP headers, and a conversion record with
the visible text. Both keep WARC-Target-URI, WARC-Date and WARC-Warcinfo-ID, and have digests of their own blocks.
Record ids are name-based on the source id, so a repeated run gives the same ids and a lost task is harmless.

read() takes WARC files (plain or gzip, a member a record or not) through Spark's binaryFile source, so a file has 2 GB at
the most as it is stored; it is inflated piece by piece, and one record is held at a time. derive() takes record bytes.
Each record is handled where it is read. After a broken record (no length, a length beyond the data, a broken gzip member)
reading goes on at the next line that begins with WARC/.

Defined results: records that are no responses, null or broken records give nothing (their bytes stay in the source);
ids stay whole numbers of 64 bits beside nulls, and a null key names its record as the text `None`; an HTTP body that can't be decoded is taken as it is; an empty body gives an empty conversion; repeated records give
repeated derivatives; an empty table gives no rows; the key column is passed on, other columns are ignored.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracksmith.llm import common, html_text

VERSION = b"WARC/1.1"
NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # RFC 4122: names that are URLs
_CHARSET = re.compile(r"charset\s*=\s*[\"']?([\w.:-]+)", re.I)
_TITLE = re.compile(r"<title\b[^>]*>(.*?)</title\s*>", re.I | re.S)
_LANG = re.compile(r"<html\b[^>]*\blang\s*=\s*[\"']?([\w-]+)", re.I)

Headers = list[tuple[str, str]]


def digest(block: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(block).digest()).decode()


def get(headers: Headers, name: str) -> str | None:
    return next((v for k, v in headers if k.lower() == name.lower()), None)


def _header_lines(raw: bytes) -> Headers:
    out: Headers = []
    for line in raw.split(b"\r\n"):
        text = line.decode("utf-8", "replace")
        if text[:1] in (" ", "\t") and out:
            out[-1] = (out[-1][0], f"{out[-1][1]} {text.strip()}")
        elif ":" in text:
            name, _, value = text.partition(":")
            out.append((name.strip(), value.strip()))
    return out


def serialise(headers: Headers, block: bytes) -> bytes:
    lines = [f"{k}: {v}".encode() for k, v in [*headers, ("Content-Length", str(len(block)))]]
    return b"\r\n".join([VERSION, *lines, b"", block, b"", b""])


PIECE = 1 << 20
MAGIC = b"\x1f\x8b"


def _inflated(raw: bytes) -> Iterator[bytes]:
    """Content of gzip members, in pieces; after a broken one the next that opens goes on."""
    at = 0
    while at >= 0:
        member, start = zlib.decompressobj(31), at
        try:
            while not member.eof and at < len(raw):
                given = raw[at : at + PIECE]
                piece = member.decompress(given, PIECE)
                while piece or member.unconsumed_tail:
                    yield piece
                    piece = member.decompress(member.unconsumed_tail, PIECE)
                at += len(given)
            at -= len(member.unused_data)
            if member.eof and raw[at : at + 2] == MAGIC:
                continue
        except zlib.error:
            at = start + 1
            yield b"\r\n"
        at = raw.find(MAGIC, at)


class _Reader:
    """Bytes from pieces; those before `at` are done with."""

    def __init__(self, pieces: Iterator[bytes]) -> None:
        self.pieces, self.held, self.at = pieces, b"", 0

    def upto(self, size: int) -> bool:
        """Whether there are `size` bytes from here on."""
        if len(self.held) - self.at < size:
            new, have = [self.held[self.at :]], len(self.held) - self.at
            for piece in self.pieces:
                new.append(piece)
                have += len(piece)
                if have >= size:
                    break
            self.held, self.at = b"".join(new), 0
        return len(self.held) - self.at >= size

    def find(self, what: bytes) -> int:
        """How far from here `what` begins, or -1."""
        look = 0
        while True:
            found = self.held.find(what, self.at + look)
            if found >= 0:
                return found - self.at
            have = len(self.held) - self.at
            look = max(0, have - len(what) + 1)
            if not self.upto(have + max(PIECE, have)) and self.held.find(what, self.at + look) < 0:
                return -1


def parse(raw: bytes) -> Iterator[tuple[Headers, bytes]]:
    """Headers and block of each whole record, in order; broken ones are passed over."""
    data = _Reader(_inflated(raw) if raw[:2] == MAGIC else iter([raw]))
    while True:
        while data.upto(2) and data.held[data.at : data.at + 2] == b"\r\n":
            data.at += 2
        if not data.upto(5):
            return
        if data.held[data.at : data.at + 5] == b"WARC/":
            end = data.find(b"\r\n\r\n")
            if end >= 0:
                first = data.held.find(b"\r\n", data.at)
                headers = _header_lines(data.held[first + 2 : data.at + end])
                length = get(headers, "Content-Length") or ""
                if re.fullmatch("[0-9]{1,18}", length) and data.upto(end + 4 + int(length)):
                    block = data.held[data.at + end + 4 : data.at + end + 4 + int(length)]
                    data.at += end + 4 + int(length)
                    yield headers, block
                    continue
        ahead = data.find(b"\nWARC/")
        if ahead < 0:
            return
        data.at += ahead + 1


def http(block: bytes) -> tuple[str, Headers, bytes]:
    """Status line, headers and decoded body of an HTTP response."""
    head, _, body = block.partition(b"\r\n\r\n")
    status, _, rest = head.partition(b"\r\n")
    headers = _header_lines(rest)
    if (get(headers, "Transfer-Encoding") or "").lower() == "chunked":
        body = _dechunk(body)
    coding = (get(headers, "Content-Encoding") or "").lower()
    try:
        if coding in ("gzip", "x-gzip"):
            body = gzip.decompress(body)
        elif coding == "deflate":
            body = zlib.decompress(body, zlib.MAX_WBITS if body[:1] and body[0] & 15 == 8 and int.from_bytes(body[:2]) % 31 == 0 else -zlib.MAX_WBITS)
    except (OSError, EOFError, zlib.error):
        pass
    return status.decode("utf-8", "replace"), headers, body


def _dechunk(body: bytes) -> bytes:
    out, at = [], 0
    while True:
        end = body.find(b"\r\n", at)
        size = body[at:end].split(b";")[0].strip() if end >= 0 else b""
        if not re.fullmatch(rb"[0-9A-Fa-f]{1,8}", size):
            return b"".join(out) if out else body
        n = int(size, 16)
        if not n:
            return b"".join(out)
        out.append(body[end + 2 : end + 2 + n])
        at = end + 2 + n + 2


def _decode(headers: Headers, body: bytes) -> str:
    named = _CHARSET.search(get(headers, "Content-Type") or "")
    try:
        return body.decode(named[1] if named else "utf-8", "replace")
    except (LookupError, UnicodeError, ValueError):  # unknown, no text codec, or a codec that takes no "replace"
        return body.decode("utf-8", "replace")


def derivatives(headers: Headers, block: bytes) -> list[tuple[str, Headers, bytes]]:
    """(kind, headers, block) of the metadata and the conversion record of a response; nothing of other records."""
    source = get(headers, "WARC-Record-ID")
    if (get(headers, "WARC-Type") or "").lower() != "response" or not source:
        return []
    status, fields, body = http(block)
    kind = (get(fields, "Content-Type") or "").lower()
    page = _decode(fields, body)
    is_html = "html" in kind or not kind and "<html" in page[:1000].lower()
    text = "\n".join(t for _, t in html_text.lines(page)) if is_html else page if kind.startswith("text/") else ""
    title, lang = _TITLE.search(page) if is_html else None, _LANG.search(page) if is_html else None
    about = [("source-record-id", source)]
    about += [(f"source-{k.lower()}", v) for k in ("WARC-Payload-Digest", "WARC-Block-Digest", "WARC-IP-Address", "WARC-Identified-Payload-Type") if (v := get(headers, k))]
    about += [("computed-block-digest", digest(block)), ("http-status", status)]
    about += [(f"http-{k.lower()}", v) for k, v in fields]
    if title:
        about.append(("title", " ".join(html_text.html.unescape(title[1]).split())))
    if lang:
        about.append(("language", lang[1]))
    about.append(("text-length", str(len(text))))
    out = []
    for name, content, made in (("metadata", "application/warc-fields", b"".join(f"{k}: {v}\r\n".encode() for k, v in about)), ("conversion", "text/plain; charset=utf-8", text.encode("utf-8", "replace"))):
        own: Headers = [("WARC-Type", name), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(NAMESPACE, f'{source}#{name}')}>"), ("WARC-Refers-To", source)]
        own += [(k, v) for k in ("WARC-Target-URI", "WARC-Date", "WARC-Warcinfo-ID") if (v := get(headers, k))]
        own += [("WARC-Block-Digest", digest(made)), ("Content-Type", content)]
        out.append((name, own, made))
    return out


SCHEMA = "key long, kind string, record_id string, refers_to string, target_uri string, date string, source_digest string, block_digest string, n_bytes long, block string, record binary"


_KINDS = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
_ARROW = pa.schema([(c.split()[0], _KINDS[c.split()[1]]) for c in SCHEMA.split(", ")])


def derive(records: DataFrame, key: str = "key", record: str = "record") -> DataFrame:
    """(the columns of SCHEMA) of the derivatives of all responses in the record column; `record` is the serialised one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in common.rows(batches, "key", "record"):
            out = []
            for k, raw in part:
                for headers, block in parse(raw or b""):
                    source = get(headers, "WARC-Payload-Digest") or get(headers, "WARC-Block-Digest")
                    for kind, own, made in derivatives(headers, block):
                        out.append((k, kind, get(own, "WARC-Record-ID"), get(own, "WARC-Refers-To"), get(own, "WARC-Target-URI"), get(own, "WARC-Date"), source, get(own, "WARC-Block-Digest"), len(made), made.decode("utf-8"), serialise(own, made)))
            yield common.record_batch(_ARROW, out)

    return records.select(F.col(key).cast("long").alias("key"), F.col(record).alias("record")).mapInArrow(run, SCHEMA)


_READ = "key long, file string, headers array<struct<name:string,value:string>>, record binary"
_READ_ARROW = pa.schema([("key", pa.int64()), ("file", pa.string()), ("headers", pa.list_(pa.struct([("name", pa.string()), ("value", pa.string())]))), ("record", pa.binary())])


def read(spark: SparkSession, path: str) -> DataFrame:
    """(key, file, headers, record) of every whole record of the WARC files under path; key numbers a file's records."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in common.rows(batches, "path", "content", step=1):
            for file, content in part:
                for k, (headers, block) in enumerate(parse(content)):
                    kept = [(n, v) for n, v in headers if n.lower() != "content-length"]
                    yield common.record_batch(_READ_ARROW, [(k, file, [{"name": n, "value": v} for n, v in headers], serialise(kept, block))])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, _READ)


_RESPONSES = pa.schema([("key", pa.int64()), ("record", pa.binary())])


def responses(pages: DataFrame) -> DataFrame:
    """(key, record): a response record for each row of pages, as a crawl would have stored it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in common.rows(batches, "page_id", "url", "html"):
            out = []
            for page_id, url, page in part:
                body = (page or "").encode("utf-8", "replace")
                block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(body) + body
                name = uuid.uuid5(NAMESPACE, f"{url or ''}#{page_id}")
                headers: Headers = [("WARC-Type", "response"), ("WARC-Record-ID", f"<urn:uuid:{name}>")]
                headers += [("WARC-Target-URI", url)] if url else []
                headers += [("WARC-Date", "2024-01-01T00:00:00Z"), ("WARC-Payload-Digest", digest(body)), ("WARC-Block-Digest", digest(block)), ("Content-Type", "application/http; msgtype=response")]
                out.append((page_id, serialise(headers, block)))
            yield common.record_batch(_RESPONSES, out)

    return pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html").mapInArrow(run, "key long, record binary")


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = derive(responses(common.table(spark, sf_dir, "pages", "page_id", "url", "html")))
    return made.withColumnRenamed("key", "page_id").drop("record")
