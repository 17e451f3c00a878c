"""WARC records from pages, and their derivatives: linked metadata and plain-text conversion records."""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from html import unescape
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DATE = "2024-01-01T00:00:00Z"
#: Compressed bytes of a file in an archive table, about.
FILE = 8 << 20
LEVEL = 1

SKIPPED = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style|template|noscript)(?=[\s>/]).*?(?:</\1\s*>|\Z)", re.S | re.I)
BREAK = re.compile(r"</?(?:address|article|aside|blockquote|br|center|dd|div|dl|dt|fieldset|figcaption|figure|footer|form|h[1-6]|head|header|hr|html|body|li|main|nav|ol|p|pre|section|table|td|th|title|tr|ul)(?=[\s>/])(?:[^>\"']|\"[^\"]*\"|'[^']*')*>", re.I)
TAG = re.compile(r"<[/!?a-zA-Z](?:[^>\"']|\"[^\"]*\"|'[^']*')*>")
TITLE = re.compile(r"<title(?=[\s>/])[^>]*>(.*?)</title", re.S | re.I)
LANGUAGE = re.compile(r"<html(?=\s)[^>]*?\slang\s*=\s*[\"']?([\w-]+)", re.I)
LINK = re.compile(r"<(a|area|img|link|script|iframe)(?=\s)[^>]*?\s(href|src)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)


class Record(NamedTuple):
    """A record's named fields in order, and its block."""

    fields: list[tuple[str, str]]
    block: bytes

    def get(self, name: str) -> str | None:
        return next((v for k, v in self.fields if k.lower() == name.lower()), None)

    def dump(self) -> bytes:
        head = "".join(f"{k}: {v}\r\n" for k, v in self.fields)
        return f"WARC/1.1\r\n{head}\r\n".encode() + self.block + b"\r\n\r\n"


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def matches(claimed: str, data: bytes) -> bool:
    """Whether data has the digest "algorithm:value", in base32 or hexadecimal and any case; unknown algorithms can't be told and pass."""
    name, _, value = claimed.partition(":")
    name = name.strip().lower().replace("-", "")
    if name not in ("md5", "sha1", "sha256", "sha384", "sha512"):
        return True
    own = hashlib.new(name, data).digest()
    return value.strip().lower().rstrip("=") in (own.hex(), base64.b32encode(own).decode().lower().rstrip("="))


def record_id(*parts: str) -> str:
    """The same id for the same parts, so that a task that runs again writes the same records."""
    return f"<urn:uuid:{uuid.UUID(bytes=hashlib.sha256('\x1f'.join(parts).encode('utf-8', 'surrogatepass')).digest()[:16], version=5)}>"


def field_value(text: str) -> str:
    """text on one line, as a field's value has to be."""
    return " ".join(text.split())


def parse(data: bytes) -> Iterator[Record]:
    """Records of an uncompressed file."""
    return (record for record, _ in located(data))


def located(data: bytes) -> Iterator[tuple[Record, int]]:
    """Records of an uncompressed file, each with the place after it; a folded line continues the value before it."""
    at = 0
    while at < len(data):
        if data.startswith(b"\r\n", at):
            at += 2
            continue
        end = data.index(b"\r\n\r\n", at)
        first, *lines = data[at:end].decode("utf-8", "replace").split("\r\n")
        if not first.startswith("WARC/1."):
            raise ValueError(f"no record at byte {at}")
        fields: list[tuple[str, str]] = []
        for line in lines:
            if line[:1] in (" ", "\t") and fields:
                fields[-1] = (fields[-1][0], f"{fields[-1][1]} {line.strip()}")
            else:
                name, _, value = line.partition(":")
                fields.append((name.strip(), value.strip()))
        size = int(Record(fields, b"").get("Content-Length") or 0)
        block = data[end + 4 : end + 4 + size]
        if len(block) != size:
            raise ValueError("a record's block is cut off")
        at = min(end + 4 + size + 4, len(data))
        yield Record(fields, block), at


def split_http(block: bytes) -> tuple[str, list[tuple[str, str]], bytes]:
    """Status line, headers and payload of a response's block."""
    head, _, payload = block.partition(b"\r\n\r\n")
    status, *lines = head.decode("latin-1").split("\r\n")
    return status, [(k.strip(), v.strip()) for k, _, v in (line.partition(":") for line in lines)], payload


def response(key: str, url: str, html: bytes, date: str = DATE) -> Record:
    """A response record of a page, as if it had been fetched at `date`."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(html)}\r\n\r\n".encode() + html
    fields = [
        ("WARC-Type", "response"), ("WARC-Record-ID", record_id("response", key, url, hashlib.sha256(html).hexdigest())), ("WARC-Date", date),
        ("WARC-Target-URI", field_value(url)), ("WARC-Payload-Digest", digest(html)), ("WARC-Block-Digest", digest(http)),
        ("WARC-X-Page-ID", key), ("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(http))),
    ]
    return Record(fields, http)


def plain_text(html: str) -> str:
    """All visible text: a line for each block, single spaces inside, character references decoded."""
    text = TAG.sub("", BREAK.sub("\n", SKIPPED.sub(" ", html)))
    lines = (" ".join(line.split()) for line in unescape(text).split("\n"))
    return "\n".join(line for line in lines if line)


def derive(source: Record) -> tuple[Record, Record]:
    """(metadata, conversion) of a response, both referring to it and linked to each other.

    Both keep the source's target URI and date, and the digest of its payload and the page's id; the metadata record also has the source's
    HTTP status and headers, title, language and outgoing links. A payload whose digest isn't the recorded one is refused.
    """
    status, headers, payload = split_http(source.block)
    claimed = source.get("WARC-Payload-Digest")
    if claimed and not matches(claimed, payload):
        raise ValueError("the payload doesn't match its digest")
    own, uri, date = source.get("WARC-Record-ID") or "", source.get("WARC-Target-URI") or "", source.get("WARC-Date") or DATE
    html = payload.decode("utf-8", "replace")
    text = plain_text(html).encode()
    title, language = TITLE.search(html), LANGUAGE.search(html)
    facts: list[tuple[str, str]] = [("http-status", status), *((f"http-header-{k.lower()}", v) for k, v in headers)]
    facts += [("title", field_value(unescape(title[1])))] if title else []
    facts += [("language", language[1])] if language else []
    facts += [("outlink", f"{field_value(unescape(a or b or c))} {tag.lower()}/{name.lower()}") for tag, name, a, b, c in LINK.findall(html)]
    about = "".join(f"{k}: {v}\r\n" for k, v in facts).encode()
    ids = {kind: record_id(kind, own) for kind in ("metadata", "conversion")}

    kept = [("WARC-X-Page-ID", page)] if (page := source.get("WARC-X-Page-ID")) else []

    def build(kind: str, other: str, content: str, block: bytes) -> Record:
        fields = [
            ("WARC-Type", kind), ("WARC-Record-ID", ids[kind]), ("WARC-Date", date), ("WARC-Target-URI", uri), ("WARC-Refers-To", own),
            ("WARC-Refers-To-Target-URI", uri), ("WARC-Refers-To-Date", date), ("WARC-Concurrent-To", ids[other]),
            ("WARC-Source-Payload-Digest", digest(payload)), ("WARC-Block-Digest", digest(block)), *kept, ("Content-Type", content), ("Content-Length", str(len(block))),
        ]
        return Record(fields, block)

    return build("metadata", "conversion", "application/warc-fields", about), build("conversion", "metadata", "text/plain; charset=utf-8", text)


def member(record: Record) -> bytes:
    """The record as one member of a .warc.gz file."""
    return gzip.compress(record.dump(), LEVEL, mtime=0)


def members(data: bytes) -> Iterator[tuple[int, int, Record]]:
    """(offset, compressed length, record) of each member of a .warc.gz file; of a plain .warc file (offset, length, record)."""
    if data[:5] == b"WARC/":
        at = 0
        for record, stop in located(data):
            yield at, stop - at, record
            at = stop
        return
    view, at = memoryview(data), 0
    while at < len(data):
        reader, parts, stop = zlib.decompressobj(31), [], at
        while not reader.eof:
            if stop >= len(data):
                raise ValueError("a member is cut off")
            parts.append(reader.decompress(view[stop : stop + 65536]))
            stop = min(stop + 65536, len(data))
        size = stop - len(reader.unused_data) - at
        for record in parse(b"".join(parts)):
            yield at, size, record
        at += size


ARCHIVE = "file binary, first long, records long"


def _archive(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, size, first = [], 0, None

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([b"".join(held)], pa.binary()), pa.array([first], pa.int64()), pa.array([len(held)], pa.int64())], ["file", "first", "records"])

    for batch in batches:
        for page_id, url, html in zip(batch.column("page_id").to_pylist(), batch.column("url").to_pylist(), batch.column("html").cast(pa.large_binary()), strict=True):
            body = html.as_py() or b""
            held.append(member(response(str(page_id), url or "", body)))
            size += len(held[-1])
            first = page_id if first is None else first
            if size >= FILE:
                yield out()
                held, size, first = [], 0, None
    if held:
        yield out()


def archive(pages: DataFrame) -> DataFrame:
    """The pages' responses as .warc.gz files in a binary column, each of bounded size, made where the pages are read."""
    return pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string")).mapInArrow(_archive, ARCHIVE)


DERIVED = "record_id string, type string, refers_to string, target_uri string, date string, payload_digest string, block_digest string, content_length long, member binary"


def _rows(records: list[Record]) -> pa.RecordBatch:
    names = ("WARC-Record-ID", "WARC-Type", "WARC-Refers-To", "WARC-Target-URI", "WARC-Date", "WARC-Source-Payload-Digest", "WARC-Block-Digest")
    columns = [pa.array([r.get(n) for r in records], pa.string()) for n in names]
    columns += [pa.array([len(r.block) for r in records], pa.int64()), pa.array([member(r) for r in records], pa.binary())]
    return pa.RecordBatch.from_arrays(columns, [f.split()[0] for f in DERIVED.split(", ")])


def _derive(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for file in batch.column("file"):
            held: list[Record] = []
            for _, _, record in members(file.as_py()):
                if record.get("WARC-Type") == "response":
                    held += derive(record)
                if len(held) >= 512:
                    yield _rows(held)
                    held = []
            if held:
                yield _rows(held)


def derivatives(archives: DataFrame) -> DataFrame:
    """A metadata and a conversion record for each response in the files of `archives`; other records are passed over."""
    return archives.select("file").mapInArrow(_derive, DERIVED)


def read(spark: SparkSession, path: str) -> DataFrame:
    """.warc and .warc.gz files under a path that Spark can read, as rows with a file each."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.{warc,warc.gz}").option("recursiveFileLookup", "true").load(path)
    return files.select(F.col("content").alias("file"))


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows: list[tuple] = []
        for data in batch.column("member"):
            raw = data.as_py()
            (_, size, record), *_ = members(raw)
            assert size == len(raw)
            if record.get("WARC-Block-Digest") != digest(record.block):
                raise ValueError("a block doesn't match its digest")
            get = lambda n, r=record: r.get(n)
            page = get("WARC-X-Page-ID") or ""
            rows.append((int(page) if page.lstrip("-").isdigit() else None, get("WARC-Record-ID"), get("WARC-Type"), get("WARC-Refers-To"), get("WARC-Target-URI"), get("WARC-Concurrent-To"), get("WARC-Source-Payload-Digest"), get("WARC-Block-Digest"), len(record.block), zlib.crc32(record.dump())))
        columns = list(zip(*rows, strict=True)) if rows else [()] * 10
        kinds = [pa.int64()] + [pa.string()] * 7 + [pa.int64()] * 2
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], [f.split()[0] for f in DIGESTS.split(", ")])


DIGESTS = "page_id long, record_id string, type string, refers_to string, target_uri string, concurrent_to string, payload_digest string, block_digest string, content_length long, record_crc32 long"


def round_trip(pages: DataFrame) -> DataFrame:
    """Two rows for every page: its derivative records as read back from their compressed members.

    Pages are archived as responses, those are read and derived from, and what was written is read again and held
    against its digests. A null url counts as empty, a null html as an empty page; rows that repeat a page have the same
    records. Other columns are ignored. Nothing is shuffled.
    """
    return derivatives(archive(pages)).select("member").mapInArrow(_digests, DIGESTS)
