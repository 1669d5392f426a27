"""WARC archives as a Python data source, and archiving of pages with revisit records.

`register(spark)` makes the format "warc" known. Reading plans a partition for each file (the writer starts a
new file at a bound), takes equality, membership and prefix predicates on the record type and other header
columns, parses a record's headers first and passes over the block of a record that it does not want: in a
gzip archive by the member length that the writer leaves in the member's "sl" field, otherwise by
Content-Length. Each record is a gzip member of its own, as the format asks.

Read options: content = "payload" (default), "digest" (payloads are hashed and counted, not returned) or
"headers" (blocks are never decoded). Write options: compression = "gzip" (default) or "none", file_bytes.

Defined results of `archive`: a null html is the empty payload; equal payloads of at least min_bytes keep
one response, that of the largest page_id (rows that repeat that page_id too are all responses; a null
page_id ranks lowest); a null url gives a record without target; an empty table gives no rows.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    EqualNullSafe,
    EqualTo,
    In,
    InputPartition,
    StringStartsWith,
    WriterCommitMessage,
)

from .common import new_path, stored

FILE_BYTES = 128 << 20
BATCH_BYTES, BATCH_ROWS = 4 << 20, 2048
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP_HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
SCHEMA = "record_type string, record_id string, target_uri string, date string, refers_to string, payload_digest string, payload_bytes long, headers map<string,string>, payload binary"
TO_WRITE = "record_type string, record_id string, target_uri string, date string, refers_to string, payload binary"
#: Columns that predicates can be pushed on, and their headers.
HEADERS = {"record_type": "warc-type", "record_id": "warc-record-id", "target_uri": "warc-target-uri", "date": "warc-date", "refers_to": "warc-refers-to"}


def digest32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data, usedforsecurity=False).digest()).decode()


def _clean(value: str) -> str:
    """A header value on one line."""
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", value)


def build(record_type: str, record_id: str, target: str | None, date: str, refers_to: str | None, payload: bytes) -> bytes:
    """A record; a revisit names the payload's digest and length but does not hold it."""
    block = HTTP_HEAD + (b"" if record_type == "revisit" else payload)
    lines = [f"WARC/1.1\r\nWARC-Type: {record_type}", f"WARC-Record-ID: <{_clean(record_id)}>", f"WARC-Date: {date}"]
    if target is not None:
        lines.append(f"WARC-Target-URI: {_clean(target)}")
    if refers_to is not None:
        lines.append(f"WARC-Refers-To: <{_clean(refers_to)}>\r\nWARC-Profile: {REVISIT}")
    lines.append(f"WARC-Payload-Digest: sha1:{digest32(payload)}\r\nX-Payload-Length: {len(payload)}")
    lines.append(f"Content-Type: application/http; msgtype=response\r\nContent-Length: {len(block)}\r\n\r\n")
    return "\r\n".join(lines).encode() + block + b"\r\n\r\n"


def gzip_member(data: bytes, level: int = 1) -> bytes:
    """A gzip member that names its own compressed length and data length in an extra field."""
    packer = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = packer.compress(data) + packer.flush()
    tail = struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)
    total = 24 + len(body) + 8
    if total >= 1 << 32:
        return b"\x1f\x8b\x08\x00\0\0\0\0\0\xff" + body + tail
    return b"\x1f\x8b\x08\x04\0\0\0\0\0\xff" + struct.pack("<H2sHII", 12, b"sl", 8, total, len(data) & 0xFFFFFFFF) + body + tail


def parse_headers(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8", "replace").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError(f"not a WARC record: {lines[0][:40]!r}")
    return {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines[1:] if line)}


def _find(headers: dict[str, str], column: str) -> str | None:
    value = headers.get(HEADERS[column])
    return value[1:-1] if value and value[0] == "<" and value[-1] == ">" else value


class _Window:
    """Bytes of a file from a position that moves forward; at most a record and a read-ahead are held."""

    AHEAD = 1 << 18

    def __init__(self, file):
        self.file, self.at, self.held, self.size = file, 0, b"", file.size()

    def peek(self, n: int) -> bytes:
        if len(self.held) < n and self.at + len(self.held) < self.size:
            self.file.seek(self.at + len(self.held))
            self.held += self.file.read(max(n - len(self.held), self.AHEAD))
        return self.held[:n]

    def skip(self, n: int) -> None:
        self.at, self.held = self.at + n, self.held[n:]

    def take(self, n: int) -> bytes:
        out = self.peek(n)
        self.skip(n)
        return out


def records(file, wanted, decode: bool) -> Iterator[tuple[dict[str, str], bytes | None]]:
    """Headers and block (None unless decode) of each record for whose headers wanted is true."""
    win = _Window(file)
    while win.at < win.size:
        start = win.peek(24)
        if start[:3] != b"\x1f\x8b\x08":  # plain
            end, n = -1, 1024
            while (end := win.peek(n).find(b"\r\n\r\n")) < 0:
                if win.at + n >= win.size:
                    if win.peek(n).strip():
                        raise ValueError("a record is cut off")
                    return
                n *= 4
            headers = parse_headers(win.take(end + 4)[:-4])
            length = int(headers["content-length"])
            if win.at + length > win.size:
                raise ValueError("a record is cut off")
            block = None
            if wanted(headers):
                block = win.take(length) if decode else None
                win.skip(0 if decode else length)
                yield headers, block
            else:
                win.skip(length)
            while win.peek(1) in (b"\r", b"\n"):
                win.skip(1)
            continue
        total = struct.unpack("<I", start[16:20])[0] if start[3] == 4 and start[12:14] == b"sl" else None
        if total is not None and win.at + total > win.size:
            raise ValueError("a record is cut off")
        unpack, data, used, n = zlib.decompressobj(31), b"", 0, 2048
        while b"\r\n\r\n" not in data and not unpack.eof:  # headers first
            piece = win.peek(min(n, total or n))[used:]
            if not piece and not unpack.unconsumed_tail:
                raise ValueError("a record is cut off")
            used += len(piece)
            data += unpack.decompress(unpack.unconsumed_tail + piece, 4096)
            n *= 2
        head, _, rest = data.partition(b"\r\n\r\n")
        headers = parse_headers(head)
        keep = wanted(headers)
        if total is not None and not (keep and decode):
            win.skip(total)
            if keep:
                yield headers, None
            continue
        length = int(headers["content-length"])
        parts = [rest] if keep and decode else []
        while not unpack.eof:
            piece = win.peek(total or used + (1 << 18))[used:]
            used += len(piece)
            if not piece and not unpack.unconsumed_tail:
                raise ValueError("a record is cut off")
            more = unpack.decompress(unpack.unconsumed_tail + piece, 1 << 22)
            if keep and decode:
                parts.append(more)
        win.skip(total or used - len(unpack.unused_data))
        if keep:
            yield headers, b"".join(parts)[:length] if decode else None


@dataclass
class WarcFile(InputPartition):
    path: str


def _holds(predicates: list, headers: dict[str, str]) -> bool:
    for p in predicates:
        value = _find(headers, p.attribute[0])
        if isinstance(p, In):
            if value not in p.value:
                return False
        elif isinstance(p, StringStartsWith):
            if value is None or not value.startswith(p.value):
                return False
        elif value != p.value:
            return False
    return True


class WarcReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.content, self.predicates = options["path"], options.get("content", "payload"), []

    def pushFilters(self, filters):
        for f in filters:
            if isinstance(f, (EqualTo, EqualNullSafe, In, StringStartsWith)) and len(f.attribute) == 1 and f.attribute[0] in HEADERS:
                self.predicates.append(f)
            else:
                yield f

    def partitions(self):
        files, root = pafs.FileSystem.from_uri(self.path)
        info = files.get_file_info(root)
        found = files.get_file_info(pafs.FileSelector(root, recursive=True)) if info.type == pafs.FileType.Directory else [info]
        return [WarcFile(f.path) for f in sorted(found, key=lambda f: f.path) if f.type == pafs.FileType.File and not re.search(r"(^|/)[._]", f.path[len(root) :])] or [WarcFile("")]

    def read(self, partition):
        schema = pa.schema([*((c, pa.string()) for c in (*HEADERS, "payload_digest")), ("payload_bytes", pa.int64()), ("headers", pa.map_(pa.string(), pa.string())), ("payload", pa.binary())])
        files, _ = pafs.FileSystem.from_uri(self.path)
        rows, held = [], 0
        if not partition.path:
            return
        with files.open_input_file(partition.path) as file:
            for headers, block in records(file, lambda h: _holds(self.predicates, h), self.content != "headers"):
                payload = block
                if block is not None and headers.get("content-type", "").startswith("application/http"):
                    payload = block.partition(b"\r\n\r\n")[2]
                named = headers.get("warc-payload-digest", "").removeprefix("sha1:") or None
                size = headers.get("x-payload-length")
                size = int(size) if size is not None else None
                if payload is not None and headers.get("warc-type") != "revisit":
                    if named is not None and digest32(payload) != named:
                        raise ValueError(f"payload and digest of {headers.get('warc-record-id')} differ")
                    size, named = len(payload), named or digest32(payload)
                kept = payload if self.content == "payload" else None
                rows.append((*(_find(headers, c) for c in HEADERS), named, size, list(headers.items()) if self.content != "digest" else [], kept))
                held += len(kept or b"") + 500
                if held >= BATCH_BYTES or len(rows) >= BATCH_ROWS:
                    yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
                    rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


@dataclass
class Written(WriterCommitMessage):
    names: list[str]


class WarcWriter(DataSourceArrowWriter):
    """Each task writes files of its own under a name of this job; a commit moves those of successful tasks into place."""

    def __init__(self, options: dict, overwrite: bool):
        self.path, self.overwrite = options["path"], overwrite
        self.gzip = options.get("compression", "gzip") == "gzip"
        self.file_bytes = int(options.get("file_bytes", FILE_BYTES))
        self.job = f"_writing-{uuid.uuid4().hex}"

    def write(self, iterator):
        files, root = pafs.FileSystem.from_uri(self.path)
        files.create_dir(f"{root}/{self.job}", recursive=True)
        names, out, size = [], None, 0
        for batch in iterator:
            columns = [batch.column(batch.schema.get_field_index(c)) for c in ("record_type", "record_id", "target_uri", "date", "refers_to", "payload")]
            for row in zip(*columns, strict=True):
                data = build(*(x.as_py() for x in row))
                data = gzip_member(data) if self.gzip else data
                if out is None or size + len(data) > self.file_bytes:
                    if out is not None:
                        out.close()
                    names.append(f"{uuid.uuid4().hex}.warc" + ".gz" * self.gzip)
                    out, size = files.open_output_stream(f"{root}/{self.job}/{names[-1]}", compression=None), 0
                out.write(data)
                size += len(data)
        if out is not None:
            out.close()
        return Written(names)

    def commit(self, messages):
        files, root = pafs.FileSystem.from_uri(self.path)
        files.create_dir(root, recursive=True)
        if self.overwrite:
            for f in files.get_file_info(pafs.FileSelector(root)):
                if f.type == pafs.FileType.File:
                    files.delete_file(f.path)
        for message in messages:
            for name in message.names if message else ():
                files.move(f"{root}/{self.job}/{name}", f"{root}/{name}")
        self.abort(messages)

    def abort(self, messages):
        files, root = pafs.FileSystem.from_uri(self.path)
        if files.get_file_info(f"{root}/{self.job}").type == pafs.FileType.Directory:
            files.delete_dir(f"{root}/{self.job}")


class WarcSource(DataSource):
    @classmethod
    def name(cls):
        return "warc"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return WarcReader(self.options)

    def writer(self, schema, overwrite):
        return WarcWriter(self.options, overwrite)


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)


def archive(pages: DataFrame, path: str, min_bytes: int = 0, date: str = "2000-01-01T00:00:00Z") -> None:
    """Write a record for each row of pages (page_id, url, html) below path; repeated payloads become revisits."""
    register(pages.sparkSession)
    html = F.coalesce(F.col("html").cast("binary"), F.lit(b""))
    marked = pages.select("page_id", "url", html.alias("payload"))
    large = F.octet_length("payload") >= min_bytes
    # Only digests that occur more than once can make a revisit: a table as large as the repetition, which
    # Spark broadcasts if its files are under the threshold and else joins by shuffle.
    keepers = marked.where(large).groupBy(F.sha1("payload").alias("digest")).agg(F.max("page_id").alias("keeper"), F.count("*").alias("n")).where("n > 1").select("digest", "keeper")
    keepers = stored(keepers, "keepers")
    urn = lambda c: F.concat(F.lit("urn:page:"), F.coalesce(F.col(c).cast("string"), F.lit("null")))
    joined = marked.withColumn("digest", F.when(large, F.sha1("payload"))).join(keepers.withColumn("again", F.lit(True)), "digest", "left")
    revisit = F.col("again").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("keeper"))
    out = joined.select(
        F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        urn("page_id").alias("record_id"),
        F.col("url").alias("target_uri"),
        F.lit(date).alias("date"),
        F.when(revisit, urn("keeper")).alias("refers_to"),
        "payload",
    )
    out.write.format("warc").mode("append").save(path)


def round_trip(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to, as read back from the archives of pages."""
    spark = pages.sparkSession
    path = new_path(spark, "warc")
    archive(pages, path, min_bytes)
    read = spark.read.format("warc").option("content", "digest").load(path)
    page = lambda c: F.expr(f"try_cast(regexp_extract({c}, 'urn:page:(.*)', 1) AS BIGINT)")
    return read.select(page("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", page("refers_to").alias("refers_to"))
