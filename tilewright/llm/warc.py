"""WARC archives: a writer and a Python data source that reads them.

The source plans partitions by file size, parses each record's headers first, judges pushed-down predicates on the header
columns, and inflates and decodes a payload only if the record is wanted and the asked schema has `payload`. Records are
gzip members of their own; the writer notes their length in the member's header (field "sl" of the WARC standard), so an
unwanted record is skipped by a seek. Members without that note or of several records, and plain .warc files, are read too.
Where a folder has the list of archives that the writer leaves, only those are read.

    spark.dataSource.register(WarcDataSource)
    spark.read.format("warc").schema("page_id bigint, payload binary").load(path).where("record_type = 'response'")

Ask by schema for the columns you need (of SCHEMA, in any order; others are null): Spark prunes no columns of Python
sources. Set spark.sql.python.filterPushdown.enabled for pushdown; without it Spark filters afterwards.

Defined cases: a null payload is written as empty; a null page id or url has no header and reads as null; white space and
control characters of a url are percent-encoded; repeated rows write repeated records; no pages give no archive, and a
folder without archives reads as no rows. Only the named columns are read, so others cannot clash. A broken record raises ValueError naming file and offset.
"""

from __future__ import annotations

import hashlib
import operator
import os
import struct
import uuid
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import partial

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualNullSafe, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, IsNull, LessThan, LessThanOrEqual, StringContains, StringEndsWith, StringStartsWith

from tilewright.llm.common import lookup, scratch, staged, text_batches

SCHEMA = T.StructType().add("file", "string").add("offset", "long").add("record_type", "string").add("record_id", "string").add("target_uri", "string").add("date", "string").add("refers_to", "string").add("content_type", "string").add("content_length", "long").add("payload_digest", "string").add("page_id", "long").add("refers_to_page_id", "long").add("payload_length", "long").add("payload", "binary")
#: Column of each header; the last three are extensions of this writer.
HEADERS = {"record_type": b"warc-type", "record_id": b"warc-record-id", "target_uri": b"warc-target-uri", "date": b"warc-date", "refers_to": b"warc-refers-to", "content_type": b"content-type", "content_length": b"content-length", "payload_digest": b"warc-payload-digest", "page_id": b"x-page-id", "refers_to_page_id": b"x-refers-to-page-id", "payload_length": b"x-payload-length"}
NUMBERS = {"content_length", "page_id", "refers_to_page_id", "payload_length"}
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
SPLIT_BYTES, FILE_BYTES, BATCH_ROWS, BATCH_BYTES, HEAD_BYTES = 64 << 20, 256 << 20, 1000, 8 << 20, 4096
LEAST_PAYLOAD = 100
#: The archives of a folder that count: a task that is repeated may leave one that its second run did not write.
MANIFEST = "_archives"


def record_uri(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.UUID(bytes=hashlib.sha256(f'{page_id}/{digest}'.encode()).digest()[:16], version=5)}>"


def gzip_member(data: bytes, level: int = 6) -> bytes:
    """One gzip member with its compressed and plain length in the header."""
    deflate = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = deflate.compress(data) + deflate.flush()
    head = b"\x1f\x8b\x08\x04\0\0\0\0\0\xff" + struct.pack("<H2sHII", 12, b"sl", 8, 24 + len(body) + 8, len(data) & 0xFFFFFFFF)
    return head + body + struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, date: str) -> bytes:
    """A response record, or (with refers_to) a revisit record without the payload."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to is not None else http + payload
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {record_uri(page_id, digest)}", f"WARC-Date: {date}"]
    if url is not None:
        lines.append("WARC-Target-URI: " + "".join(c if c > " " and c != "\x7f" else f"%{ord(c):02X}" for c in url))
    if page_id is not None:
        lines.append(f"X-Page-Id: {page_id}")
    if refers_to is not None:
        lines += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: {record_uri(refers_to, digest)}", f"X-Refers-To-Page-Id: {refers_to}"]
    lines += [f"WARC-Payload-Digest: sha256:{digest}", f"X-Payload-Length: {len(payload)}", "Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _write(batches: Iterator[pa.RecordBatch], folder: str, date: str) -> Iterator[pa.RecordBatch]:
    """Archives of one task: written beside their name and then moved, so a repeated task replaces its own."""
    from pyspark import TaskContext

    fs, root = pafs.FileSystem.from_uri(folder)
    task, n, out, sink, size, rows = TaskContext.get(), 0, [], None, 0, 0

    def close() -> None:
        nonlocal sink, n, size, rows
        if sink is not None:
            sink.close()
            name = f"{root}/part-{task.partitionId():05d}-{n:03d}.warc.gz"
            fs.move(hidden, name)
            out.append((name, rows, size))
            sink, n, size, rows = None, n + 1, 0, 0

    for batch in batches:
        for page_id, url, html, digest, refers_to in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if sink is None:
                hidden = f"{root}/.part-{task.partitionId():05d}-{n:03d}.{task.taskAttemptId()}"
                sink = fs.open_output_stream(hidden)
            member = gzip_member(record(page_id, url, (html or "").encode(), digest, refers_to, date))
            sink.write(member)
            size, rows = size + len(member), rows + 1
            if size >= FILE_BYTES:
                close()
    close()
    yield pa.record_batch([pa.array([x[i] for x in out], kind) for i, kind in enumerate((pa.string(), pa.int64(), pa.int64()))], names=["file", "records", "bytes"])


def with_revisits(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", least: int = LEAST_PAYLOAD) -> DataFrame:
    """page_id, url, html, digest and refers_to: the smallest page_id of equal payloads of at least `least` bytes, null for
    that record itself (all of them if they share it), for smaller payloads and where every page_id is null."""
    data = F.coalesce(F.col(html), F.lit(""))
    rows = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), data.alias("html"), F.sha2(data.cast("binary"), 256).alias("digest"))
    first = rows.where(F.octet_length("html") >= least).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    found = lookup(rows, staged(first, "warc-payloads"), ["digest"])
    return found.select("page_id", "url", "html", "digest", F.when(F.col("page_id").isNull() | (F.col("page_id") != F.col("first")), F.col("first")).alias("refers_to"))


def write_archives(pages: DataFrame, folder: str | None = None, date: str = "1970-01-01T00:00:00Z", **columns) -> DataFrame:
    """Write pages as archives into the folder (a new shared one if None): file, records and bytes of each archive."""
    spark = pages.sparkSession
    text_batches(spark)
    folder = folder or scratch(spark, "warc")
    fs, root = pafs.FileSystem.from_uri(folder)
    fs.create_dir(root)
    written = with_revisits(pages, **columns).mapInArrow(partial(_write, folder=folder, date=date), "file string, records bigint, bytes bigint")
    written = staged(written, "warc-files")
    with fs.open_output_stream(f"{root}/{MANIFEST}") as sink:  # one line for each archive, of FILE_BYTES if there is much
        for r in written.select("file").toLocalIterator():
            sink.write(f"{os.path.basename(r.file)}\n".encode())
    return written.withColumn("folder", F.lit(folder))


# Reading


@dataclass
class Files(InputPartition):
    paths: list[str]


class _Member:
    """The plain bytes of the gzip member (or plain record) at an offset, inflated as far as asked for."""

    def __init__(self, stream, at: int, packed: bool):
        self.stream, self.at, self.packed, self.data, self.length, self.plain = stream, at, packed, b"", None, 0
        if packed:
            stream.seek(at)
            head = stream.read(HEAD_BYTES)
            if len(head) >= 24 and head[3] & 4 and head[12:14] == b"sl":
                self.length, self.plain = struct.unpack_from("<II", head, 16)
            self.inflate, self.pending, self.read_to = zlib.decompressobj(31), head, at + len(head)
        else:
            self.read_to = at

    def more(self, want: int) -> bool:
        """Another piece of plain bytes; false at the end."""
        if not self.packed:
            self.stream.seek(self.read_to)
            piece = self.stream.read(want)
            self.read_to += len(piece)
        else:
            piece = b""
            while not piece and not self.inflate.eof:
                if not self.pending:
                    self.stream.seek(self.read_to)
                    self.pending = self.stream.read(max(HEAD_BYTES, want // 4))
                    self.read_to += len(self.pending)
                    if not self.pending:
                        raise ValueError("the member is cut off")
                piece = self.inflate.decompress(self.pending, want)
                self.pending = self.inflate.unconsumed_tail
        self.data += piece
        return bool(piece)

    def upto(self, n: int) -> bytes:
        parts, have = [self.data], len(self.data)
        while have < n:
            self.data = b""
            if not self.more(n - have):
                raise ValueError("the record is cut off")
            parts.append(self.data)
            have += len(self.data)
        self.data = b"".join(parts)
        return self.data[:n]

    def then(self, plain: int) -> int | None:
        """Behind the record of so many plain bytes: None if this member holds another one (its bytes come next), else the
        offset behind the member. Nothing more is inflated if the member's noted lengths say that the record is all of it."""
        if not self.packed:
            return self.at + plain
        if self.length and self.plain <= plain:
            return self.at + self.length
        self.length, left = None, plain
        while left > len(self.data):
            left, self.data = left - len(self.data), b""
            if not self.more(1 << 20):
                if left > 4:  # the last record may lack its closing line breaks
                    raise ValueError("the record is cut off")
                break
        self.data = self.data[left:]
        if self.data or self.more(HEAD_BYTES):
            return None
        return self.read_to - len(self.inflate.unused_data)


def _headers(member: _Member) -> tuple[dict[bytes, bytes], int]:
    """Headers by lower-case name and where the block starts."""
    while (at := member.data.find(b"\r\n\r\n")) < 0:
        if not member.more(HEAD_BYTES):
            raise ValueError("the headers do not end")
    lines = member.data[:at].split(b"\r\n")
    if not lines[0].startswith(b"WARC/"):
        raise ValueError("no WARC record")
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(b":") for x in lines[1:])}, at + 4


_COMPARE = {EqualTo: operator.eq, GreaterThan: operator.gt, GreaterThanOrEqual: operator.ge, LessThan: operator.lt, LessThanOrEqual: operator.le, StringStartsWith: str.startswith, StringEndsWith: str.endswith, StringContains: operator.contains}


def predicate(f: Filter) -> Callable[[dict], bool] | None:
    """A test on header columns that keeps what the filter keeps, or None if it needs more than headers."""
    if len(getattr(f, "attribute", ())) != 1 or f.attribute[0] not in HEADERS:
        return None
    name = f.attribute[0]
    if isinstance(f, IsNull):
        return lambda row: row[name] is None
    if isinstance(f, IsNotNull):
        return lambda row: row[name] is not None
    if isinstance(f, EqualNullSafe):
        return lambda row: row[name] == f.value
    if isinstance(f, In):
        return lambda row: row[name] is not None and row[name] in f.value
    if (test := _COMPARE.get(type(f))) is not None:
        return lambda row: row[name] is not None and test(row[name], f.value)
    return None


def records(stream, path: str, packed: bool, wanted: list[Callable[[dict], bool]], payload: bool) -> Iterator[dict]:
    """The wanted records of an archive."""
    end, at, member = stream.size(), 0, None
    while at < end:
        try:
            member = member or _Member(stream, at, packed)
            heads, start = _headers(member)
            row: dict = {"file": path, "offset": at}
            for name, header in HEADERS.items():
                value = heads.get(header)
                row[name] = None if value is None else int(value) if name in NUMBERS else value.decode("utf-8", "replace")
            size = row["content_length"] or 0
            if all(test(row) for test in wanted):
                row["payload"] = None
                if payload and row["record_type"] != "revisit":
                    block = member.upto(start + size)[start:]
                    if (row["content_type"] or "").startswith("application/http"):
                        block = block.partition(b"\r\n\r\n")[2]
                    row["payload"] = block
                yield row
            behind = member.then(start + size + 4)
            if behind is None:
                continue
            at, member = behind, None
            if at > end + 4:  # the last record may lack its closing line breaks
                raise ValueError("the record is cut off")
        except (ValueError, zlib.error, struct.error) as error:
            raise ValueError(f"{path} at {at}: {error}") from error


class WarcReader(DataSourceReader):
    def __init__(self, options: dict[str, str], schema: T.StructType):
        self.path, self.split, self.schema = options["path"], int(options.get("splitbytes", SPLIT_BYTES)), schema
        self.filters: list[Filter] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if predicate(f) is None:
                yield f
            else:
                self.filters.append(f)

    def partitions(self) -> list[Files]:
        fs, root = pafs.FileSystem.from_uri(self.path)
        info = fs.get_file_info(root)
        found = [info] if info.is_file else fs.get_file_info(pafs.FileSelector(root, recursive=True))
        files = sorted((x.path, x.size) for x in found if x.is_file and x.path.endswith((".warc", ".warc.gz")) and not os.path.basename(x.path).startswith("."))
        listed = [x.path for x in found if x.is_file and os.path.basename(x.path) == MANIFEST]
        for manifest in listed:
            with fs.open_input_stream(manifest) as lines:
                names = set(lines.read().decode().split("\n"))
            files = [x for x in files if os.path.dirname(x[0]) != os.path.dirname(manifest) or os.path.basename(x[0]) in names]
        out, held, size = [], [], 0
        for path, n in files:
            if held and size + n > self.split:
                out.append(Files(held))
                held, size = [], 0
            held.append(path)
            size += n
        return [*out, Files(held)]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        kind = to_arrow_schema(self.schema)
        fs, _ = pafs.FileSystem.from_uri(self.path)
        wanted = [predicate(f) for f in self.filters]
        rows, size = [], 0
        for path in partition.paths:
            with fs.open_input_file(path) as stream:
                for row in records(stream, path, path.endswith(".gz"), wanted, "payload" in kind.names):
                    rows.append(row)
                    size += len(row["payload"] or b"")
                    if len(rows) >= BATCH_ROWS or size >= BATCH_BYTES:
                        yield pa.record_batch([pa.array([r.get(f.name) for r in rows], f.type) for f in kind], schema=kind)
                        rows, size = [], 0
        if rows:
            yield pa.record_batch([pa.array([r.get(f.name) for r in rows], f.type) for f in kind], schema=kind)


class WarcDataSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> T.StructType:
        return SCHEMA

    def reader(self, schema: T.StructType) -> WarcReader:
        return WarcReader(self.options, schema)


def read_archives(spark: SparkSession, folder: str, columns: list[str]) -> DataFrame:
    """The columns of SCHEMA asked for, with header predicates pushed down."""
    spark.dataSource.register(WarcDataSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark.read.format("warc").schema(T.StructType([SCHEMA[c] for c in columns])).load(folder)


def bare_digest(column: str = "payload_digest") -> Column:
    return F.regexp_replace(F.col(column), "^sha256:", "")
