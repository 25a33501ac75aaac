"""WARC archives as a PySpark data source.

Written are `.warc.gz` files of one gzip member per record. Each member's header
has an `sl` extra field with its compressed and plain length, so a reader parses
the first bytes of a record - its WARC and HTTP headers - and steps over the
payload without inflating it, unless the payload is asked for. Files of other
writers are read too: plain, a gzip member per record, or all records in one member.
Tasks write files of their own, named after their job; each job adds a list of those
of the tasks that succeeded, so retries leave no trace, and further jobs add records.

`read` pushes wanted values of record_type, uri, record_id, refers_to and
payload_digest, and a prefix of the uri, to the reader as options, and columns as
the schema. (Spark's own filter pushdown is left off: in 4.1 a Python source that is
queried twice keeps the filters of its first query.)

Null payloads are empty; a null uri or id is left out and read as null; line ends
in headers are percent-encoded. Empty tables give an archive without records.
Repeated rows are records of their own. Payloads and headers may be of any length:
a task holds one whole record at a time, and batches are bounded by bytes. Columns
that the format has no place for are not written.
"""

from __future__ import annotations

import json
import struct
import uuid
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    InputPartition,
    WriterCommitMessage,
)
from pyspark.sql.types import StructType

from rentlens.llm.common import HEAVY, scratch, stored

SCHEMA = "record_id string, record_type string, uri string, refers_to string, payload_digest string, payload_bytes long, payload binary"
HEADERS = {"record_id": "WARC-Record-ID", "record_type": "WARC-Type", "uri": "WARC-Target-URI", "refers_to": "WARC-Refers-To", "payload_digest": "WARC-Payload-Digest"}
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
ID_PREFIX = "urn:x-record:"
DATE = "2024-01-01T00:00:00Z"
FILE_BYTES = 32 << 20
READ_BYTES = 1 << 20
HEAD_BYTES = 1 << 14
#: Files that name the files of a job, which follows.
LISTS = "_files-"
END = b"\r\n\r\n"
BATCH_ROWS, BATCH_BYTES = 1000, 16 << 20
#: Smaller payloads are stored again rather than referred to.
LEAST_REVISIT = 100


def filesystem(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path)


def clean(value: str) -> str:
    return value.replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A") if "\r" in value or "\n" in value else value


def record(row: dict) -> bytes:
    payload, revisit = row["payload"] or b"", row["record_type"] == "revisit"
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {row['payload_bytes']}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {row['record_type']}", f"WARC-Date: {DATE}"]
    head += [f"WARC-Record-ID: <{ID_PREFIX}{row['record_id']}>"] if row["record_id"] is not None else []
    head += [f"WARC-Target-URI: {clean(row['uri'])}"] if row["uri"] is not None else []
    head += [f"WARC-Profile: {PROFILE}"] if revisit else []
    head += [f"WARC-Refers-To: <{ID_PREFIX}{row['refers_to']}>"] if row["refers_to"] is not None else []
    head += [f"WARC-Payload-Digest: sha256:{row['payload_digest']}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def member(raw: bytes, level: int = 5) -> bytes:
    """A gzip member; its extra field holds the lengths where they fit."""
    packer = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = packer.compress(raw) + packer.flush()
    tail = struct.pack("<II", zlib.crc32(raw), len(raw) & 0xFFFFFFFF)
    total = 10 + 2 + 12 + len(body) + 8
    if max(total, len(raw)) >> 32:
        return b"\x1f\x8b\x08\x00" + bytes(5) + b"\xff" + body + tail
    extra = b"sl" + struct.pack("<HII", 8, total, len(raw))
    return b"\x1f\x8b\x08\x04" + bytes(5) + b"\xff" + struct.pack("<H", len(extra)) + extra + body + tail


@dataclass
class Written(WriterCommitMessage):
    files: list[str]


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, path: str) -> None:
        self.path, self.job = path, uuid.uuid4().hex

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        fs, folder = filesystem(self.path)
        fs.create_dir(folder, recursive=True)
        names, out, size = [], None, 0
        for batch in iterator:
            for k in range(len(batch)):
                row = batch.slice(k, 1).to_pylist()[0]
                if out is None or size >= FILE_BYTES:
                    if out is not None:
                        out.close()
                    names.append(f"{self.job}-{uuid.uuid4().hex}.warc.gz")
                    out, size = fs.open_output_stream(f"{folder}/{names[-1]}", compression=None), 0
                data = member(record(row))
                out.write(data)
                size += len(data)
        if out is not None:
            out.close()
        return Written(names)

    def commit(self, messages: list[Written | None]) -> None:
        fs, folder = filesystem(self.path)
        fs.create_dir(folder, recursive=True)
        with fs.open_output_stream(f"{folder}/{LISTS}{self.job}") as out:
            out.write(json.dumps(sorted(x for m in messages if m for x in m.files)).encode())

    def abort(self, messages: list[Written | None]) -> None:
        """Removes all files of the job, also those of tasks that failed and sent no message."""
        fs, folder = filesystem(self.path)
        for x in fs.get_file_info(pafs.FileSelector(folder, allow_not_found=True)):
            if x.base_name.startswith(self.job):
                fs.delete_file(x.path)


class Cursor:
    """Buffered reads of a seekable file; skipped bytes beyond the buffer are not read."""

    def __init__(self, file: pa.NativeFile) -> None:
        self.file, self.size, self.buffer, self.start, self.at = file, file.size(), b"", 0, 0

    def peek(self, n: int) -> bytes:
        first = self.at - self.start
        if first < 0 or first + n > len(self.buffer) and self.start + len(self.buffer) < self.size:
            self.file.seek(self.at)
            self.buffer, self.start, first = self.file.read(max(n, READ_BYTES)), self.at, 0
        return self.buffer[first : first + n]

    def skip(self, n: int) -> None:
        self.at += n


class Inflated:
    """The plain bytes of the gzip member at a cursor, whose length is not known, read from the start on."""

    def __init__(self, cursor: Cursor) -> None:
        self.cursor, self.unpacker, self.buffer = cursor, zlib.decompressobj(31), b""

    def peek(self, n: int) -> bytes:
        while len(self.buffer) < n and not self.unpacker.eof:
            data = self.unpacker.unconsumed_tail or self.cursor.peek(READ_BYTES)
            if not data:
                raise ValueError("a record ends too early")
            fresh = not self.unpacker.unconsumed_tail
            self.buffer += self.unpacker.decompress(data, READ_BYTES)
            if fresh:
                self.cursor.skip(len(data))
            if self.unpacker.eof:
                self.cursor.skip(-len(self.unpacker.unused_data))
        return self.buffer[:n]

    def skip(self, n: int) -> None:
        while n > 0 and (data := self.peek(min(n, READ_BYTES))):
            self.buffer, n = self.buffer[len(data) :], n - len(data)


def upto_headers(source: Cursor | Inflated) -> bytes:
    """The first bytes of the record that begins at the source, with all its WARC headers."""
    size = HEAD_BYTES
    while END not in (first := source.peek(size)):
        if len(first) < size:
            raise ValueError("a record ends within its headers")
        size *= 2
    return first


def plain_records(source: Cursor | Inflated) -> Iterator[tuple[bytes, Callable[[], bytes]]]:
    """Records one after the other up to the end of the source, or of one record where its file has more to follow."""
    while source.peek(1):
        if (blank := source.peek(2)) in (b"\r\n", b"\n"):
            source.skip(len(blank))
            continue
        if isinstance(source, Cursor) and source.peek(2) == b"\x1f\x8b":
            return
        first = upto_headers(source)
        total = first.index(END) + 4 + int(warc_headers(first).get("content-length", 0))
        kept: list[bytes] = []

        def whole(total=total, kept=kept) -> bytes:
            if not kept:
                kept.append(source.peek(total))
            return kept[0]

        yield first[:total], whole
        source.skip(total)


def records(cursor: Cursor) -> Iterator[tuple[bytes, Callable[[], bytes]]]:
    """(first bytes, a function that gives the whole record) of each record; moving on skips what was not asked for."""
    while cursor.at < cursor.size:
        head = cursor.peek(24)
        if head[:2] != b"\x1f\x8b":
            yield from plain_records(cursor)
        elif len(head) == 24 and head[3] == 4 and head[12:14] == b"sl":
            total, _ = struct.unpack("<II", head[16:24])
            body = 12 + struct.unpack("<H", head[10:12])[0]
            begin = cursor.at
            first = zlib.decompressobj(-15).decompress(cursor.peek(min(total, HEAD_BYTES))[body:], HEAD_BYTES)

            def whole(begin=begin, total=total, body=body) -> bytes:
                cursor.at = begin
                data = cursor.peek(total)
                raw = zlib.decompress(data[body:-8], -15)
                if zlib.crc32(raw) != struct.unpack("<I", data[-8:-4])[0]:
                    raise ValueError("a record is damaged")
                return raw

            yield first, whole
            cursor.at = begin + total
        else:
            inflated = Inflated(cursor)
            yield from plain_records(inflated)


def warc_headers(first: bytes) -> dict[str, str]:
    lines = first[: first.index(b"\r\n\r\n")].decode("utf-8", "replace").split("\r\n")
    return {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}


def header_value(headers: dict[str, str], column: str) -> str | None:
    value = headers.get(HEADERS[column].lower())
    if value is None:
        return None
    value = value.strip("<>").removeprefix(ID_PREFIX) if column in ("record_id", "refers_to") else value
    return value.removeprefix("sha256:") if column == "payload_digest" else value


@dataclass
class Files(InputPartition):
    names: list[str]

    def __init__(self, names: list[str]) -> None:
        super().__init__(names)
        self.names = names


class WarcReader(DataSourceReader):
    def __init__(self, options: dict[str, str], schema: StructType) -> None:
        self.path, self.schema, self.prefix = options["path"], schema, options.get("uri_prefix")
        self.wanted = {c: set(json.loads(options[c])) for c in HEADERS if c in options}

    def accepts(self, headers: dict[str, str]) -> bool:
        if any(header_value(headers, c) not in wanted for c, wanted in self.wanted.items()):
            return False
        return self.prefix is None or (header_value(headers, "uri") or "").startswith(self.prefix)

    def partitions(self) -> list[Files]:
        """Whole files, small ones together."""
        fs, folder = filesystem(self.path)
        found = [x for x in fs.get_file_info(pafs.FileSelector(folder)) if x.base_name.endswith((".warc", ".warc.gz"))]
        lists = [x for x in fs.get_file_info(pafs.FileSelector(folder)) if x.base_name.startswith(LISTS)]
        if lists:
            names: set[str] = set()
            for x in lists:
                with fs.open_input_stream(x.path) as listed:
                    names |= set(json.loads(listed.read()))
            found = [x for x in found if x.base_name in names]
        out, size = [], FILE_BYTES
        for x in sorted(found, key=lambda x: x.base_name):
            if size + x.size > FILE_BYTES:
                out.append(Files([]))
                size = 0
            out[-1].names.append(x.path)
            size += x.size
        return out or [Files([])]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        columns = self.schema.names
        fs, _ = filesystem(self.path)
        rows: list[dict] = []
        held = 0
        for name in partition.names:
            with fs.open_input_file(name) as file:
                for first, whole in records(Cursor(file)):
                    if b"\r\n\r\n" not in first:
                        first = whole()
                    headers = warc_headers(first)
                    if self.accepts(headers):
                        rows.append(self.row(first, whole, headers, columns))
                        held += len(rows[-1].get("payload") or b"")
                    if len(rows) >= BATCH_ROWS or held >= BATCH_BYTES:
                        yield self.batch(rows, columns)
                        rows, held = [], 0
        if rows:
            yield self.batch(rows, columns)

    def row(self, first: bytes, whole, headers: dict[str, str], columns: list[str]) -> dict:
        out = {c: header_value(headers, c) for c in columns if c in HEADERS}
        if "payload_bytes" in columns or "payload" in columns:
            start = first.index(b"\r\n\r\n") + 4
            is_http = headers.get("content-type", "").startswith("application/http")
            if is_http and first.find(b"\r\n\r\n", start) < 0:
                first = whole()
            body = first.index(b"\r\n\r\n", start) + 4 if is_http else start
            lengths = [x.partition(b":")[2] for x in first[start:body].split(b"\r\n") if x.lower().startswith(b"content-length:")]
            end = start + int(headers.get("content-length", 0))
            out["payload_bytes"] = int(lengths[0]) if lengths else end - body
            if "payload" in columns:
                out["payload"] = None if headers.get("warc-type") == "revisit" else whole()[body:end]
        return out

    def batch(self, rows: list[dict], columns: list[str]) -> pa.RecordBatch:
        kinds = {"payload": pa.binary(), "payload_bytes": pa.int64()}
        return pa.RecordBatch.from_arrays([pa.array([r.get(c) for r in rows], kinds.get(c, pa.string())) for c in columns], columns)


class WarcSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> WarcReader:
        return WarcReader(self.options, schema)

    def writer(self, schema: StructType, overwrite: bool) -> WarcWriter:
        return WarcWriter(self.options["path"])


def register(spark: SparkSession) -> None:
    spark.dataSource.register(WarcSource)


def page_records(pages: DataFrame) -> DataFrame:
    """A record per page. Of pages with equal payloads of LEAST_REVISIT bytes or more the
    smallest page_id is the response (also where its row repeats), others revisit it.
    """
    rows = pages.select("page_id", F.col("url").alias("uri"), F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("payload"))
    rows = rows.withColumns({"payload_digest": F.sha2("payload", 256), "payload_bytes": F.octet_length("payload").cast("long")})
    large = F.col("payload_bytes") >= LEAST_REVISIT
    firsts = rows.where(large).groupBy(F.col("payload_digest").alias("digest_")).agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
    firsts = stored(firsts.where("n > 1"), scratch(pages.sparkSession, "revisits"))
    # Very common payloads are few, so their rows stay where they are; rows without a revisit are dealt evenly.
    common = max((firsts.agg(F.sum("n")).first()[0] or 0) // HEAVY, 1)
    hot = firsts.where(F.col("n") > common).select(F.col("digest_").alias("hot_"), F.col("first").alias("hot_first"))
    rows = rows.join(F.broadcast(hot), rows["payload_digest"] == F.col("hot_"), "left")
    alone = F.concat(F.lit("-"), F.xxhash64("page_id", "payload_digest", F.monotonically_increasing_id()).cast("string"))
    rows = rows.withColumn("key", F.when(large & F.col("hot_").isNull(), F.col("payload_digest")).otherwise(alone))
    joined = rows.join(firsts.where(F.col("n") <= common).drop("n"), rows["key"] == F.col("digest_"), "left")
    joined = joined.withColumn("first", F.coalesce("hot_first", "first"))
    again = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    return joined.select(
        F.col("page_id").cast("string").alias("record_id"),
        F.when(again, "revisit").otherwise("response").alias("record_type"),
        "uri",
        F.when(again, F.col("first").cast("string")).alias("refers_to"),
        "payload_digest", "payload_bytes",
        F.when(~again, F.col("payload")).alias("payload"),
    )


def archive(frame: DataFrame, path: str) -> None:
    frame.write.format("warc").mode("append").save(path)


def read(spark: SparkSession, path: str, columns: list[str] | None = None, uri_prefix: str | None = None, **wanted: list[str]) -> DataFrame:
    """Records of an archive. Without `payload` among the columns no payload is inflated."""
    kinds = dict(x.split(" ") for x in SCHEMA.split(", "))
    options = {c: json.dumps(v) for c, v in wanted.items()} | ({"uri_prefix": uri_prefix} if uri_prefix else {})
    schema = ", ".join(f"{c} {kinds[c]}" for c in columns or kinds)
    return spark.read.format("warc").schema(schema).options(**options).load(path)


def archived(pages: DataFrame, path: str) -> DataFrame:
    """Writes pages, reads them back: a row per page; digests of stored payloads are computed anew."""
    register(pages.sparkSession)
    archive(page_records(pages), path)
    found = read(pages.sparkSession, path)
    return found.select(
        F.col("record_id").cast("long").alias("page_id"),
        F.coalesce(F.octet_length("payload").cast("long"), "payload_bytes").alias("payload_bytes"),
        F.coalesce(F.sha2("payload", 256), "payload_digest").alias("payload_digest"),
        "record_type",
        F.col("refers_to").cast("long").alias("refers_to"),
    )
