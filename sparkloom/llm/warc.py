"""WARC archives as a Spark data source, and a writer that stores equal payloads once.

Each record is a gzip member of its own whose header's extra field "SL" holds the member's compressed and plain length, so
a reader can inflate a record's headers, test them, and step over the rest.  Members without the field (other writers')
are inflated to their end and are read all the same.

Reader: ``spark.read.format("warc").load(path)`` after ``register(spark)``.  Files are planned as byte ranges of
``split_bytes``; a range reads the members that begin in it.  Filters on record_type, record_id, target_uri,
payload_digest and refers_to (=, IN, IS NOT NULL) are pushed down and tested on the headers; with option
``payload=false`` no payload is decoded.

Writer: every task writes files of its own name under ``_temporary`` and the driver moves those of the attempts that
succeeded, so that a lost executor leaves nothing behind.

Both use pyarrow's file systems, so that file, hdfs and s3 paths work on executors.
"""

from __future__ import annotations

import base64
import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, In, InputPartition, IsNotNull, WriterCommitMessage
from pyspark.sql.types import StructType

from .common import shared_path

SCHEMA = "record_type string, record_id string, target_uri string, date string, payload_digest string, refers_to string, content_length bigint, payload_length bigint, http_headers string, payload binary, file string, offset bigint"
SPLIT_BYTES = 64 << 20
FILE_BYTES = 256 << 20
#: Payloads from so many bytes on are stored once.
SHARED_FROM = 1000
_PUSHED = ("record_type", "record_id", "target_uri", "payload_digest", "refers_to")


def _fs(path: str):
    from pyarrow import fs

    if re.match(r"file:/(?!//)", path):
        path = "file:///" + path[5:].lstrip("/")
    return (fs.LocalFileSystem(), path) if path.startswith("/") else fs.FileSystem.from_uri(path)


def _join(path: str, name: str) -> str:
    return f"{path.rstrip('/')}/{name}"


# ---- records


def member(block: bytes, level: int = 4) -> bytes:
    """block as a gzip member with its lengths in the extra field."""
    made = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = made.compress(block) + made.flush()
    tail = struct.pack("<II", zlib.crc32(block), len(block) & 0xFFFFFFFF)
    size = 12 + 12 + len(body) + 8
    if size >= 1 << 32 or len(block) >= 1 << 32:
        return b"\x1f\x8b\x08\x00\x00\x00\x00\x00\x00\xff" + body + tail
    return b"\x1f\x8b\x08\x04\x00\x00\x00\x00\x00\xff" + struct.pack("<H2sHII", 12, b"SL", 8, size, len(block)) + body + tail


def record(headers: list[tuple[str, str | None]], block: bytes) -> bytes:
    lines = ["WARC/1.1", *(f"{k}: {_clean(v)}" for k, v in headers if v is not None), f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _clean(value: str) -> str:
    return re.sub(r"[\x00-\x1f\x7f]", lambda m: f"%{ord(m.group()):02X}", value)


@dataclass
class Record:
    headers: dict[str, str]  # by lower-case name
    block: bytes | None
    offset: int


class _Ahead:
    """A file read in large pieces one after the other; only what begins beyond the piece at hand is sought."""

    def __init__(self, file, piece: int = 1 << 20):
        self.file, self.piece, self.base, self.held, self.at, self.over = file, piece, 0, b"", 0, False

    def seek(self, at: int) -> None:
        self.at = at

    def tell(self) -> int:
        return self.at

    def read(self, n: int) -> bytes:
        end = self.base + len(self.held)
        if not self.base <= self.at <= end or (not self.held and self.at != self.base):
            self.file.seek(self.at)
            self.base, self.held, end, self.over = self.at, b"", self.at, False
        elif end == 0:
            self.file.seek(0)
        if self.at + n > end and not self.over:
            more = self.file.read(max(self.piece, self.at + n - end))
            self.held, self.over = self.held[self.at - self.base :] + more, not more
            self.base = self.at
        got = self.held[self.at - self.base : self.at - self.base + n]
        self.at += len(got)
        return got


class _Members:
    """The gzip members of a byte range of an open file."""

    CHUNK = 1 << 16

    def __init__(self, file, start: int, end: int):
        self.file, self.at, self.end = file, start, end
        if start:
            self._synchronize()

    def _synchronize(self) -> None:
        """Move to the first member at or after the start: a gzip magic that inflates to a WARC version line."""
        held, base = b"", self.at
        while True:
            self.file.seek(base + len(held))
            more = self.file.read(self.CHUNK)
            held += more
            k = held.find(b"\x1f\x8b\x08")
            while k >= 0:
                if base + k >= self.end:
                    self.at = self.end
                    return
                self.file.seek(base + k)
                try:
                    if zlib.decompressobj(31).decompress(self.file.read(1024), 8).startswith(b"WARC/"):
                        self.at = base + k
                        return
                except zlib.error:
                    pass
                k = held.find(b"\x1f\x8b\x08", k + 1)
            if not more or base + len(held) - 2 >= self.end:
                self.at = self.end
                return
            base, held = base + len(held) - 2, held[-2:]

    def read(self, wanted) -> Iterator[Record]:
        """The records that begin in the range; wanted(headers) is 0 to skip one, 1 for its headers, 2 for its block too."""
        while self.at < self.end:
            start = self.at
            self.file.seek(start)
            data = self.file.read(self.CHUNK)
            if not data:
                return
            size = struct.unpack_from("<I", data, 16)[0] if data[3:4] == b"\x04" and data[12:14] == b"SL" and len(data) >= 24 else None
            inflater, plain, fed = zlib.decompressobj(31), b"", data
            while b"\r\n\r\n" not in plain:
                got = inflater.decompress(fed, self.CHUNK)
                plain += got
                fed = inflater.unconsumed_tail
                if not fed and not inflater.eof:
                    fed = self.file.read(self.CHUNK)
                    if not fed:
                        break
                if inflater.eof:
                    break
            head, _, rest = plain.partition(b"\r\n\r\n")
            headers = {}
            for line in head.decode("utf-8", "replace").split("\r\n")[1:]:
                name, _, value = line.partition(":")
                headers[name.strip().lower()] = value.strip()
            want = wanted(headers)
            if want == 2 or size is None:
                parts = [rest]
                while not inflater.eof:
                    if not fed:
                        fed = self.file.read(self.CHUNK)
                        if not fed:
                            break
                    parts.append(inflater.decompress(fed))
                    fed = b""
                rest = b"".join(parts) if want == 2 else b""
            self.at = start + size if size is not None else self.file.tell() - len(inflater.unused_data)
            if want:
                length = int(headers.get("content-length", 0))
                yield Record(headers, rest[:length] if want == 2 else None, start)


# ---- reader


@dataclass
class _Range(InputPartition):
    path: str
    start: int
    end: int


def _digest_hex(value: str | None) -> str | None:
    """sha1:BASE32 as lower-case hex; other digests as they are."""
    if value and (m := re.fullmatch(r"sha1:([A-Z2-7]{32})", value)):
        return base64.b32decode(m[1]).hex()
    return value


def _row(headers: dict[str, str]) -> dict[str, str | None]:
    get = headers.get
    return {"record_type": get("warc-type"), "record_id": get("warc-record-id"), "target_uri": get("warc-target-uri"), "date": get("warc-date"), "payload_digest": _digest_hex(get("warc-payload-digest")), "refers_to": get("warc-refers-to")}


class WarcReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path = options["path"]
        self.split = int(options.get("split_bytes", SPLIT_BYTES))
        self.payload = options.get("payload", "true").lower() != "false"
        self.tests: list[tuple[str, frozenset | None]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            name = f.attribute[0] if hasattr(f, "attribute") and len(f.attribute) == 1 else None
            if name in _PUSHED and isinstance(f, EqualTo):
                self.tests.append((name, frozenset([f.value])))
            elif name in _PUSHED and isinstance(f, In):
                self.tests.append((name, frozenset(f.value)))
            elif name in _PUSHED and isinstance(f, IsNotNull):
                self.tests.append((name, None))
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        from pyarrow import fs

        system, path = _fs(self.path)
        info = system.get_file_info(path)
        files = [info] if info.type == fs.FileType.File else system.get_file_info(fs.FileSelector(path, recursive=False))
        files = sorted((f for f in files if f.type == fs.FileType.File and not f.base_name.startswith(("_", "."))), key=lambda f: f.path)
        return [_Range(f.path, at, min(at + self.split, f.size)) for f in files for at in range(0, f.size, self.split)]

    def _wanted(self, headers: dict[str, str]) -> int:
        row = _row(headers)
        if not all(row[n] is not None and (values is None or row[n] in values) for n, values in self.tests):
            return 0
        # what isn't a response is small and holds the HTTP headers
        return 2 if self.payload or row["record_type"] != "response" else 1

    def read(self, partition: _Range | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # what Spark hands over where nothing was planned
            return
        system, _ = _fs(self.path)
        schema = pa.schema([("record_type", pa.string()), ("record_id", pa.string()), ("target_uri", pa.string()), ("date", pa.string()), ("payload_digest", pa.string()), ("refers_to", pa.string()), ("content_length", pa.int64()), ("payload_length", pa.int64()), ("http_headers", pa.string()), ("payload", pa.binary()), ("file", pa.string()), ("offset", pa.int64())])
        rows, held = [], 0
        with system.open_input_file(partition.path) as file:
            for r in _Members(_Ahead(file), partition.start, partition.end).read(self._wanted):
                http = payload = None
                if r.block is not None and r.headers.get("content-type", "").startswith("application/http"):
                    http, _, payload = r.block.partition(b"\r\n\r\n")
                    http = http.decode("utf-8", "replace")
                elif r.block is not None:
                    payload = r.block
                revisit = r.headers.get("warc-type") == "revisit"
                m = re.search(r"(?im)^content-length:\s*(\d+)", http or "")
                length = int(m[1]) if m else None if payload is None else len(payload)
                rows.append(_row(r.headers) | {"content_length": int(r.headers.get("content-length", 0)), "payload_length": length, "http_headers": http, "payload": None if revisit or not self.payload else payload, "file": partition.path, "offset": r.offset})
                held += len(payload or b"") + 500
                if held >= 8_000_000 or len(rows) >= 5000:
                    yield pa.RecordBatch.from_pylist(rows, schema)
                    rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema)


# ---- writer


@dataclass
class _Written(WriterCommitMessage):
    names: list[str]


class WarcWriter(DataSourceArrowWriter):
    """Rows (record_type, record_id, target_uri, date, payload_digest, refers_to, refers_to_uri, payload) to files."""

    def __init__(self, options: dict[str, str], overwrite: bool):
        self.path, self.overwrite = options["path"], overwrite
        self.level = int(options.get("level", 4))
        self.job = uuid.uuid4().hex

    def write(self, batches: Iterator[pa.RecordBatch]) -> _Written:
        system, path = _fs(self.path)
        held = _join(path, f"_temporary-{self.job}")
        system.create_dir(held, recursive=True)
        names, out, size = [], None, 0
        for batch in batches:
            for r in batch.to_pylist():
                if out is None or size >= FILE_BYTES:
                    if out is not None:
                        out.close()
                    names.append(f"{uuid.uuid4().hex}.warc.gz")
                    out, size = system.open_output_stream(_join(held, names[-1]), compression=None), 0
                data = member(self._record(r), self.level)
                out.write(data)
                size += len(data)
        if out is not None:
            out.close()
        return _Written(names)

    def _record(self, r: dict) -> bytes:
        revisit = r["record_type"] == "revisit"
        http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {r['payload_length']}\r\n\r\n".encode()
        headers = [
            ("WARC-Type", r["record_type"]), ("WARC-Record-ID", r["record_id"]), ("WARC-Target-URI", r["target_uri"]), ("WARC-Date", r["date"]),
            ("WARC-Payload-Digest", "sha1:" + base64.b32encode(bytes.fromhex(r["payload_digest"])).decode()), ("WARC-Refers-To", r["refers_to"]),
            ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest" if revisit else None), ("Content-Type", "application/http; msgtype=response"),
        ]
        return record(headers, http + (b"" if revisit else r["payload"]))

    def commit(self, messages: list[_Written]) -> None:
        from pyarrow import fs

        system, path = _fs(self.path)
        system.create_dir(path, recursive=True)
        if self.overwrite:
            for f in system.get_file_info(fs.FileSelector(path)):
                if f.type == fs.FileType.File:
                    system.delete_file(f.path)
        held = _join(path, f"_temporary-{self.job}")
        for message in messages:
            for name in message.names if message is not None else ():
                system.move(_join(held, name), _join(path, name))
        self._drop()

    def abort(self, messages: list[_Written]) -> None:
        self._drop()

    def _drop(self) -> None:
        system, path = _fs(self.path)
        try:
            system.delete_dir(_join(path, f"_temporary-{self.job}"))
        except FileNotFoundError:
            pass


class WarcSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> WarcReader:
        return WarcReader(dict(self.options))

    def writer(self, schema: StructType, overwrite: bool) -> WarcWriter:
        return WarcWriter(dict(self.options), overwrite)


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)


# ---- pages


def records(pages: DataFrame, shared_from: int = SHARED_FROM) -> DataFrame:
    """One record per row of pages (page_id, url, html): a response, or a revisit of the response with the same payload.

    A null html is empty, a null page_id gives a record without refers-to that nothing refers to, rows repeated with their
    page_id are alike, a null url gives no target.  Digests that several pages share are found by an aggregate and joined
    back, where Spark splits the pages of a hot one.
    """
    page = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"))
    page = page.select("page_id", "url", F.encode("html", "utf-8").alias("payload")).withColumns({"payload_digest": F.sha1("payload"), "payload_length": F.octet_length("payload").cast("long")})
    holder = page.where(F.col("payload_length") >= shared_from).groupBy("payload_digest").agg(F.max("page_id").alias("holder"), F.count("*").alias("k")).where("k > 1").drop("k")
    named = page.join(holder, "payload_digest", "left").withColumn("revisit", F.coalesce((F.col("payload_length") >= shared_from) & (F.col("page_id") < F.col("holder")), F.lit(False)))
    urn = lambda c: F.concat(F.lit("<urn:page:"), F.col(c).cast("string"), F.lit(">"))
    return named.select(
        F.when(F.col("revisit"), "revisit").otherwise("response").alias("record_type"), urn("page_id").alias("record_id"), F.col("url").alias("target_uri"), F.lit("2024-01-01T00:00:00Z").alias("date"),
        "payload_digest", F.when(F.col("revisit"), urn("holder")).alias("refers_to"), "payload_length", F.when(~F.col("revisit"), F.col("payload")).alias("payload"),
    )


def write(pages: DataFrame, path: str | None = None) -> str:
    """Write the pages' records; gives the path."""
    spark = pages.sparkSession
    register(spark)
    path = path or shared_path(spark, "warc")
    records(pages).write.format("warc").mode("append").save(path)
    return path


def read(spark: SparkSession, path: str, **options: str) -> DataFrame:
    register(spark)
    return spark.read.format("warc").options(**options).load(path)


def digests(spark: SparkSession, path: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type and refers_to, from the archives; a payload that doesn't have its digest fails."""
    page = lambda c: F.regexp_extract(c, r"^<urn:page:(-?\d+)>$", 1)
    sound = F.col("payload").isNull() | (F.sha1("payload") == F.col("payload_digest"))
    number = lambda c: F.when(page(c) != "", page(c)).cast("long")
    return read(spark, path).select(
        number("record_id").alias("page_id"), F.coalesce(F.octet_length("payload").cast("long"), "payload_length").alias("payload_bytes"),
        F.when(sound, F.col("payload_digest")).otherwise(F.raise_error(F.concat(F.lit("damaged payload of "), "record_id"))).alias("payload_digest"), "record_type", number("refers_to").alias("refers_to"),
    )
