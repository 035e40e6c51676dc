"""WARC as a Python data source: `spark.read.format("warc")` and `df.write.format("warc")`.

Writing puts each partition into one file of gzip members, a member per record, which carries
its compressed length in the gzip "sl" extra field.  A task writes under a name of its own;
the commit on the driver moves the files of successful tasks to their final names.

Reading plans byte ranges: small files are read together, large ones are split; a range begins
at the first member found in it.  Predicates on record type, ids, target, dates and lengths
are pushed down.  A record's headers are inflated first; unwanted records are left by their
"sl" length without inflating (or reading) the rest.  Option `payload` = false skips
all payloads.  Plain .warc files and members without "sl" are read too, unsplit.

Paths are opened with pyarrow's filesystems, so they may lie in any store that these reach.

Defined results: null texts are empty payloads; a null id is written and read as null; a null
target has no header; line ends inside header values are percent-encoded; rows that repeat an
id are records each; of an empty table nothing is written and reading an empty folder gives no
rows; damaged members raise.  Extra columns of the written rows are ignored.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    EqualNullSafe,
    EqualTo,
    GreaterThan,
    GreaterThanOrEqual,
    In,
    InputPartition,
    IsNotNull,
    IsNull,
    LessThan,
    LessThanOrEqual,
    StringContains,
    StringEndsWith,
    StringStartsWith,
    WriterCommitMessage,
)

from tideledger.llm.shared import bare, small_batches

SCHEMA = (
    "record_id string, record_type string, target_uri string, date string, content_type string, content_length long, "
    "payload_digest string, refers_to string, http_length long, payload binary"
)
_COLUMNS = [c.split()[0] for c in SCHEMA.split(", ")]
_HEADERS = {
    "record_id": "warc-record-id", "record_type": "warc-type", "target_uri": "warc-target-uri", "date": "warc-date", "content_type": "content-type",
    "content_length": "content-length", "payload_digest": "warc-payload-digest", "refers_to": "warc-refers-to",
}
_ARROW = pa.schema([(c, {"long": pa.int64(), "binary": pa.binary()}.get(t, pa.string())) for c, t in (x.split() for x in SCHEMA.split(", "))])
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_GZIP = b"\x1f\x8b\x08\x04"
_EXTRA = struct.Struct("<H2sHII")  # length of the field, "sl", 8, compressed, uncompressed
_MEMBER = 10 + _EXTRA.size
_HEAD_BYTES = 4096
BATCH_BYTES = 4 << 20


def open_store(path: str) -> tuple[fs.FileSystem, str]:
    if path.startswith("file:") and not path.startswith("file://"):
        path = "file://" + path[5:]
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


# --- writing -----------------------------------------------------------------------------


def member(record: bytes, level: int = 6) -> bytes:
    """One gzip member with its own length in the extra field."""
    packer = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = packer.compress(record) + packer.flush()
    size = _MEMBER + len(body) + 8
    head = _GZIP + b"\0\0\0\0\0\xff" + _EXTRA.pack(12, b"sl", 8, size, len(record) & 0xFFFFFFFF)
    return head + body + struct.pack("<II", zlib.crc32(record), len(record) & 0xFFFFFFFF)


def _safe(value: str) -> str:
    return value.replace("\r", "%0D").replace("\n", "%0A")


def record(page, url: str | None, payload: bytes, digest: str, refers_to, date: str) -> bytes:
    """A response with its payload, or a revisit (refers_to given) with HTTP headers alone."""
    revisit = refers_to is not None
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:page:{'null' if page is None else page}>", f"WARC-Date: {date}"]
    if url is not None:
        lines.append(f"WARC-Target-URI: {_safe(url)}")
    lines.append(f"WARC-Payload-Digest: sha256:{digest}")
    if revisit:
        lines += [f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Profile: {_PROFILE}"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


@dataclass
class Written(WriterCommitMessage):
    name: str
    records: int


class Writer(DataSourceArrowWriter):
    def __init__(self, options: dict, overwrite: bool):
        self.path, self.job = options["path"].rstrip("/"), uuid.uuid4().hex
        self.date = options.get("date", "1970-01-01T00:00:00Z")
        self.level = int(options.get("level", 6))

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        store, folder = open_store(self.path)
        name, out, n = f"_part-{self.job}-{uuid.uuid4().hex}", None, 0
        for batch in iterator:
            names = ("page_id", "url", "html", "digest", "refers_to")
            for page, url, html, digest, refers in zip(*[batch.column(c).to_pylist() for c in names], strict=True):
                if out is None:
                    store.create_dir(folder, recursive=True)
                    out = store.open_output_stream(f"{folder}/{name}")
                out.write(member(record(page, url, (html or "").encode(), digest, refers, self.date), self.level))
                n += 1
        if out is not None:
            out.close()
        return Written(name if n else "", n)

    def commit(self, messages: list[Written | None]) -> None:
        store, folder = open_store(self.path)
        for k, message in enumerate(m for m in messages if m is not None and m.name):
            store.move(f"{folder}/{message.name}", f"{folder}/part-{k:06d}-{self.job[:8]}.warc.gz")

    def abort(self, messages: list[Written | None]) -> None:
        store, folder = open_store(self.path)
        for message in messages:
            if message is not None and message.name:
                store.delete_file(f"{folder}/{message.name}")


# --- reading -----------------------------------------------------------------------------


@dataclass
class Ranges(InputPartition):
    """Byte ranges (path, start, end, size of the file) that one task reads."""

    parts: list[tuple[str, int, int, int]]

    def __init__(self, parts):
        super().__init__(None)
        self.parts = parts


class _Window:
    """Buffered reads of a file at any place."""

    def __init__(self, file, size: int, step: int = 1 << 20):
        self.file, self.size, self.step = file, size, step
        self.at, self.data = 0, b""

    def get(self, at: int, n: int) -> bytes:
        n = min(n, self.size - at)
        if at < self.at or at + n > self.at + len(self.data):
            self.file.seek(at)
            self.at, self.data = at, self.file.read(min(max(n, self.step), self.size - at))
        return self.data[at - self.at : at - self.at + n]


def _headers(raw: bytes) -> dict[str, str]:
    lines = raw.decode("utf-8", "replace").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("no WARC record where one was expected")
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:]) if k}


def _row(headers: dict[str, str]) -> dict:
    row = {c: headers.get(h) for c, h in _HEADERS.items()}
    row["content_length"] = int(headers.get("content-length", 0))
    return row


def skip_length(window: _Window, at: int) -> int:
    """Length of the member at a place from its "sl" field; 0 where it has none."""
    head = window.get(at, _MEMBER)
    if len(head) == _MEMBER and head[:4] == _GZIP:
        _, name, size, length, _ = _EXTRA.unpack_from(head, 10)
        if name == b"sl" and size == 8:
            return length
    return 0


def _is_record(window: _Window, at: int) -> bool:
    try:
        return zlib.decompressobj(-15).decompress(window.get(at + _MEMBER, 512), 64).startswith(b"WARC/")
    except zlib.error:
        return False


def first_member(window: _Window, start: int, end: int) -> int:
    """Place of the first member that begins in start..end, or end."""
    at = start
    while at < end:
        chunk = window.get(at, min(window.step, end - at + _MEMBER))
        found = chunk.find(_GZIP)
        if found < 0:
            at += max(1, len(chunk) - 3)
        else:
            at += found
            if at < end and skip_length(window, at) and _is_record(window, at):
                return at
            at += 1
    return end


def _sized(path: str, start: int, end: int, window: _Window, wanted) -> Iterator[tuple[dict, bytes | None]]:
    """Records of members with "sl" that begin in the range."""
    at = start if start == 0 else first_member(window, start, end)
    while at < end:
        length = skip_length(window, at)
        if not length:
            raise ValueError(f"{path}: a gzip member without its length at byte {at}")
        inflate = zlib.decompressobj(-15)
        got = inflate.decompress(window.get(at + _MEMBER, min(length - _MEMBER, _HEAD_BYTES)), _HEAD_BYTES)
        whole = None
        cut = got.find(b"\r\n\r\n")
        if cut < 0 or got.find(b"\r\n\r\n", cut + 4) < 0:  # long headers
            whole = zlib.decompress(window.get(at + _MEMBER, length - _MEMBER - 8), -15)
            got, cut = whole, whole.find(b"\r\n\r\n")
        row = _row(_headers(got[:cut]))
        need = wanted(row)
        if need:
            body = got[cut + 4 :]
            if need == "payload":
                raw = window.get(at, length)
                if whole is None:
                    whole = zlib.decompress(raw[_MEMBER:-8], -15)
                if zlib.crc32(whole) != struct.unpack_from("<I", raw, length - 8)[0]:
                    raise ValueError(f"{path}: damaged member at byte {at}")
                body = whole[cut + 4 :]
            yield _with_body(row, body, need)
        at += length


def _with_body(row: dict, body: bytes, need: str) -> tuple[dict, bytes | None]:
    block = body[: row["content_length"]]
    http, payload = None, block if need == "payload" else None
    if (row["content_type"] or "").startswith("application/http"):
        head, _, rest = block.partition(b"\r\n\r\n")
        for line in head.split(b"\r\n")[1:]:
            if line.lower().startswith(b"content-length:"):
                http = int(line.split(b":", 1)[1])
        payload = rest if need == "payload" else None
    return row | {"http_length": http}, payload


def _plain(path: str, file, wanted, packed: bool) -> Iterator[tuple[dict, bytes | None]]:
    """Records of a plain file, or of one whose members have no lengths, from start to end."""
    stream = pa.CompressedInputStream(file, "gzip") if packed else file
    held = b""
    while True:
        while (cut := held.find(b"\r\n\r\n")) < 0:
            more = stream.read(1 << 16)
            if not more:
                if held.strip():
                    raise ValueError(f"{path}: a record ends inside its headers")
                return
            held = (held + more).lstrip(b"\r\n")
        row = _row(_headers(held[:cut]))
        need, size = wanted(row), row["content_length"]
        held = held[cut + 4 :]
        keep = size if need == "payload" else min(size, _HEAD_BYTES)
        body = held[:keep]
        left = size - len(held)
        held = held[size:]
        parts = [body]
        while left > 0:
            more = stream.read(min(left, 1 << 16))
            if not more:
                raise ValueError(f"{path}: a record ends inside its block")
            if sum(map(len, parts)) < keep:
                parts.append(more)
            left -= len(more)
        held = held.lstrip(b"\r\n")
        if need:
            yield _with_body(row, b"".join(parts), need)


_TESTS = {
    EqualTo: lambda v, f: v == f.value, EqualNullSafe: lambda v, f: v == f.value, GreaterThan: lambda v, f: v > f.value,
    GreaterThanOrEqual: lambda v, f: v >= f.value, LessThan: lambda v, f: v < f.value, LessThanOrEqual: lambda v, f: v <= f.value,
    In: lambda v, f: v in f.value, StringStartsWith: lambda v, f: v.startswith(f.value), StringEndsWith: lambda v, f: v.endswith(f.value),
    StringContains: lambda v, f: f.value in v, IsNotNull: lambda v, f: True,
}


class Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"].rstrip("/")
        self.split = int(options.get("split_bytes", 64 << 20))
        self.payload = str(options.get("payload", "true")).lower() != "false"
        self.filters: list = []

    def pushFilters(self, filters):
        for f in filters:
            if len(f.attribute) == 1 and f.attribute[0] in _HEADERS and (type(f) in _TESTS or isinstance(f, IsNull)):
                self.filters.append(f)
            else:
                yield f

    def _wanted(self, row: dict) -> str:
        for f in self.filters:
            value = row[f.attribute[0]]
            if isinstance(f, IsNull):
                ok = value is None
            elif value is None:
                ok = isinstance(f, EqualNullSafe) and f.value is None
            else:
                ok = _TESTS[type(f)](value, f)
            if not ok:
                return ""
        return "payload" if self.payload else "headers"

    def partitions(self) -> list[Ranges]:
        store, folder = open_store(self.path)
        info = store.get_file_info(fs.FileSelector(folder, recursive=True, allow_not_found=True)) or [store.get_file_info(folder)]
        files = sorted((x.path, x.size) for x in info if x.is_file and x.path.endswith((".warc", ".warc.gz")) and not x.base_name.startswith("_"))
        out: list[list] = []
        held, room = [], self.split
        for path, size in files:
            if size > self.split and self._splits(store, path, size):
                out += [[(path, a, min(a + self.split, size), size)] for a in range(0, size, self.split)]
                continue
            if held and size > room:
                out.append(held)
                held, room = [], self.split
            held.append((path, 0, size, size))
            room -= size
        if held:
            out.append(held)
        return [Ranges(x) for x in out] or [Ranges([])]

    @staticmethod
    def _splits(store, path: str, size: int) -> bool:
        with store.open_input_file(path) as file:
            return skip_length(_Window(file, size), 0) > 0

    def read(self, partition: Ranges) -> Iterator[pa.RecordBatch]:
        store, _ = open_store(self.path)
        rows: list[dict] = []
        held = 0
        for path, start, end, size in partition.parts:
            with store.open_input_file(path) as file:
                window = _Window(file, size)
                if size and skip_length(window, start if start == 0 else first_member(window, start, end)) or start:
                    found = _sized(path, start, end, window, self._wanted)
                else:
                    file.seek(0)
                    found = _plain(path, file, self._wanted, path.endswith(".gz"))
                for row, payload in found:
                    rows.append(row | {"payload": payload})
                    held += len(payload or b"") + 200
                    if held > BATCH_BYTES:
                        yield pa.RecordBatch.from_pylist(rows, _ARROW)
                        rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, _ARROW)


class WarcSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> Reader:
        return Reader(dict(self.options))

    def writer(self, schema, overwrite: bool) -> Writer:
        return Writer(dict(self.options), overwrite)


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    small_batches(spark)
    spark.dataSource.register(WarcSource)


# --- pages -------------------------------------------------------------------------------


def with_revisits(pages: DataFrame, least_bytes: int = 100) -> DataFrame:
    """Pages with the digest of their payload and, where an equal payload of `least_bytes` or
    more has a smaller page_id, the least such id in `refers_to`."""
    rows = bare(pages, "page_id", "url", "html").withColumn("page_id", F.col("page_id").cast("long"))
    payload = F.coalesce("html", F.lit("")).cast("binary")
    rows = rows.withColumns({"digest": F.sha2(payload, 256), "_size": F.octet_length(payload)})
    first = rows.where(F.col("_size") >= least_bytes).groupBy("digest").agg(F.min("page_id").alias("first"), F.max("page_id").alias("last"))
    again = rows.where(F.col("_size") >= least_bytes).select("page_id", "digest").join(first.where("first < last"), "digest")
    again = again.where("page_id > first").select("page_id", "digest", F.col("first").alias("refers_to")).distinct()
    return rows.join(again, ["page_id", "digest"], "left").select("page_id", "url", "html", "digest", "refers_to")


def write(pages: DataFrame, path: str) -> None:
    """One record per page, equal payloads as revisits."""
    register(pages.sparkSession)
    with_revisits(pages).write.format("warc").mode("append").save(path)


def read(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    register(spark)
    return spark.read.format("warc").option("payload", str(payload).lower()).load(path)


def page_of(column: str):
    """The page id in a record id; null where it is none."""
    return F.regexp_extract(F.col(column), "<urn:page:(-?[0-9]+)>", 1).try_cast("long")
