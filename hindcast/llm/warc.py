"""WARC archives as a PySpark data source.

``spark.read.format("warc").load(path)`` plans partitions of whole files,
filled up to ``partition_bytes``. A record's headers are read first; a record
that fails the pushed predicates on its type or headers is passed over by its
length, and its payload is never read or decoded. With option
``payload=false`` no payload is read at all. ``df.write.format("warc")``
writes responses and revisits (a revisit keeps the HTTP headers of its
response but not the payload). A write's files count once its manifest is
there; a folder without manifests is read as it is.

Both plain and per-record gzip archives are read; in a plain file passing over
a record is a seek.
"""

from __future__ import annotations

import gzip
import io
import json
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    EqualNullSafe,
    EqualTo,
    In,
    InputPartition,
    IsNotNull,
    IsNull,
    StringContains,
    StringEndsWith,
    StringStartsWith,
    WriterCommitMessage,
)

from hindcast.llm.common import materialize, open_store

SCHEMA = (
    "record_type string, record_id string, target_uri string, date string, refers_to string, "
    "payload_digest string, content_type string, http_length long, payload binary, file string, offset long"
)
#: columns that are WARC headers (fixed names of the format)
HEADERS = {
    "record_type": "warc-type",
    "record_id": "warc-record-id",
    "target_uri": "warc-target-uri",
    "date": "warc-date",
    "refers_to": "warc-refers-to",
    "payload_digest": "warc-payload-digest",
    "content_type": "content-type",
}
SAME_PAYLOAD = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
NO_DATE = "1970-01-01T00:00:00Z"
_LINE_BREAKS = re.compile(r"[\x00-\x1f\x7f]")


def header_value(text: str) -> str:
    """Control characters, which would end a header, percent-encoded."""
    return _LINE_BREAKS.sub(lambda m: f"%{ord(m[0]):02X}", text)


def response_record(record_type: str, record_id: str, uri: str | None, date: str | None, refers_to: str | None, digest: str | None, payload: bytes, length: int) -> bytes:
    """One record. A revisit's block ends after the HTTP headers, which name
    the full payload's ``length``."""
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % length
    if record_type != "revisit":
        block += payload
    head = ["WARC/1.1", f"WARC-Type: {record_type}", f"WARC-Record-ID: <{header_value(record_id)}>", f"WARC-Date: {header_value(date or NO_DATE)}"]
    if uri is not None:
        head.append(f"WARC-Target-URI: {header_value(uri)}")
    if record_type == "revisit":
        head.append(f"WARC-Profile: {SAME_PAYLOAD}")
        if refers_to is not None:
            head.append(f"WARC-Refers-To: <{header_value(refers_to)}>")
    if digest is not None:
        head.append(f"WARC-Payload-Digest: sha256:{header_value(digest)}")
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(head).encode("utf-8", "replace") + block + b"\r\n\r\n"


class _Records:
    """Walks the records of one open archive file."""

    def __init__(self, stream, zipped: bool):
        self.raw = stream
        self.stream = io.BufferedReader(gzip.GzipFile(fileobj=stream), 1 << 18) if zipped else stream
        self.seekable = not zipped

    def line(self) -> bytes:
        return self.stream.readline()

    def pass_over(self, count: int) -> None:
        if self.seekable:
            self.stream.seek(count, 1)
            return
        while count > 0:
            got = len(self.stream.read(min(count, 1 << 20)))
            if not got:
                return
            count -= got

    def headers(self) -> dict[str, str] | None:
        """Headers of the next record by lower-case name; None at the end."""
        while (start := self.line()) in (b"\r\n", b"\n"):
            pass
        if not start:
            return None
        if not start.startswith(b"WARC/"):
            raise ValueError(f"not a WARC record: {start[:40]!r}")
        out: dict[str, str] = {}
        last = ""
        while (text := self.line().rstrip(b"\r\n")) != b"":
            if text[:1] in b" \t" and last:
                out[last] += " " + text.strip().decode("utf-8", "replace")
                continue
            name, _, value = text.partition(b":")
            last = name.strip().decode("latin-1").lower()
            out[last] = value.strip().decode("utf-8", "replace")
        return out

    def http_headers(self, size: int) -> bytes:
        """The front of a block of ``size`` bytes, read on in steps until it
        holds the blank line after the HTTP headers or the block ends."""
        front = bytearray()
        while len(front) < size:
            more = self.stream.read(min(size - len(front), max(8192, len(front))))
            since = max(0, len(front) - 3)
            front += more
            if not more or front.find(b"\r\n\r\n", since) >= 0:
                break
        return bytes(front)


def _split_http(block: bytes) -> tuple[int | None, bytes]:
    """Content-Length of the HTTP headers and what follows them."""
    head, found, body = block.partition(b"\r\n\r\n")
    if not found:
        return None, block
    length = None
    for line in head.split(b"\r\n")[1:]:
        name, _, value = line.partition(b":")
        if name.strip().lower() == b"content-length" and value.strip().isdigit():
            length = int(value)
    return length, body


def _columns(head: dict[str, str]) -> dict[str, str | None]:
    out = {c: head.get(h) for c, h in HEADERS.items()}
    for c in ("record_id", "refers_to"):
        if out[c] is not None:
            out[c] = out[c].removeprefix("<").removesuffix(">")
    return out


@dataclass
class Files(InputPartition):
    names: list[str]


@dataclass
class Written(WriterCommitMessage):
    names: list[str]


class WarcReader(DataSourceReader):
    def __init__(self, schema: T.StructType, options: dict):
        self.path = options["path"]
        self.fields = schema.names
        self.payload = options.get("payload", "true").lower() != "false"
        self.partition_bytes = int(options.get("partition_bytes", 128 << 20))
        self.tests: list[tuple[str, str, object]] = []

    def pushFilters(self, filters):
        """Predicates on the header columns are taken over; others stay with Spark."""
        names = {EqualTo: "eq", EqualNullSafe: "eq", In: "in", IsNull: "null", IsNotNull: "some", StringStartsWith: "starts", StringEndsWith: "ends", StringContains: "has"}
        for f in filters:
            column = getattr(f, "attribute", ())
            kind = names.get(type(f))
            if kind is None or len(column) != 1 or column[0] not in HEADERS:
                yield f
                continue
            value = getattr(f, "value", None)
            if type(f) is EqualTo and value is None:
                yield f
                continue
            self.tests.append((column[0], kind, value))

    def wanted(self, row: dict[str, str | None]) -> bool:
        for column, kind, value in self.tests:
            got = row[column]
            if kind == "null":
                ok = got is None
            elif kind == "some":
                ok = got is not None
            elif kind == "eq":
                ok = got == value
            elif kind == "in":
                ok = got is not None and got in value
            else:
                ok = got is not None and {"starts": str.startswith, "ends": str.endswith, "has": str.__contains__}[kind](got, value)
            if not ok:
                return False
        return True

    def partitions(self) -> list[Files]:
        store, base = open_store(self.path)
        infos = store.get_file_info(pafs.FileSelector(base, recursive=True, allow_not_found=True))
        lists = [i.path for i in infos if i.base_name.startswith("_manifest-")]
        sizes = {i.path: i.size for i in infos if re.search(r"\.warc(\.gz)?$", i.base_name)}
        if lists:
            named: list[str] = []
            for x in lists:
                with store.open_input_stream(x) as f:
                    named += json.loads(f.read())
            sizes = {f"{base}/{n}": sizes[f"{base}/{n}"] for n in named}
        out: list[Files] = []
        held = 0
        for name, size in sorted(sizes.items()):
            if not out or held + size > self.partition_bytes:
                out.append(Files([]))
                held = 0
            out[-1].names.append(name)
            held += size
        return out or [Files([])]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([(n, t) for n, t in _ARROW if n in self.fields])
        store, _ = open_store(self.path)
        rows: list[dict] = []
        held = 0
        for name in partition.names:
            zipped = name.endswith(".gz")
            with store.open_input_file(name) as file:
                walk = _Records(file if zipped else _Buffered(file), zipped)
                while True:
                    at = walk.stream.tell()
                    head = walk.headers()
                    if head is None:
                        break
                    size = int(head.get("content-length", 0))
                    row = _columns(head)
                    if not self.wanted(row):
                        walk.pass_over(size)
                        continue
                    http = "application/http" in (row["content_type"] or "")
                    body = None
                    if self.payload and row["record_type"] != "revisit":
                        body = walk.stream.read(size)
                        if len(body) < size:
                            raise ValueError(f"{name}: record at {at} is cut off")
                        length, body = _split_http(body) if http else (None, body)
                    else:
                        # the payload behind the HTTP headers is passed over
                        front = walk.http_headers(size) if http else b""
                        length = _split_http(front)[0] if http else None
                        walk.pass_over(size - len(front))
                    row |= {"http_length": length, "payload": body, "file": name.rpartition("/")[2], "offset": at}
                    rows.append(row)
                    held += 500 + len(body or b"")
                    if held > 8 << 20:
                        yield pa.RecordBatch.from_pylist(rows, schema)
                        rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema)


class _Buffered:
    """Buffered reading of a random-access file whose seeks within the buffer
    cost nothing."""

    def __init__(self, file, size: int = 1 << 18):
        self.file, self.size = file, size
        self.data, self.base, self.at = b"", 0, 0

    def tell(self) -> int:
        return self.base + self.at

    def seek(self, count: int, whence: int) -> None:
        self.at += count
        if self.at > len(self.data):
            self.base, self.data, self.at = self.base + self.at, b"", 0
            self.file.seek(self.base)

    def _fill(self, least: int) -> None:
        left = self.data[self.at :]
        self.base, self.at = self.base + self.at, 0
        self.file.seek(self.base + len(left))
        self.data = left + self.file.read(max(self.size, least - len(left)))

    def read(self, count: int) -> bytes:
        if len(self.data) - self.at < count:
            self._fill(count)
        out = self.data[self.at : self.at + count]
        self.at += len(out)
        return out

    def readline(self) -> bytes:
        end = self.data.find(b"\n", self.at)
        while end < 0:
            before = len(self.data) - self.at
            self._fill(before + self.size)
            end = self.data.find(b"\n", before)
            if end < 0 and len(self.data) == before:
                end = len(self.data) - 1
                break
        out = self.data[self.at : end + 1]
        self.at = end + 1
        return out


_ARROW = [
    *((c, pa.string()) for c in HEADERS),
    ("http_length", pa.int64()),
    ("payload", pa.binary()),
    ("file", pa.string()),
    ("offset", pa.int64()),
]


class WarcWriter(DataSourceArrowWriter):
    """Writes rows of ``record_type, record_id, target_uri, date, refers_to,
    payload_digest, http_length, payload``."""

    def __init__(self, options: dict):
        self.path = options["path"]
        self.zipped = options.get("compression", "none").lower() == "gzip"
        self.file_bytes = int(options.get("file_bytes", 1 << 30))

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        store, base = open_store(self.path)
        names: list[str] = []
        out, size = None, 0
        for batch in iterator:
            for row in batch.to_pylist():
                if out is None or size >= self.file_bytes:
                    if out is not None:
                        out.close()
                    store.create_dir(base, recursive=True)
                    names.append(f"part-{uuid.uuid4().hex}.warc" + ".gz" * self.zipped)
                    out, size = store.open_output_stream(f"{base}/{names[-1]}", buffer_size=1 << 20, compression=None), 0
                payload = row["payload"] or b""
                record = response_record(
                    row["record_type"], row["record_id"], row["target_uri"], row["date"], row["refers_to"], row["payload_digest"], payload, row["http_length"]
                )
                if self.zipped:
                    record = gzip.compress(record, 6)
                out.write(record)
                size += len(record)
        if out is not None:
            out.close()
        return Written(names)

    def commit(self, messages) -> None:
        store, base = open_store(self.path)
        store.create_dir(base, recursive=True)
        with store.open_output_stream(f"{base}/_manifest-{uuid.uuid4().hex}.json") as f:
            f.write(json.dumps([n for m in messages if m is not None for n in m.names]).encode())

    def abort(self, messages) -> None:
        store, base = open_store(self.path)
        for m in messages:
            for n in m.names if m is not None else ():
                store.delete_file(f"{base}/{n}")


class WarcDataSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: T.StructType) -> WarcReader:
        return WarcReader(schema, dict(self.options))

    def writer(self, schema: T.StructType, overwrite: bool) -> WarcWriter:
        return WarcWriter(dict(self.options))


def register(spark: SparkSession) -> None:
    """Make the format known to a session and let it take predicates."""
    spark.dataSource.register(WarcDataSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def read_warc(spark: SparkSession, path: str, **options: str) -> DataFrame:
    register(spark)
    return spark.read.format("warc").options(**options).load(path)


#: payloads below this many bytes are always stored
LEAST_REVISIT = 100


def record_name(id_col: Column) -> Column:
    return F.concat(F.lit("urn:page:"), F.coalesce(id_col.cast("string"), F.lit("null")))


def to_records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", date_col: str | None = None, least: int = LEAST_REVISIT) -> DataFrame:
    """One record per row. Of rows with equal payloads of at least ``least``
    bytes those with the smallest id are responses, the others revisits that
    refer to it; rows that share the smallest id are all responses, and so are
    rows of a payload whose ids are all null. A null payload is an empty one;
    a null URL gives no target header. Other columns are ignored."""
    body = F.coalesce(F.encode(F.col(html_col), "UTF-8"), F.lit(b""))
    date = F.date_format(F.col(date_col), "yyyy-MM-dd'T'HH:mm:ss'Z'") if date_col else F.lit(None).cast("string")
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).alias("target_uri"), date.alias("date"), body.alias("payload"))
    rows = rows.withColumn("payload_digest", F.sha2("payload", 256)).withColumn("http_length", F.octet_length("payload").cast("long"))
    large = rows.filter(F.col("http_length") >= least)
    first = large.groupBy("payload_digest").agg(F.min("id").alias("first"), F.count("*").alias("n"))
    # only payloads that occur more than once: where they are few, the pages themselves are not shuffled
    first = materialize(first.filter("n > 1 AND first IS NOT NULL").select(F.col("payload_digest").alias("d"), "first"), "repeated-payloads")
    small = first.count() <= 100_000
    joined = rows.join(F.broadcast(first) if small else first, (F.col("payload_digest") == F.col("d")) & (F.col("http_length") >= least), "left")
    again = F.col("first").isNotNull() & ~F.col("id").eqNullSafe(F.col("first"))
    return joined.select(
        F.when(again, "revisit").otherwise("response").alias("record_type"),
        record_name(F.col("id")).alias("record_id"),
        "target_uri",
        "date",
        F.when(again, record_name(F.col("first"))).alias("refers_to"),
        "payload_digest",
        "http_length",
        F.when(~again, F.col("payload")).alias("payload"),
    )


def write_warc(records: DataFrame, path: str, **options: str) -> None:
    register(records.sparkSession)
    records.write.format("warc").mode("append").options(**options).save(path)


def archived_pages(spark: SparkSession, path: str) -> DataFrame:
    """Per record of the archives: ``page_id, payload_bytes, payload_digest,
    record_type, refers_to``. A response's length and digest are those of the
    payload as read; a revisit's come from its headers."""
    number = lambda c: F.regexp_extract(c, r"^urn:page:(-?\d+)$", 1)
    as_id = lambda c: F.when(number(c) != "", number(c).cast("long"))
    again = F.col("record_type") == "revisit"
    stored = read_warc(spark, path)
    return stored.select(
        as_id(F.col("record_id")).alias("page_id"),
        F.when(again, F.col("http_length")).otherwise(F.octet_length("payload")).cast("long").alias("payload_bytes"),
        F.when(again, F.regexp_replace("payload_digest", "^sha256:", "")).otherwise(F.sha2("payload", 256)).alias("payload_digest"),
        "record_type",
        F.when(again, as_id(F.col("refers_to"))).alias("refers_to"),
    )
