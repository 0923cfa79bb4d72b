"""WARC archives: a writer, and a Python data source that reads them.

Writing. Records of equal payloads are stored once: the row with the smallest page_id becomes a
`response`, the others `revisit` records that refer to it. A record is text (the payload is UTF-8), so
Spark's own text writer lays it down with the record separator as line separator; that writer commits
tasks atomically and reaches any store Spark reaches, and a lost executor costs a rerun task.

Reading. The data source `warc` plans partitions of files, several small ones together. A reader takes
the header of a record first, tests the pushed predicates (record type, header fields) on it, and skips
the payload of a record that isn't wanted: by seeking in a plain file, by discarding in a gzip one.
Options: path (a folder or file), payload = bytes | digest | none, partition_bytes. Columns filtered
with =, IN or IS NOT NULL are pushed down where `spark.sql.python.filterPushdown.enabled` is true.

Nulls: html null is an empty payload; url null leaves out WARC-Target-URI; control characters and
blanks in a URL are percent-encoded; a null page_id sorts last. Rows with equal page_id and payload
are repeated records: one is the response, the rest revisit it. Only page_id, url and html are read. A
table without rows gives archives without records.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import posixpath
from collections.abc import Iterator
from typing import Any
from urllib.parse import unquote, urlsplit

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .common import BATCH_ROWS, materialize

END = "\r\n"
SCHEMA = (
    "record_id string, record_type string, target_uri string, refers_to string, payload_digest string, "
    "payload_bytes bigint, content_length bigint, payload binary, file string, position bigint"
)
ARROW = pa.schema(
    [
        *((c, pa.string()) for c in ("record_id", "record_type", "target_uri", "refers_to", "payload_digest")),
        ("payload_bytes", pa.int64()), ("content_length", pa.int64()), ("payload", pa.binary()), ("file", pa.string()), ("position", pa.int64()),
    ]
)
BATCH_BYTES = 8 << 20
#: column -> WARC field that alone gives it, for predicates on headers
FIELDS = {
    "record_id": "warc-record-id", "record_type": "warc-type", "target_uri": "warc-target-uri",
    "refers_to": "warc-refers-to", "payload_digest": "warc-payload-digest",
}


# --- writing


def base32_sha1(payload: Column) -> Column:
    """Upper-case base32 of a binary column's SHA-1: four parts of 40 bits, 8 digits each."""
    sha1 = F.sha1(payload)
    digits = [F.lpad(F.conv(F.substring(sha1, 10 * k + 1, 10), 16, 32), 8, "0") for k in range(4)]
    return F.translate(F.concat(*digits), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def deduplicate(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """page_id, url, html, payload_bytes, payload_digest, record_type, refers_to: one row a page.

    Groups of more than one page are found on digests alone, written once and joined back; the join's
    sides are plain exchanges, so AQE splits a digest that very many pages share. Only if a group's
    first page_id comes more than once are the rows written and numbered, to tell them apart.
    """
    spark = pages.sparkSession
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    rows = pages.select(
        F.col("page_id").cast("bigint").alias("page_id"),
        F.col("url").cast("string").alias("url"),
        html.alias("html"),
        F.octet_length(html).cast("bigint").alias("payload_bytes"),
        base32_sha1(F.encode(html, "UTF-8")).alias("payload_digest"),
        F.lit(0).cast("bigint").alias("_row"),
    )

    def groups_of(rows: DataFrame) -> DataFrame:
        counted = (
            rows.where(F.col("payload_bytes") >= least_bytes)
            .groupBy("payload_digest", "page_id", "_row")
            .agg(F.count("*").alias("n"))
        )
        first = F.min(F.struct(F.col("page_id").isNull().alias("none"), "page_id", "_row", "n")).alias("first")
        found = counted.groupBy("payload_digest").agg(F.sum("n").alias("copies"), first).where("copies > 1")
        return materialize(spark, found.select("payload_digest", "first"), "payloads")

    groups = groups_of(rows)
    if not groups.where("first.n > 1").isEmpty():
        rows = materialize(spark, rows.withColumn("_row", F.monotonically_increasing_id()), "pages")
        groups = groups_of(rows)
    is_first = F.col("page_id").eqNullSafe(F.col("first.page_id")) & (F.col("_row") == F.col("first._row"))
    is_revisit = F.col("first").isNotNull() & ~is_first
    return rows.join(groups, "payload_digest", "left").select(
        "page_id",
        "url",
        "html",
        "payload_bytes",
        "payload_digest",
        F.when(is_revisit, "revisit").otherwise("response").alias("record_type"),
        F.when(is_revisit, F.col("first.page_id")).alias("refers_to"),
    )


def record_id(page_id: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), F.coalesce(page_id.cast("string"), F.lit("none")), F.lit(">"))


def record_text(date: str = "1970-01-01T00:00:00Z") -> Column:
    """A deduplicated row as a WARC/1.1 record, without the separator that ends it."""
    response = F.col("record_type") == "response"
    uri = F.transform(F.split(F.col("url"), ""), lambda c: F.when(c.rlike(r"[\x00-\x20\x7f]"), F.concat(F.lit("%"), F.lpad(F.hex(F.ascii(c)), 2, "0"))).otherwise(c))
    clean = F.when(F.col("url").rlike(r"[\x00-\x20\x7f]"), F.concat_ws("", uri)).otherwise(F.col("url"))
    http = F.concat(
        F.lit(f"HTTP/1.1 200 OK{END}Content-Type: text/html; charset=utf-8{END}Content-Length: "),
        F.col("payload_bytes").cast("string"),
        F.lit(END + END),
    )
    block = F.when(response, F.concat(http, F.col("html"))).otherwise(F.lit(""))
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit(END))
    head = F.concat(
        F.lit(f"WARC/1.1{END}"),
        line("WARC-Type", F.col("record_type")),
        line("WARC-Record-ID", record_id(F.col("page_id"))),
        line("WARC-Date", F.lit(date)),
        F.coalesce(line("WARC-Target-URI", clean), F.lit("")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("payload_digest"))),
        line("X-Payload-Length", F.col("payload_bytes").cast("string")),
        F.when(response, F.lit("")).otherwise(
            F.concat(
                line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
                line("WARC-Refers-To", record_id(F.col("refers_to"))),
            )
        ),
        line("Content-Type", F.lit("application/http;msgtype=response")),
        line("Content-Length", F.octet_length(block).cast("string")),
        F.lit(END),
    )
    return F.concat(head, block)


def write_warc(pages: DataFrame, path: str, least_bytes: int = 0, compression: str = "none") -> None:
    """Archives of pages (page_id, url, html) in a new folder."""
    records = deduplicate(pages, least_bytes).select(record_text().alias("value"))
    records.write.option("lineSep", END + END).option("compression", compression).text(path)


# --- reading


class Files(InputPartition):
    def __init__(self, files: list[str]):
        self.files = files


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), ARROW, strict=True)], schema=ARROW)


def _file_system(path: str) -> tuple[Any, str]:
    """A pyarrow file system and the path in it; local paths may come without a scheme."""
    from pyarrow import fs

    parts = urlsplit(path)
    if parts.scheme in ("", "file"):
        return fs.LocalFileSystem(), unquote(parts.path) if parts.scheme else path
    return fs.FileSystem.from_uri(path)


def _skip(stream: Any, n: int) -> None:
    if stream.seekable() and not isinstance(stream, gzip.GzipFile):
        stream.seek(n, 1)
        return
    while n > 0:
        got = len(stream.read(min(n, 1 << 20)))
        if not got:
            return
        n -= got


def read_records(stream: Any, wanted: Any, payload: str) -> Iterator[tuple[int, dict[str, str], int, str | None, int | None, bytes | None]]:
    """Records of a binary stream whose header `wanted` takes.

    Yields position, header (names lowered), block length, digest, payload length and payload. The
    payload of a response or request with an HTTP head is what follows it. A record cut short ends it.
    """
    position = 0
    while True:
        line = stream.readline()
        if not line:
            return
        start = position
        position += len(line)
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no WARC record at {start}")
        head: dict[str, str] = {}
        last = ""
        while (line := stream.readline()).strip():
            position += len(line)
            if line[:1] in b" \t" and last:  # a folded line
                head[last] += " " + line.strip().decode("utf-8", "replace")
                continue
            name, _, value = line.decode("utf-8", "replace").partition(":")
            last = name.strip().lower()
            head[last] = value.strip()
        position += len(line)
        length = int(head.get("content-length", "0"))
        if not wanted(head) or payload == "none":
            _skip(stream, length)
            position += length
            if wanted(head):
                yield start, head, length, None, None, None
            continue
        digest, size, parts, left = hashlib.sha1(), 0, [], length
        if head.get("content-type", "").lower().startswith("application/http"):
            while left > 0:
                line = stream.readline(left)
                left -= len(line)
                if not line.strip():
                    break
        while left > 0 and (part := stream.read(min(left, 1 << 20))):
            left -= len(part)
            digest.update(part)
            size += len(part)
            if payload == "bytes":
                parts.append(part)
        position += length
        yield start, head, length, base64.b32encode(digest.digest()).decode(), size, b"".join(parts) if payload == "bytes" else None


class WarcReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path = options["path"]
        self.payload = options.get("payload", "bytes")
        if self.payload not in ("bytes", "digest", "none"):
            raise ValueError("payload is bytes, digest or none")
        self.partition_bytes = int(options.get("partition_bytes", 64 << 20))
        self.equal: dict[str, frozenset] = {}
        self.present: set[str] = set()

    def pushFilters(self, filters):  # noqa: N802  the interface's name
        from pyspark.sql.datasource import EqualTo, In, IsNotNull

        for f in filters:
            name = f.attribute[0] if len(f.attribute) == 1 else ""
            if name in FIELDS and isinstance(f, EqualTo):
                self._among(name, {f.value})
            elif name in FIELDS and isinstance(f, In):
                self._among(name, set(f.value))
            elif name in FIELDS and isinstance(f, IsNotNull):
                self.present.add(name)
            else:
                yield f

    def _among(self, name: str, values: set) -> None:
        self.equal[name] = frozenset(values) & self.equal.get(name, frozenset(values))

    def partitions(self) -> list[Files]:
        """Files by descending size into bins of partition_bytes; a file is never cut."""
        from pyarrow import fs

        system, path = _file_system(self.path)
        info = system.get_file_info(path)
        infos = [info] if info.type == fs.FileType.File else system.get_file_info(fs.FileSelector(path, recursive=True))
        found = sorted(
            (-i.size, i.path) for i in infos
            if i.type == fs.FileType.File and i.size and not posixpath.basename(i.path).startswith(("_", "."))
        )
        bins: list[Files] = []
        room = 0
        for size, name in found:
            if not bins or room + size < 0:
                bins.append(Files([]))
                room = self.partition_bytes
            bins[-1].files.append(name)
            room += size
        return bins or [Files([])]

    def wanted(self, head: dict[str, str]) -> bool:
        for name in self.present:
            if self.column(name, head) is None:
                return False
        return all(self.column(name, head) in values for name, values in self.equal.items())

    @staticmethod
    def column(name: str, head: dict[str, str]) -> str | None:
        value = head.get(FIELDS[name])
        return value.rpartition(":")[2] if name == "payload_digest" and value else value

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        """Arrow batches of BATCH_ROWS rows or about BATCH_BYTES of payload, whichever is less."""
        rows, held = [], 0
        for row in self.rows(partition):
            rows.append(row)
            held += len(row[7] or b"")
            if len(rows) >= BATCH_ROWS or held >= BATCH_BYTES:
                yield _batch(rows)
                rows, held = [], 0
        if rows:
            yield _batch(rows)

    def rows(self, partition: Files) -> Iterator[tuple]:
        system, _ = _file_system(self.path)
        for name in partition.files:
            raw = system.open_input_file(name)
            stream: Any = gzip.GzipFile(fileobj=raw) if name.endswith(".gz") else io.BufferedReader(raw, 1 << 18)
            with raw:
                for at, head, length, digest, size, payload in read_records(stream, self.wanted, self.payload):
                    whole = digest is not None and head.get("warc-type") != "revisit"
                    declared = head.get("x-payload-length")
                    yield (
                        head.get("warc-record-id"),
                        head.get("warc-type"),
                        head.get("warc-target-uri"),
                        head.get("warc-refers-to"),
                        digest if whole else self.column("payload_digest", head),
                        size if whole else int(declared) if declared and declared.isdigit() else None,
                        length,
                        payload,
                        name,
                        at,
                    )


class WarcSource(DataSource):
    """spark.read.format("warc").option("path", folder).load()"""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WarcReader:
        return WarcReader(dict(self.options))


def read_warc(spark: SparkSession, path: str, payload: str = "bytes", partition_bytes: int = 64 << 20) -> DataFrame:
    """Records of the archives in a folder, with predicates pushed down to their headers."""
    spark.dataSource.register(WarcSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return (
        spark.read.format("warc")
        .option("path", path)
        .option("payload", payload)
        .option("partition_bytes", str(partition_bytes))
        .load()
    )


def page_of(record: Column) -> Column:
    """page_id of a record id of this module's writer."""
    return F.regexp_extract(record, r"^<urn:page:(-?\d+)>$", 1).try_cast("bigint")
