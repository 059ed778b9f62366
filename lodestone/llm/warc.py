"""WARC archives: a Python data source, and a writer on Spark's own sink.

Reading: :class:`WarcSource` plans partitions of whole files, small files
together, and takes filters on ``record_type``, ``record_id``, ``target_uri`` and
``payload_digest``.  A record's header block is parsed first; the body of a
record that the filters reject is skipped over, not read, and with the option
``payload=false`` no body is decoded at all.  Both plain and gzip files work.

Writing: header and payload are joined as bytes and go through Spark's text sink
with the record end as line end, so its commit protocol covers retried tasks and
any file system that Spark writes to.

Defined results: a null html is an empty payload; a null url leaves out the
target URI; CR and LF in a url are percent-encoded; rows with the same
``page_id`` and payload are all responses when that id is the smallest of the
payload; a null ``page_id`` is never the smallest one unless all are null, and
such rows are then all responses; an empty table gives an empty archive.
"""

from __future__ import annotations

import gzip
import io
from collections.abc import Iterator
from urllib.parse import urlparse

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition, IsNotNull
from pyspark.sql.types import StructType

from .common import durable, need, shared_path, table

SCHEMA = (
    "record_id string, record_type string, target_uri string, date string, refers_to string, payload_digest string, "
    "content_length long, headers map<string,string>, payload binary, file string, position long"
)
FIELDS = {"record_id": "warc-record-id", "record_type": "warc-type", "target_uri": "warc-target-uri", "date": "warc-date", "refers_to": "warc-refers-to", "payload_digest": "warc-payload-digest"}
PUSHED = ("record_type", "record_id", "target_uri", "payload_digest")
#: Payloads shorter than this are never deduplicated.
MIN_REVISIT_BYTES = 100
#: Bytes of files that one partition of a scan should have, and of payloads in one batch.
PARTITION_BYTES = 64 << 20
BATCH_BYTES = 4 << 20
RECORD_END = "\r\n\r\n"


def _filesystem(path: str):
    from pyarrow import fs

    if not urlparse(path).scheme:
        return fs.LocalFileSystem(), path
    if path.startswith("file:"):
        return fs.LocalFileSystem(), urlparse(path).path
    return fs.FileSystem.from_uri(path)


class Files(InputPartition):
    def __init__(self, files: list[str]):
        super().__init__(files)
        self.files = files


def read_records(stream, wanted, payloads: bool = True) -> Iterator[tuple[dict[str, str], bytes | None, int]]:
    """(headers, payload, position) of the records whose headers ``wanted`` accepts.

    Bodies of other records are passed over by seeking.  The payload is the body,
    or for HTTP messages what follows their header, whose fields are then added
    to the headers as ``http-<name>``.  Header names are in lower case.  A truncated last record ends the iteration.
    """
    while True:
        line = stream.readline()
        while line in (b"\r\n", b"\n"):
            line = stream.readline()
        if not line:
            return
        position = stream.tell() - len(line)
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no WARC record at byte {position}")
        headers: dict[str, str] = {}
        name = ""
        while (line := stream.readline()) not in (b"\r\n", b"\n", b""):
            text = line.decode("utf-8", "replace").rstrip("\r\n")
            if text[:1] in (" ", "\t") and name:
                headers[name] += " " + text.strip()
            else:
                name, _, value = text.partition(":")
                name = name.strip().lower()
                headers[name] = value.strip()
        length = int(headers.get("content-length", "0"))
        if not wanted(headers):
            stream.seek(length, 1)
            continue
        if not payloads:
            stream.seek(length, 1)
            yield headers, None, position
            continue
        body = stream.read(length)
        if len(body) < length:
            return
        if headers.get("content-type", "").startswith("application/http"):
            http, _, body = body.partition(b"\r\n\r\n")
            for text in http.decode("utf-8", "replace").split("\r\n")[1:]:
                name, _, value = text.partition(":")
                headers["http-" + name.strip().lower()] = value.strip()
        yield headers, body, position


class WarcReader(DataSourceReader):
    def __init__(self, path: str, options: dict[str, str]):
        self.path = path
        self.payloads = options.get("payload", "true").lower() != "false"
        self.bytes = int(options.get("partitionbytes", options.get("partitionBytes", PARTITION_BYTES)))
        self.tests: list[tuple[str, frozenset]] = []

    def pushFilters(self, filters: list[Filter]):
        for f in filters:
            name = f.attribute[0] if hasattr(f, "attribute") else ""
            if name in PUSHED and isinstance(f, (EqualTo, In)):
                self.tests.append((FIELDS[name], frozenset([f.value] if isinstance(f, EqualTo) else f.value)))
            elif name in PUSHED and isinstance(f, IsNotNull):
                self.tests.append((FIELDS[name], frozenset()))
            else:
                yield f

    def partitions(self):
        from pyarrow import fs

        system, root = _filesystem(self.path)
        info = system.get_file_info(root)
        found = [info] if info.is_file else system.get_file_info(fs.FileSelector(root, recursive=True))
        files = sorted((f.path, f.size) for f in found if f.is_file and not f.base_name.startswith(("_", ".")))
        groups: list[list[str]] = []
        room = 0
        for path, size in files:
            if not groups or size > room:
                groups.append([])
                room = self.bytes
            groups[-1].append(path)
            room -= size
        return [Files(g) for g in groups] or [Files([])]

    def wanted(self, headers: dict[str, str]) -> bool:
        return all((v := headers.get(name)) is not None and (not values or v in values) for name, values in self.tests)

    def read(self, partition):
        schema = pa.schema([(n, pa.map_(pa.string(), pa.string()) if k.startswith("map") else {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}[k]) for n, k in (c.split(" ") for c in SCHEMA.split(", "))])
        system, _ = _filesystem(self.path)
        rows, size = [], 0

        def batch():
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(schema)], schema=schema)

        for path in partition.files:
            with system.open_input_file(path) as raw:
                zipped = raw.read(2) == b"\x1f\x8b"
                raw.seek(0)
                stream = gzip.GzipFile(fileobj=raw) if zipped else _Buffered(raw)
                for headers, body, position in read_records(stream, self.wanted, self.payloads):
                    rows.append((*(headers.get(h) for h in FIELDS.values()), int(headers.get("content-length", "0")), list(headers.items()), body, path, position))
                    size += len(body or b"") + 500
                    if size >= BATCH_BYTES:
                        yield batch()
                        rows, size = [], 0
        if rows:
            yield batch()


class _Buffered:
    """Buffered reading, line reading and cheap forward seeks over a random-access file."""

    def __init__(self, raw):
        self.file = io.BufferedReader(_Raw(raw), 1 << 18)
        self.readline, self.read, self.seek, self.tell = self.file.readline, self.file.read, self.file.seek, self.file.tell


class _Raw(io.RawIOBase):
    def __init__(self, raw):
        self.raw = raw

    def readable(self):
        return True

    def seekable(self):
        return True

    def readinto(self, buffer):
        data = self.raw.read(len(buffer))
        buffer[: len(data)] = data
        return len(data)

    def seek(self, offset, whence=0):
        if whence == 1:
            offset += self.raw.tell()
        elif whence == 2:
            offset += self.raw.size()
        self.raw.seek(offset)
        return offset

    def tell(self):
        return self.raw.tell()


class WarcSource(DataSource):
    """``spark.read.format("warc").option("path", ...)``; options payload, partitionBytes."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> WarcReader:
        return WarcReader(self.options["path"], dict(self.options))


def read_warc(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    """A frame over a WARC file or folder; equality filters on :data:`PUSHED` columns reach the reader."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)
    return spark.read.format("warc").option("path", path).option("payload", str(payload).lower()).load()


def record_uri(page_id: Column, fallback: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), F.coalesce(page_id.cast("string"), F.concat(F.lit("none-"), fallback)), F.lit(">"))


def page_records(pages: DataFrame) -> DataFrame:
    """(page_id, url, html, payload_bytes, payload_digest, refers_to) with revisits resolved."""
    rows = need(pages, page_id="long", url="string", html="string").withColumn("html", F.coalesce("html", F.lit("")))
    rows = rows.withColumn("payload_bytes", F.octet_length("html").cast("long")).withColumn("payload_digest", F.sha2("html", 256))
    repeated = (
        rows.filter(F.col("payload_bytes") >= MIN_REVISIT_BYTES)
        .groupBy("payload_digest")
        .agg(F.min("page_id").alias("first_id"), F.count(F.lit(1)).alias("n"))
        .filter("n > 1 AND first_id IS NOT NULL")
        .select(F.col("payload_digest").alias("d"), "first_id")
    )
    # A stored table: the planner knows its size and broadcasts it only when it is small.
    repeated = durable(repeated, "warc-repeated")
    rows = rows.join(repeated, rows["payload_digest"] == repeated["d"], "left")
    again = F.col("first_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id"))
    return rows.select("page_id", "url", "html", "payload_bytes", "payload_digest", F.when(again, F.col("first_id")).alias("refers_to"))


def write_warc(records: DataFrame, path: str, date: str = "2000-01-01T00:00:00Z") -> None:
    """Write :func:`page_records` rows as WARC/1.1 response and revisit records."""
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    is_revisit = F.col("refers_to").isNotNull()
    uri = F.regexp_replace(F.regexp_replace("url", "\r", "%0D"), "\n", "%0A")
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"), line("Content-Length", F.col("payload_bytes").cast("string")), F.lit("\r\n"))
    body = F.when(is_revisit, http).otherwise(F.concat(http, F.col("html")))
    head = F.concat(
        F.lit("WARC/1.1\r\n"),
        line("WARC-Type", F.when(is_revisit, F.lit("revisit")).otherwise(F.lit("response"))),
        line("WARC-Record-ID", record_uri(F.col("page_id"), F.col("payload_digest"))),
        line("WARC-Date", F.lit(date)),
        F.when(F.col("url").isNotNull(), line("WARC-Target-URI", uri)).otherwise(F.lit("")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("payload_digest"))),
        F.when(is_revisit, F.concat(F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\n"), line("WARC-Refers-To", record_uri(F.col("refers_to"), F.col("payload_digest"))))).otherwise(F.lit("")),
        F.lit("Content-Type: application/http;msgtype=response\r\n"),
    )
    # Bytes: html may hold any characters, and Content-Length counts its UTF-8 form.
    record = F.concat(head, line("Content-Length", F.octet_length(body).cast("string")), F.lit("\r\n"), body)
    records.select(record.alias("value")).write.option("lineSep", RECORD_END).text(path)


def page_of(uri: Column) -> Column:
    return F.regexp_extract(uri, "^<urn:page:(-?[0-9]+)>$", 1).try_cast("long")


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_path(spark, "warc")
    write_warc(page_records(table(spark, sf_dir, "pages")), path)
    responses = read_warc(spark, path).filter("record_type = 'response'").select(
        page_of(F.col("record_id")).alias("page_id"),
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_digest"),
        "record_type",
        F.lit(None).cast("long").alias("refers_to"),
    )
    revisits = read_warc(spark, path).filter("record_type = 'revisit'").select(
        page_of(F.col("record_id")).alias("page_id"),
        F.col("headers")["http-content-length"].try_cast("long").alias("payload_bytes"),
        F.regexp_replace("payload_digest", "^sha256:", "").alias("payload_digest"),
        "record_type",
        page_of(F.col("refers_to")).alias("refers_to"),
    )
    return responses.unionByName(revisits)


OP4_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes, sha256(html) AS payload_digest FROM p),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_id FROM d)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 100 AND first_id IS NOT NULL AND page_id IS DISTINCT FROM first_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 100 AND first_id IS NOT NULL AND page_id IS DISTINCT FROM first_id THEN first_id END AS refers_to
FROM f
"""
