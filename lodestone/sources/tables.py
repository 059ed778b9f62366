"""Readers and sinks: text-typed files, snapshots, JSON lines, vintages, provenance."""

from __future__ import annotations

import csv
import hashlib
import json
import re
import struct
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..operators.joins import ContractError


def storage(spark: SparkSession, path: str):
    """(file system, path) of Hadoop for a path on any storage."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def exists(spark: SparkSession, path: str) -> bool:
    fs, at = storage(spark, path)
    return fs.exists(at)


def write_bytes(spark: SparkSession, path: str, content: bytes) -> None:
    """A small file on any storage; one that exists is never replaced."""
    fs, at = storage(spark, path)
    out = fs.create(at, False)
    try:
        out.write(bytearray(content))
    finally:
        out.close()


def write_note(spark: SparkSession, path: str, text: str) -> None:
    write_bytes(spark, path, text.encode())


def read_note(spark: SparkSession, path: str) -> str:
    fs, at = storage(spark, path)
    stream = fs.open(at)
    try:
        return bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
    finally:
        stream.close()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that all executors share (``spark.checkpoint.dir``); a local session may do without."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = f"file://{tempfile.gettempdir()}/lodestone-scratch"
    return f"{root.rstrip('/')}/tables/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def text_schema(columns: list[str]) -> StructType:
    return StructType([StructField(c, StringType()) for c in columns])


def read_text_csv(spark: SparkSession, path: str, columns: list[str] | None = None, sep: str = ",", encoding: str = "UTF-8", header: bool = True, select: list[str] | None = None, drop_bad: bool = False) -> DataFrame:
    """A delimited file with every column as text; types are never inferred."""
    reader = spark.read.option("header", header).option("sep", sep).option("encoding", encoding).option("mode", "DROPMALFORMED" if drop_bad else "PERMISSIVE")
    df = reader.schema(text_schema(columns)).csv(path) if columns else reader.option("inferSchema", False).csv(path)
    return df.select(*select) if select else df


def read_any(spark: SparkSession, path: str) -> DataFrame:
    """By extension: csv, tsv, txt (pipe), json, jsonl, parquet, orc; Excel where pandas can read it."""
    kind = re.sub(r"\.gz$", "", path).rsplit(".", 1)[-1].lower()
    if kind in ("csv", "tsv", "txt"):
        return read_text_csv(spark, path, sep={"csv": ",", "tsv": "\t", "txt": "|"}[kind])
    if kind in ("json", "jsonl"):
        return read_json_lines(spark, path)
    if kind in ("parquet", "orc"):
        return spark.read.format(kind).load(path)
    if kind in ("xlsx", "xls"):
        import pandas as pd

        return spark.createDataFrame(pd.read_excel(path, dtype=str))
    raise ValueError(f"no reader for {path}")


def read_csv_with_footer(spark: SparkSession, path: str, required: tuple[str, ...] = ()) -> tuple[DataFrame, dict[str, str]]:
    """The table before the footer, and its "Key: value" lines; a missing required key is an error.

    For small exports: footer lines are those with other than the header's number of fields.
    """
    lines = spark.read.text(path).select(F.monotonically_increasing_id().alias("n"), "value")
    head = lines.orderBy("n").first()
    width = len(next(csv.reader([head["value"]])))
    n_fields = F.regexp_count("value", F.lit(r',(?=(?:[^"]*"[^"]*")*[^"]*$)')) + 1
    tagged = lines.withColumn("fields", n_fields)
    note = lambda k: F.trim(F.regexp_extract("value", r'^"?([^:"]+):\s*(.*?)"?,*$', k))
    found = tagged.filter(F.col("fields") != width).select("n", note(1).alias("key"), note(2).alias("text")).filter("key <> ''")
    notes = {r["key"]: r["text"] for r in found.groupBy("key").agg(F.max_by("text", "n").alias("text")).collect()}  # one row a key
    if missing := [k for k in required if k not in notes]:
        raise ContractError(f"footer without {missing}")
    names = next(csv.reader([head["value"]]))
    schema = ", ".join(f"`{c}` string" for c in names)
    body = tagged.filter((F.col("fields") == width) & (F.col("n") != head["n"]))
    return body.select(F.from_csv("value", schema).alias("r")).select("r.*"), notes


def read_with_fallback(spark: SparkSession, path: str, encodings: tuple[str, ...] = ("UTF-8", "ISO-8859-1"), **options) -> DataFrame:
    """The first encoding in which no replacement character shows."""
    for e in encodings[:-1]:
        df = read_text_csv(spark, path, encoding=e, **options)
        bad = df.filter(" OR ".join(f"contains(`{c}`, '�')" for c in df.columns)).limit(1).count()
        if not bad:
            return df
    return read_text_csv(spark, path, encoding=encodings[-1], **options)


def dated_snapshots(spark: SparkSession, pattern: str, date: str = r"(\d{8}|\d{4}-\d{2})", keep: str = "earliest") -> dict[str, str]:
    """Period to path: one file a period, the earliest or the latest by name; on any storage."""
    fs, at = storage(spark, pattern)
    out: dict[str, str] = {}
    for path in sorted(x.getPath().toString() for x in fs.globStatus(at) or []):
        if m := re.search(date, path.rsplit("/", 1)[-1]):
            period = m[1][:4] if len(m[1]) == 8 else m[1]
            if keep == "latest" or period not in out:
                out[period] = path
    return out


def read_snapshots(spark: SparkSession, paths: dict[str, str], **options) -> DataFrame:
    frames = [read_text_csv(spark, p, **options).withColumn("snapshot", F.lit(k)) for k, p in sorted(paths.items())]
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def first_column(df: DataFrame, *names: str) -> str | None:
    """The first of several aliases that the frame has, whatever the case."""
    have = {c.lower(): c for c in df.columns}
    return next((have[n.lower()] for n in names if n.lower() in have), None)


def with_optional(df: DataFrame, *names: str) -> DataFrame:
    return df.select("*", *(F.lit(None).cast("string").alias(n) for n in names if n not in df.columns))


def require_columns(df: DataFrame, *names: str) -> DataFrame:
    if missing := [n for n in names if n not in df.columns]:
        raise ContractError(f"missing columns {missing}")
    return df


def snake_case(df: DataFrame) -> DataFrame:
    return df.toDF(*(re.sub(r"[^a-z0-9]+", "_", re.sub(r"([a-z0-9])([A-Z])", r"\1_\2", c).lower()).strip("_") for c in df.columns))


def read_json_lines(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """JSON lines; a truncated or broken line is left out."""
    reader = spark.read.option("mode", "DROPMALFORMED")
    return (reader.schema(schema) if schema else reader).json(path)


def json_table(spark: SparkSession, rows: list[list[str]]) -> DataFrame:
    """An API answer whose first row is the header."""
    return spark.createDataFrame([tuple(r) for r in rows[1:]], text_schema(rows[0]))


def overwrite_vintage(df: DataFrame, path: str, vintage: str) -> None:
    """Replace only the partitions that the frame holds; a second run gives the same table."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(vintage).parquet(path)


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).option("header", True).option("nullValue", "").option("emptyValue", "").csv(path)


def file_hash(spark: SparkSession, path: str) -> str:
    """SHA-256 of a file on any storage, streamed."""
    fs, at = storage(spark, path)
    stream = fs.open(at)
    try:
        return spark._jvm.org.apache.commons.codec.digest.DigestUtils.sha256Hex(stream)
    finally:
        stream.close()


def content_rows(df: DataFrame) -> DataFrame:
    """One row (n, total, parity): the number of rows and sums of their MD5 values, whatever their order."""
    row = F.md5(F.concat_ws("|", *(F.coalesce(F.col(c).cast("string"), F.lit("<null>")) for c in sorted(df.columns))))
    part = lambda a: F.conv(F.substring(row, a, 8), 16, 10).cast("long")
    return df.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(part(1)), F.lit(0)).alias("total"), F.coalesce(F.bit_xor(part(9)), F.lit(0)).alias("parity"))


def content_hash(df: DataFrame) -> str:
    """A hash of the rows that does not depend on their order; equal rows count."""
    r = content_rows(df).first()
    return hashlib.sha256(json.dumps([r["n"], str(r["total"]), r["parity"], sorted(df.columns)]).encode()).hexdigest()


def note_path(path: str, kind: str) -> str:
    return f"{path.rstrip('/')}.{kind}.json"


def write_with_provenance(df: DataFrame, path: str, inputs: list[str], **notes: str) -> None:
    """Write, then record the inputs' hashes and the table's own beside it."""
    spark = df.sparkSession
    df.write.mode("errorifexists").parquet(path)
    record = {"inputs": {p: file_hash(spark, p) for p in inputs}, "content": content_hash(spark.read.parquet(path)), **notes}
    write_note(spark, note_path(path, "provenance"), json.dumps(record, indent=1, sort_keys=True))


def stale_inputs(spark: SparkSession, path: str) -> list[str]:
    """Inputs whose hash has changed since the table was written, or that are gone."""
    inputs = json.loads(read_note(spark, note_path(path, "provenance")))["inputs"]
    return sorted(p for p, h in inputs.items() if not exists(spark, p) or file_hash(spark, p) != h)


def write_manifest(spark: SparkSession, path: str, run: str, tables: dict[str, str], **notes: str) -> None:
    """A run's manifest: each table's path, rows and content hash."""
    rows = {name: {"path": at, "rows": spark.read.parquet(at).count(), "content": content_hash(spark.read.parquet(at))} for name, at in tables.items()}
    write_note(spark, path, json.dumps({"run": run, "tables": rows, **notes}, indent=1, sort_keys=True))


def spec_path(folder: str, name: str, **spec: str) -> str:
    """A table's path that says what it holds: the name and its settings in order."""
    parts = [f"{k}-{re.sub(r'[^A-Za-z0-9.+]+', '-', str(v))}" for k, v in sorted(spec.items())]
    return f"{folder.rstrip('/')}/{'_'.join([name, *parts])}"


def freeze(df: DataFrame, path: str) -> None:
    """Write once; a frozen table is never written again."""
    if exists(df.sparkSession, path):
        raise ContractError(f"{path} is frozen")
    df.write.mode("errorifexists").parquet(path)


def atomic_write(df: DataFrame, path: str, check=None) -> None:
    """Write beside the target, validate, then rename."""
    spark = df.sparkSession
    staged = f"{path.rstrip('/')}.staged"
    df.write.mode("overwrite").parquet(staged)
    if check:
        check(spark.read.parquet(staged))
    fs, target = storage(spark, path)
    if fs.exists(target):
        raise ContractError(f"{path} exists")
    if not fs.rename(storage(spark, staged)[1], target):
        raise ContractError(f"{staged} could not be renamed")


def append_rows(df: DataFrame, path: str, id_: str) -> None:
    """Append the rows whose id the table does not have yet."""
    spark = df.sparkSession
    if exists(spark, path):
        df = df.join(spark.read.parquet(path).select(id_).distinct(), id_, "left_anti")
    df.write.mode("append").parquet(path)


def typed(df: DataFrame, types: dict[str, str]) -> DataFrame:
    """Columns of a text table with the given types; what does not fit is null."""
    return df.select(*(F.col(c).try_cast(types[c]).alias(c) if c in types else F.col(c) for c in df.columns))


def flatten(df: DataFrame, sep: str = "_") -> DataFrame:
    """Fields of structs as columns, at any depth, named by their path."""
    while any(isinstance(f.dataType, StructType) for f in df.schema):
        df = df.select(*(c for f in df.schema for c in ([F.col(f.name)[g.name].alias(f"{f.name}{sep}{g.name}") for g in f.dataType] if isinstance(f.dataType, StructType) else [F.col(f.name)])))
    return df


def xml_rows(df: DataFrame, column: str, schema: str, keep: list[str]) -> DataFrame:
    """Columns of ``schema`` parsed from one XML element a row."""
    return df.select(*keep, F.from_xml(F.col(column), schema).alias("x")).select(*keep, "x.*")


def request_text(template: str, **values: Column) -> Column:
    """A request's text: each ``{name}`` of the template replaced, with XML's signs escaped."""
    out = F.lit(template)
    for name, value in values.items():
        text = value.cast("string")
        for sign, code in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
            text = F.replace(text, F.lit(sign), F.lit(code))
        out = F.replace(out, F.lit("{" + name + "}"), F.coalesce(text, F.lit("")))
    return out


def embedded_json(html: Column, schema: str) -> Column:
    """The first linked-data object in a page's scripts, entities unescaped; null if it does not parse."""
    text = F.regexp_extract(html, r'(?is)<script[^>]*type="application/ld\+json"[^>]*>(.*?)</script>', 1)
    for code, sign in (("&quot;", '"'), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&")):
        text = F.replace(text, F.lit(code), F.lit(sign))
    return F.when(F.trim(text) != "", F.from_json(text, schema))


def table_cells(html: Column) -> Column:
    """Rows of cells of all tables in a page, tags removed."""
    rows = F.regexp_extract_all(html, F.lit(r"(?is)<tr[^>]*>(.*?)</tr>"), F.lit(1))
    clean = lambda c: F.trim(F.regexp_replace(c, "(?s)<[^>]*>", ""))
    return F.transform(rows, lambda r: F.transform(F.regexp_extract_all(r, F.lit(r"(?is)<t[dh][^>]*>(.*?)</t[dh]>"), F.lit(1)), clean))


def split_searches(df: DataFrame, name: str, cap: int) -> DataFrame:
    """(prefix, n): the searches by prefix that together find all names, none with more than ``cap`` hits.

    A search that finds more is split by its next letter; a name that ends there is
    searched whole, however often it occurs.
    """
    words = df.groupBy(F.lower(name).alias("_w")).agg(F.count(F.lit(1)).alias("_n")).filter("_w <> ''")
    each = words.withColumn("_l", F.explode(F.sequence(F.lit(1), F.length("_w"))))
    counts = each.groupBy(F.substring("_w", F.lit(1), F.col("_l")).alias("prefix")).agg(F.sum("_n").alias("n"), F.max(F.when(F.col("_l") == F.length("_w"), F.col("_n"))).alias("whole"))
    above = counts.select(F.col("prefix").alias("_p"), F.col("n").alias("_above"))
    parent = F.left(F.col("prefix"), F.length("prefix") - 1)
    rows = counts.join(above, parent == F.col("_p"), "left").filter((F.length("prefix") == 1) | (F.col("_above") > cap))
    found = rows.withColumn("exact", F.col("n") > cap).filter((F.col("n") <= cap) | F.col("whole").isNotNull())
    return found.select("prefix", "exact", F.when(F.col("exact"), F.col("whole")).otherwise(F.col("n")).alias("n"))


def polygons_of(content: bytes) -> Iterator[tuple[int, list[list[list[float]]]]]:
    """(record, rings of [x, y]) of a shapefile's polygon records; empty shapes have none, other kinds are an error."""
    at = 100
    while at + 8 <= len(content):
        record, words = struct.unpack_from(">ii", content, at)
        kind = struct.unpack_from("<i", content, at + 8)[0]
        if kind not in (0, 5):
            raise ContractError(f"shape kind {kind} is no polygon")
        rings: list[list[list[float]]] = []
        if kind == 5:
            n_parts, n_points = struct.unpack_from("<ii", content, at + 44)
            parts = [*struct.unpack_from(f"<{n_parts}i", content, at + 52), n_points]
            flat = struct.unpack_from(f"<{2 * n_points}d", content, at + 52 + 4 * n_parts)
            points = [[flat[k], flat[k + 1]] for k in range(0, 2 * n_points, 2)]
            rings = [points[a:b] for a, b in zip(parts, parts[1:], strict=False)]
        yield record, rings
        at += 8 + 2 * words


def read_shapes(spark: SparkSession, path: str) -> DataFrame:
    """(path, record, part, ring) of the polygons in shapefiles, one row a ring."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def parse(batches):
        for batch in batches:
            for name, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                rows = [(name, record, part, ring) for record, rings in polygons_of(content) for part, ring in enumerate(rings)]
                kinds = [pa.string(), pa.int32(), pa.int32(), pa.list_(pa.list_(pa.float64()))]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True) if rows else [[]] * 4, kinds, strict=True)], ["path", "record", "part", "ring"])

    return files.mapInArrow(parse, "path string, record int, part int, ring array<array<double>>")


def shapefile(polygons: list[list[list[tuple[float, float]]]]) -> bytes:
    """The bytes of a shapefile with a polygon of rings for each entry."""
    body = b""
    for k, rings in enumerate(polygons, 1):
        points = [p for ring in rings for p in ring]
        starts = [sum(len(r) for r in rings[:i]) for i in range(len(rings))]
        xs, ys = [p[0] for p in points] or [0.0], [p[1] for p in points] or [0.0]
        shape = struct.pack("<i4dii", 5, min(xs), min(ys), max(xs), max(ys), len(rings), len(points)) + struct.pack(f"<{len(starts)}i", *starts) + b"".join(struct.pack("<2d", *p) for p in points)
        body += struct.pack(">ii", k, len(shape) // 2) + shape
    return struct.pack(">7i", 9994, 0, 0, 0, 0, 0, (100 + len(body)) // 2) + struct.pack("<ii8d", 1000, 5, *[0.0] * 8) + body


def tables_like(spark: SparkSession, pattern: str) -> list[str]:
    """Names of the catalog's tables and views that match."""
    return sorted(x.name for x in spark.catalog.listTables() if re.fullmatch(pattern, x.name))


def register(frames: dict[str, DataFrame]) -> None:
    """Frames as views, to be used in SQL by name."""
    for name, df in frames.items():
        df.createOrReplaceTempView(name)


def drop_republished(df: DataFrame, period: str, digest: str) -> DataFrame:
    """Keep the first period of those with the same digest."""
    place = F.row_number().over(Window.partitionBy(digest).orderBy(period))
    return df.withColumn("_n", place).filter("_n = 1").drop("_n")
