"""Shared plumbing: durable intermediate tables and bounded Arrow batches."""

from __future__ import annotations

import gc
import os
import tempfile
import time
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows in one Arrow batch sent to Python; bounds a worker's memory for long texts.
ARROW_ROWS = 256
#: Bits of a membership bitmap (8 MB), however many keys it holds.
BITMAP_BITS = 1 << 26


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, from ``spark.checkpoint.dir``.

    Only a session on a local master may do without the setting: it then gets a
    folder of its own.  On a cluster a missing setting is an error, since a
    machine-local folder would not be visible to the other executors.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = f"file://{tempfile.gettempdir()}/checkpoints/{os.getuid()}"
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/lodestone/{spark.sparkContext.applicationId}"


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path below :func:`shared_dir`."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def durable(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder as Parquet and read it back.

    This cuts the lineage: a lost executor costs only a reread, and the reread
    table has a known size, by which Catalyst picks its join strategy.  Small shuffles
    end in files of the advised size, not in one for each core: hundreds of small files
    a table cost more than they gain.
    """
    spark = df.sparkSession
    path = shared_path(spark, name)
    with setting(spark, "spark.sql.adaptive.coalescePartitions.parallelismFirst", "false"):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def setting(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    """A session setting for the actions within, put back afterwards."""
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def release(spark: SparkSession) -> None:
    """Let the driver forget finished plans, so that the files of their shuffles are removed now.

    Spark removes them once the driver's garbage collector has found their plans, and
    Python's the frames that hold those; a driver with little to do collects rarely,
    and the disks fill meanwhile.
    """
    for _ in range(2):  # what the first round lets go of, the second one finds
        gc.collect()
        spark._jvm.System.gc()
        time.sleep(0.1)


def small_batches(spark: SparkSession, rows: int = ARROW_ROWS) -> None:
    """Bound the rows of one Arrow batch for this session (never raise the bound)."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key, "10000")) > rows:
        spark.conf.set(key, str(rows))


def _bit(key: Column) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(BITMAP_BITS)) + 1


def bitmap_of(keys: DataFrame, key: str, name: str) -> DataFrame:
    """(bucket, bits): which hashes of ``key`` occur, as at most ``BITMAP_BITS / 32768`` rows of 4 KB."""
    bit = _bit(keys[key])
    rows = keys.select(F.bitmap_bucket_number(bit).alias("bucket"), F.bitmap_bit_position(bit).alias("at")).distinct()
    return durable(rows.groupBy("bucket").agg(F.bitmap_construct_agg("at").alias("bits")), name)


def with_hit(df: DataFrame, key: Column, bitmap: DataFrame, hit: str) -> DataFrame:
    """Add a boolean column: false only where ``key`` is surely not among the bitmap's keys.

    The bitmap is broadcast, which its fixed size allows; fuller bitmaps only give
    more false hits, so whoever calls this must settle the hits exactly.
    """
    bit = _bit(key)
    place = F.bitmap_bit_position(bit)
    byte = F.conv(F.hex(F.substring(bitmap["bits"], (F.shiftright(place, 3) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    found = df.join(F.broadcast(bitmap), F.bitmap_bucket_number(bit) == bitmap["bucket"], "left")
    return found.select(*[df[c] for c in df.columns], F.coalesce(F.getbit(byte, (place % 8).cast("int")) == 1, F.lit(False)).alias(hit))


def need(df: DataFrame, **columns: str) -> DataFrame:
    """Select the named input columns, cast, under the operator's own names.

    ``need(docs, doc_id="long", text="string")``; a name may differ from the
    input's by ``own="input:type"``.  Other columns are left behind.
    """
    picked = []
    for own, spec in columns.items():
        source, _, kind = spec.rpartition(":")
        picked.append(df[source or own].cast(kind).alias(own))
    return df.select(*picked)


def hex_join(spans: Column) -> Column:
    """Lower-case SHA-256 of an already joined string column."""
    return F.sha2(F.coalesce(spans, F.lit("")), 256)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
