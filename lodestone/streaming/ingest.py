"""Resumable and incremental processing."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..sources.tables import overwrite_vintage


def todo(every: DataFrame, done: DataFrame, id_: str) -> DataFrame:
    """What is left to do, by id and not by position."""
    return every.join(done.select(id_).distinct(), id_, "left_anti")


def resume(every: DataFrame, done_path: str, id_: str, work: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Work off what the table at ``done_path`` lacks, append it, and return the whole."""
    spark = every.sparkSession
    try:
        done = spark.read.parquet(done_path)
        rest = todo(every, done, id_)
    except Exception as e:  # noqa: BLE001
        if "PATH_NOT_FOUND" not in str(e):
            raise
        rest = every
    work(rest).write.mode("append").parquet(done_path)
    return spark.read.parquet(done_path)


def ingest_vintages(spark: SparkSession, folder: str, schema, target: str, checkpoint: str, vintage: str = "vintage") -> int:
    """Take in new files once, each vintage overwritten whole; returns the number of micro-batches."""
    stream = spark.readStream.schema(schema).parquet(folder)
    query = stream.writeStream.foreachBatch(lambda df, _: overwrite_vintage(df, target, vintage)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return len([p for p in query.recentProgress if p["numInputRows"]])
