"""A corpus pipeline of five stages; each is written as Parquet before the next reads it.

Every stage reads all rows that its predecessor kept.  The first four return the
columns of ``documents`` as they came, further ones included, whatever their names.

Defined results: an empty table stays empty through all stages.
toxicity: a null or empty text scores 0 and stays; repeated rows go or stay together.
ngram_jaccard: of each class the row with the least id stays, of several with that id
the least row; rows with a null id all stay.
pii: a null text stays null; repeated rows are masked alike.
mixing: rows without words stay once; repeated rows of one id and text are taken alike;
a null source is a source of its own.
packing: a null or empty text is the end token alone; repeated rows are packed as rows
of their own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lodestone.llm import jaccard, mixing, packing, pii, toxicity
from lodestone.llm.common import durable, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.reject_toxic(docs, table(spark, sf_dir, "labels"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard.drop_near_copies(docs)


def sanitise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.sanitise(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs)


STAGES = [("toxicity", drop_toxic), ("ngram_jaccard", drop_near_copies), ("pii", sanitise), ("mixing", mix), ("packing", pack)]
#: Learned weights, random cuts and packing have no SQL form; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = durable(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
