"""Mixing sources to target weights by distributed prefix sums.

Each row gets a hash-random key; within its source rows are ordered by that key,
in ranges of the key space, so that no task has a whole source.  Sums per range
are added up first (a few rows a source), then within each range; a source's
budget is cut exactly at its place in that order.  A budget above the source's
size repeats whole epochs before the cut.

Defined results: a null text has size 0; a null source is a source of its own and
comes last; sources of size 0 get target 0; a null ``doc_id`` hashes as an empty
string; repeated rows are rows like any other; an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import durable, need, table

WORD = r"[^\x20\x09-\x0D]+"
#: Weights by place of the source in code point order, repeated.
WEIGHTS = (5, 2, 1)
#: A source's target stops at this many times its size.
MAX_EPOCHS = 3
#: Rows that one range of the key space should have.
RANGE_ROWS = 20_000


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def hash_key(row_key: Column, seed: str) -> Column:
    """The hash-random key that orders rows within their source."""
    return F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(row_key, F.lit(""))))


def source_targets(sizes: DataFrame, weights=WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """(source, source_size, target) from rows of (source, size).

    Targets share the sum of all sizes by weight.  A target above
    ``max_epochs * source_size`` stops there and the excess goes to the others by
    weight.  The sources that stop are those with the smallest cap per weight, so
    one ordered pass over the source totals finds them.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    place = (F.row_number().over(by_name) - 1) % len(weights)
    cap = F.col("source_size") * F.lit(max_epochs)
    per = per.withColumn("w", F.element_at(F.array(*map(F.lit, weights)), (place + 1).cast("int")).cast("long")).withColumn("cap", cap)
    by_fill = Window.orderBy((F.col("cap") / F.col("w")).asc(), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing).orderBy(F.lit(0))
    per = (
        per.withColumn("cap_before", F.coalesce(F.sum("cap").over(by_fill), F.lit(0)))
        .withColumn("w_before", F.coalesce(F.sum("w").over(by_fill), F.lit(0)))
        .withColumn("all_size", F.sum("source_size").over(whole))
        .withColumn("all_w", F.sum("w").over(whole))
    )
    level = (F.col("all_size") - F.col("cap_before")).cast("double") / (F.col("all_w") - F.col("w_before")).cast("double")
    per = per.withColumn("capped", F.col("cap").cast("double") <= F.col("w").cast("double") * level)
    per = per.withColumn("level", F.min(F.when(~F.col("capped"), F.struct(F.col("w_before"), level.alias("v")))).over(whole)["v"])
    target = F.when(F.col("capped"), F.col("cap").cast("double")).otherwise(F.col("w").cast("double") * F.col("level"))
    return per.select("source", "source_size", target.alias("target"))


def mix(rows: DataFrame, seed: str = "mix", weights=WEIGHTS, max_epochs: int = MAX_EPOCHS, range_rows: int = RANGE_ROWS) -> DataFrame:
    """Add ``source_size``, ``target``, ``before``, ``epochs`` and ``taken`` to (row_key, source, size, ...).

    ``taken`` counts the words that the mix takes of the row, repeats counted;
    the row at the cut is taken in part.  ``row_key`` is a string that orders rows
    by its hash; equal keys are ordered by size.
    """
    spark = rows.sparkSession
    rows = durable(rows.withColumn("h", hash_key(F.col("row_key"), seed)), "mix-sizes")
    n = rows.count()
    digits = 1
    while 16**digits * range_rows < n:
        digits += 1
    rows = rows.withColumn("r", F.substring("h", 1, digits))
    targets = durable(source_targets(rows, weights, max_epochs), "mix-targets")
    ranges = rows.groupBy("source", "r").agg(F.sum("size").alias("range_size"))
    earlier = Window.partitionBy("source").orderBy("r").rowsBetween(Window.unboundedPreceding, -1)
    ranges = durable(ranges.select("source", "r", F.coalesce(F.sum("range_size").over(earlier), F.lit(0)).alias("range_before")), "mix-ranges")
    inside = Window.partitionBy("source", "r").orderBy("h", "size").rowsBetween(Window.unboundedPreceding, -1)
    out = rows.withColumn("in_range", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    ranges, targets = ranges.alias("g"), targets.alias("t")
    out = out.join(ranges, out["source"].eqNullSafe(F.col("g.source")) & (out["r"] == F.col("g.r"))).select(*[out[c] for c in out.columns if c != "r"], "g.range_before")
    out = out.join(targets, out["source"].eqNullSafe(F.col("t.source"))).select(*[out[c] for c in out.columns], "t.source_size", "t.target")
    budget = F.floor("target").cast("long")
    full = F.when(F.col("source_size") > 0, F.expr("floor(target) div source_size")).otherwise(F.lit(0)).cast("long")
    out = out.withColumn("before", F.col("range_before") + F.col("in_range")).withColumn("epochs", full)
    rest = budget - F.col("epochs") * F.col("source_size") - F.col("before")
    part = F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), rest))
    return out.withColumn("taken", F.col("epochs") * F.col("size") + part).drop("h", "range_before", "in_range")


def mix_documents(docs: DataFrame, seed: str = "mix", **options) -> DataFrame:
    """The mixed documents, whole: each row as often as the mix takes it.

    All columns stay.  The row at a source's cut is taken once more when at least
    half of it lies within the budget, so a source's words miss its target by at
    most half of one document.  Rows up to the cut are known by their own key, so
    the documents meet one row a source and are not shuffled.  Repeated rows share
    one key and are taken alike, up to the next whole epoch; rows without words are
    taken once.
    """
    row_key = lambda doc_id, text: F.concat_ws(":", F.coalesce(doc_id.cast("string"), F.lit("")), F.md5(F.coalesce(text, F.lit(""))))
    sized = need(docs, source="string", text="string", doc_id="long").select(row_key(F.col("doc_id"), F.col("text")).alias("row_key"), "source", word_count(F.col("text")).alias("size"))
    mixed = mix(sized, seed, **options)
    part = F.col("taken") - F.col("epochs") * F.col("size")
    last = F.max(F.when((part > 0) & (part * 2 >= F.col("size")), hash_key(F.col("row_key"), seed)))
    cuts = durable(mixed.groupBy("source").agg(F.max("epochs").alias("epochs"), last.alias("last")), "mix-cuts").alias("p")
    own = hash_key(row_key(docs["doc_id"], docs["text"]), seed)
    again = F.coalesce(own <= F.col("p.last"), F.lit(False)).cast("int")
    wordless = ~F.coalesce(docs["text"].cast("string").rlike(WORD), F.lit(False))
    times = F.when(wordless, F.lit(1)).otherwise(F.col("p.epochs").cast("int") + again)
    joined = docs.alias("d").join(cuts, docs["source"].cast("string").eqNullSafe(F.col("p.source")))
    rows = joined.select(F.struct(*(docs[c] for c in docs.columns)).alias("row"), F.explode(F.array_repeat(F.lit(0), times)).alias("again"))
    return rows.select(*(F.col("row")[c].alias(c) for c in docs.columns))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = need(table(spark, sf_dir, "documents"), doc_id="long", source="string", text="string")
    rows = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), F.col("doc_id").cast("string").alias("row_key"))
    return mix(rows).select("doc_id", "size", "source_size", "target", "taken", "source", "epochs")


OP8_SQL = r"""
WITH docs AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
per AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM docs GROUP BY source),
w AS (SELECT *, CAST(CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS BIGINT) AS w, source_size * 3 AS cap FROM per),
f AS (SELECT *, coalesce(sum(cap) OVER (ORDER BY CAST(cap AS DOUBLE) / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS cap_before,
             coalesce(sum(w) OVER (ORDER BY CAST(cap AS DOUBLE) / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS w_before,
             sum(source_size) OVER () AS all_size, sum(w) OVER () AS all_w FROM w),
l AS (SELECT *, CAST(all_size - cap_before AS DOUBLE) / CAST(all_w - w_before AS DOUBLE) AS lv FROM f),
c AS (SELECT *, CAST(cap AS DOUBLE) <= w * lv AS capped FROM l),
t AS (SELECT source, source_size, CASE WHEN capped THEN CAST(cap AS DOUBLE)
        ELSE CAST(w AS DOUBLE) * (SELECT arg_min(lv, w_before) FROM c WHERE NOT capped) END AS target FROM c),
o AS (SELECT d.doc_id, d.size, d.source, t.source_size, t.target,
        coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.h, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
      FROM docs d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
e AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target) AS BIGINT) // source_size ELSE 0 END AS epochs FROM o)
SELECT doc_id, size, source_size, target,
  CAST(epochs * size + greatest(0, least(size, CAST(floor(target) AS BIGINT) - epochs * source_size - before)) AS BIGINT) AS taken,
  source, CAST(epochs AS BIGINT) AS epochs
FROM e
"""
