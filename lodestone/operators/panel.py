"""Snapshot panels: spells, censoring, cardinality over time, activity states."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ordinals(df: DataFrame, period: str) -> DataFrame:
    """(period, ordinal) of the distinct periods, from 1."""
    return df.select(period).distinct().withColumn("ordinal", F.row_number().over(Window.orderBy(period)))


def spells(df: DataFrame, keys: list[str], period: str, ordinal: str) -> DataFrame:
    """Runs of consecutive ordinals with first, last, number seen and the spell's index."""
    rows = df.select(*keys, period, ordinal).distinct()
    by = Window.partitionBy(*keys).orderBy(ordinal)
    rows = rows.withColumn("_new", (F.coalesce(F.col(ordinal) - F.lag(ordinal).over(by), F.lit(0)) != 1).cast("int"))
    rows = rows.withColumn("spell_index", F.sum("_new").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy(*keys, "spell_index").agg(F.min(period).alias("first_seen"), F.max(period).alias("last_seen"), F.min(ordinal).alias("first_ordinal"), F.max(ordinal).alias("last_ordinal"), F.count(F.lit(1)).alias("n_seen"))


def censored(spell: DataFrame, periods: DataFrame, period: str) -> DataFrame:
    """Censoring flags, and the interval in which an observed end falls (its last period and the next one)."""
    ends = periods.agg(F.min("ordinal").alias("_lo"), F.max("ordinal").alias("_hi"))  # one row
    nxt = periods.select((F.col("ordinal") - 1).alias("last_ordinal"), F.col(period).alias("_next"))
    rows = spell.crossJoin(F.broadcast(ends)).join(nxt, "last_ordinal", "left")
    right = F.col("last_ordinal") == F.col("_hi")
    rows = rows.withColumn("left_censored", F.col("first_ordinal") == F.col("_lo")).withColumn("right_censored", right)
    rows = rows.withColumn("ended_between_start", F.when(~right, F.col("last_seen"))).withColumn("ended_between_end", F.when(~right, F.col("_next")))
    return rows.drop("_lo", "_hi", "_next")


def reentries(spell: DataFrame, keys: list[str]) -> DataFrame:
    return spell.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_spells")).filter("n_spells > 1")


def forward_fill(df: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    by = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(value, F.last(value, ignorenulls=True).over(by))


def fingerprints(df: DataFrame, period: str, measures: dict[str, Column]) -> DataFrame:
    """Per period its measures, and whether an earlier period has the same ones (a republication)."""
    per = df.groupBy(period).agg(*(m.alias(n) for n, m in measures.items()))
    return per.withColumn("republished", F.row_number().over(Window.partitionBy(*measures).orderBy(period)) > 1)


def set_change(df: DataFrame, entity: str, member: str, period: str) -> DataFrame:
    """(entity, gained, lost, kept) of members between an entity's first and last period."""
    ends = df.groupBy(entity).agg(F.min(period).alias("_a"), F.max(period).alias("_b"))
    rows = df.join(ends, entity).groupBy(entity, member).agg(F.bool_or(F.col(period) == F.col("_a")).alias("a"), F.bool_or(F.col(period) == F.col("_b")).alias("b"))
    n = lambda c: F.sum(c.cast("long"))
    return rows.groupBy(entity).agg(n(F.col("b") & ~F.col("a")).alias("gained"), n(F.col("a") & ~F.col("b")).alias("lost"), n(F.col("a") & F.col("b")).alias("kept"))


def observation_span(df: DataFrame, entity: str, period: str) -> DataFrame:
    return df.groupBy(entity).agg(F.min(period).alias("first"), F.max(period).alias("last"), F.count_distinct(period).alias("n_periods"))


def concurrent(df: DataFrame, entity: str, period: str, org: str) -> DataFrame:
    per = df.groupBy(entity, period).agg(F.count_distinct(org).alias("n_orgs"))
    return per.groupBy(entity).agg(F.max("n_orgs").alias("most_orgs"), F.sum((F.col("n_orgs") > 1).cast("long")).alias("periods_with_several"))


def activity_state(count: Column, ascertainable: Column) -> Column:
    """Observed, an ascertainable zero, or unknown; absence alone is never zero."""
    return F.when(count > 0, "observed").when(F.coalesce(ascertainable, F.lit(False)), "ascertainable_zero").otherwise("unknown")


def effective_share(df: DataFrame, entity: str, place: str, volume: str, full: float = 100.0) -> DataFrame:
    """(entity, place, share, fte): share of the entity's volume, and min(volume / full, 1) dealt by it."""
    total = F.sum(volume).over(Window.partitionBy(entity))
    per = df.groupBy(entity, place).agg(F.sum(volume).alias(volume))
    per = per.withColumn("total", total).withColumn("share", F.when(F.col("total") > 0, F.col(volume) / F.col("total")))
    return per.select(entity, place, "share", (F.least(F.col("total") / full, F.lit(1.0)) * F.col("share")).alias("fte"))


def modal(df: DataFrame, entity: str, value: str, weight: str) -> DataFrame:
    """The value with the greatest summed weight, ties to the smaller value."""
    per = df.groupBy(entity, value).agg(F.sum(weight).alias("w"))
    place = F.row_number().over(Window.partitionBy(entity).orderBy(F.col("w").desc(), F.col(value).asc()))
    return per.withColumn("_n", place).filter("_n = 1").select(entity, value)


def cohort_projection(spark, start: float, inflow: float, exit_rate: float, years: list[int]) -> DataFrame:
    """Stock and flow by year: stock' = stock - exits + inflow (a short driver recurrence)."""
    rows, stock = [], float(start)
    for y in years:
        exits = stock * exit_rate
        rows.append((y, stock, exits, float(inflow), stock - exits + inflow))
        stock = rows[-1][4]
    return spark.createDataFrame(rows, "year int, opening double, exits double, entries double, closing double")
