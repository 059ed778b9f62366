"""Assertions over tables: each gives rows of (rule, n, ok), or raises when asked to."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .joins import ContractError


def rule_counts(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """(rule, n, ok): the rows that break each rule, in one aggregate; a rule that is null is broken."""
    per = df.agg(*(F.count_if(~F.coalesce(ok, F.lit(False))).alias(name) for name, ok in rules.items()))
    rows = per.unpivot([], list(rules), "rule", "n")
    return rows.withColumn("ok", F.col("n") == 0)


def invariants(spine: DataFrame, table: DataFrame, id_: str, exclusive: dict[str, Column] | None = None) -> DataFrame:
    """(rule, n, ok): the table has the spine's rows and ids, each once, and each row fits one of the exclusive classes.

    Keys are counted on both sides in one aggregate; n is the number of ids or rows at fault.
    """
    keys = spine.select(id_, F.lit(1).alias("a"), F.lit(0).alias("b")).unionByName(table.select(id_, F.lit(0).alias("a"), F.lit(1).alias("b")))
    per = keys.groupBy(id_).agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    out = rule_counts(per, {"same_ids": (F.col("a") > 0) == (F.col("b") > 0), "same_rows": F.col("a") == F.col("b"), "unique": F.col("b") <= 1})
    if exclusive:
        fits = reduce(lambda x, y: x + y, (F.coalesce(c, F.lit(False)).cast("int") for c in exclusive.values()))
        out = out.unionByName(rule_counts(table, {"one_class": fits == 1}))
    return out


def table_rules(num: str, den: str, pct: str) -> dict[str, Column]:
    return {"pct_in_range": F.col(pct).isNull() | F.col(pct).between(0, 100), "num_within_den": F.col(num) <= F.col(den), "not_negative": (F.col(num) >= 0) & (F.col(den) >= 0)}


def strata_sum(parts: DataFrame, whole: DataFrame, keys: list[str], n: str) -> DataFrame:
    """(keys, parts, whole, ok): sums of strata against the totals that they should make."""
    a, b = parts.groupBy(*keys).agg(F.sum(n).alias("parts")), whole.groupBy(*keys).agg(F.sum(n).alias("whole"))
    return a.join(b, keys, "full").select(*keys, F.coalesce("parts", F.lit(0)).alias("parts"), F.coalesce("whole", F.lit(0)).alias("whole")).withColumn("ok", F.col("parts") == F.col("whole"))


def conserved(before: DataFrame, after: DataFrame, columns: list[str]) -> DataFrame:
    """(value columns, before, after): rows of distinct values whose number changed; empty where all is conserved."""
    both = before.select(*columns, F.lit(1).alias("a"), F.lit(0).alias("b")).unionByName(after.select(*columns, F.lit(0).alias("a"), F.lit(1).alias("b")))
    return both.groupBy(*columns).agg(F.sum("a").alias("before"), F.sum("b").alias("after")).filter("before <> after")


def set_partition(whole: DataFrame, parts: dict[str, DataFrame], id_: str) -> DataFrame:
    """(rule, n, ok): the parts cover the whole, none has an id of another or one from outside."""
    sides = [whole.select(id_, F.lit(1).alias("w"), F.lit(0).alias("p"))] + [p.select(id_).distinct().select(id_, F.lit(0).alias("w"), F.lit(1).alias("p")) for p in parts.values()]
    per = reduce(DataFrame.unionByName, sides).groupBy(id_).agg(F.max("w").alias("w"), F.sum("p").alias("p"))
    return rule_counts(per, {"covered": (F.col("w") == 0) | (F.col("p") > 0), "disjoint": F.col("p") <= 1, "inside": F.col("w") == 1})


def non_constant(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, values) of each column's distinct values, up to two: a column of one value tells nothing."""
    low, high = (lambda c: F.min(F.col(c).cast("string"))), (lambda c: F.max(F.col(c).cast("string")))
    per = df.agg(*(F.when(low(c).isNull(), 0).when(low(c) == high(c), 1).otherwise(2).alias(c) for c in columns))
    return per.unpivot([], columns, "column", "values")


def completeness(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, filled, rows) of each column."""
    per = df.agg(F.count(F.lit(1)).alias("rows"), *(F.count(c).alias(c) for c in columns))
    return per.unpivot(["rows"], columns, "column", "filled").select("column", "filled", "rows")


def enforce(rules: DataFrame) -> None:
    """Raise if a rule of (rule, n, ok) is broken."""
    if broken := [f"{r['rule']} ({r['n']})" for r in rules.filter("NOT ok").collect()]:  # a row a rule
        raise ContractError("broken: " + ", ".join(broken))


def reject_constant(df: DataFrame, columns: list[str]) -> DataFrame:
    if dull := [r["column"] for r in non_constant(df, columns).filter("values < 2").collect()]:  # a row a column
        raise ContractError(f"constant columns {dull}")
    return df
