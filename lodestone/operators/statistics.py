"""Rates, intervals and summary tables."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

Z = 1.959963984540054


def wilson(k: Column, n: Column, z: float = Z) -> tuple[Column, Column]:
    """Bounds of the Wilson interval; null without observations."""
    p, zz = k / n, z * z
    centre, half, scale = p + zz / (2 * n), z * F.sqrt(p * (1 - p) / n + zz / (4 * n * n)), 1 + zz / n
    some = n > 0
    return F.when(some, (centre - half) / scale), F.when(some, (centre + half) / scale)


def ppv(df: DataFrame, stratum: str, correct: str, gate: float = 0.90) -> DataFrame:
    """Predictive value by stratum, whether its lower bound passes the gate."""
    per = df.filter(F.col(correct).isNotNull()).groupBy(stratum).agg(F.sum(F.col(correct).cast("long")).alias("k"), F.count(F.lit(1)).alias("n"))
    low, high = wilson(F.col("k"), F.col("n"))
    return per.select(stratum, "k", "n", (F.col("k") / F.col("n")).alias("ppv"), low.alias("low"), high.alias("high"), (low >= gate).alias("passes"))


def smd_continuous(df: DataFrame, group: Column, value: str) -> DataFrame:
    on = lambda g: F.when(group == g, F.col(value))
    return df.agg(((F.avg(on(True)) - F.avg(on(False))) / F.sqrt((F.var_samp(on(True)) + F.var_samp(on(False))) / 2)).alias("smd"))


def smd_binary(df: DataFrame, group: Column, flag: Column) -> DataFrame:
    on = lambda g: F.avg(F.when(group == g, flag.cast("double")))
    p = df.agg(on(True).alias("p"), on(False).alias("q"))
    return p.select(((F.col("p") - F.col("q")) / F.sqrt((F.col("p") * (1 - F.col("p")) + F.col("q") * (1 - F.col("q"))) / 2)).alias("smd"))


def ols(df: DataFrame, y: str, x: str) -> DataFrame:
    return df.agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.regr_r2(y, x).alias("r2"), F.regr_count(y, x).alias("n"))


def impute_linear(df: DataFrame, y: str, x: str) -> DataFrame:
    """Fill missing y from the fit on complete rows; ``imputed`` tells which."""
    fit = ols(df, y, x)  # one row
    guess = F.col("slope") * F.col(x) + F.col("intercept")
    rows = df.crossJoin(F.broadcast(fit))
    return rows.withColumn("imputed", F.col(y).isNull() & guess.isNotNull()).withColumn(y, F.coalesce(y, guess)).drop("slope", "intercept", "r2", "n")


def logistic(df: DataFrame, label: str, features: list[str]):
    """Coefficients by name of a logistic regression."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler

    rows = VectorAssembler(inputCols=features, outputCol="_f", handleInvalid="skip").transform(df.filter(F.col(label).isNotNull()).withColumn("_y", F.col(label).cast("double")))
    model = LogisticRegression(featuresCol="_f", labelCol="_y").fit(rows)
    return {"(intercept)": model.intercept} | dict(zip(features, model.coefficients.tolist(), strict=True))


def fisher_exact(a: int, b: int, c: int, d: int) -> float:
    """Two-sided p value of a 2x2 table."""
    r, s, n = a + b, a + c, a + b + c + d
    log = lambda k: math.lgamma(r + 1) + math.lgamma(n - r + 1) + math.lgamma(s + 1) + math.lgamma(n - s + 1) - math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(r - k + 1) - math.lgamma(s - k + 1) - math.lgamma(n - r - s + k + 1)
    at = log(a)
    return min(1.0, sum(math.exp(p) for k in range(max(0, r + s - n), min(r, s) + 1) if (p := log(k)) <= at + 1e-7))


def ranged(df: DataFrame, value: str, steps: int = 9) -> DataFrame:
    """The rows with ``_range``: which of ``2 ** steps`` parts, cut at approximate quantiles, the value falls into.

    Cuts travel as one broadcast row and are searched by halves.
    """
    ranges = 1 << steps
    cuts = df.agg(F.percentile_approx(value, [i / ranges for i in range(1, ranges)], 10 * ranges).alias("_cuts"))  # one row
    halves = F.array(*(F.lit(1 << i) for i in reversed(range(steps))))
    place = F.aggregate(halves, F.lit(0), lambda at, half: F.when(F.get("_cuts", at + half - 1) <= F.col(value), at + half).otherwise(at))
    return df.crossJoin(F.broadcast(cuts)).withColumn("_range", place).drop("_cuts")


def _bases(rows: DataFrame, groups: list[str], n) -> DataFrame:
    """(groups, _range, _rows, _base): rows of each range, and of the ranges before it in its group."""
    earlier = Window.partitionBy(*groups).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    total = rows.groupBy(*groups, "_range").agg(n.alias("_rows"))
    return total.withColumn("_base", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)))


def counts_before(df: DataFrame, value: str, groups: list[str] | None = None, steps: int = 9) -> DataFrame:
    """(groups, value, n, before): rows of each distinct value, and rows of smaller ones in its group.

    Counts are summed for whole ranges (a few rows) and within each range, so no task
    has a whole column.
    """
    groups = groups or []
    per = ranged(df.filter(F.col(value).isNotNull()).groupBy(*groups, value).agg(F.count(F.lit(1)).alias("n")), value, steps)
    inside = Window.partitionBy(*groups, "_range").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    per = per.withColumn("_in", F.coalesce(F.sum("n").over(inside), F.lit(0)))
    return per.join(_bases(per, groups, F.sum("n")), [*groups, "_range"]).select(*groups, value, "n", (F.col("_base") + F.col("_in")).alias("before"))


def spearman(df: DataFrame, x: str, y: str) -> DataFrame:
    """Rank correlation with average ranks for ties, from counts of distinct values."""
    both = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).select(x, y)
    ranks = lambda c: counts_before(both, c).select(c, (F.col("before") + (F.col("n") + 1) / 2).alias(f"_r_{c}"))
    return both.join(ranks(x), x).join(ranks(y), y).agg(F.corr(f"_r_{x}", f"_r_{y}").alias("rho"))


def quantiles(df: DataFrame, value: str, points: dict[str, float], groups: list[str], steps: int = 9) -> DataFrame:
    """Exact quantiles by group, interpolated.

    Counts by range, summed on the map side, tell which ranges hold the wanted places;
    only the rows of those ranges are shuffled and put in order.
    """
    rows = ranged(df.filter(F.col(value).isNotNull()).select(*groups, value), value, steps)
    total = _bases(rows, groups, F.count(F.lit(1))).withColumn("_size", F.sum("_rows").over(Window.partitionBy(*groups)))
    places = {name: (F.col("_size") - 1) * q for name, q in points.items()}
    within = lambda p, low, n: (low <= p) & (p < low + n)
    some = F.lit(False)
    for at in places.values():
        some |= within(F.floor(at), F.col("_base"), F.col("_rows")) | within(F.ceil(at), F.col("_base"), F.col("_rows"))
    held = rows.join(total.filter(some).select(*groups, "_range", "_base", "_size"), [*groups, "_range"])
    per = held.groupBy(*groups, "_range", "_base", "_size", value).agg(F.count(F.lit(1)).alias("n"))
    inside = Window.partitionBy(*groups, "_range").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    per = per.withColumn("_before", F.col("_base") + F.coalesce(F.sum("n").over(inside), F.lit(0)))
    out = []
    for name, at in places.items():
        has = lambda p: F.max(F.when(within(p, F.col("_before"), F.col("n")), F.col(value)))
        low, high = has(F.floor(at)), has(F.ceil(at))
        out.append((low + (high - low) * F.max(at - F.floor(at))).alias(name))
    return per.groupBy(*groups).agg(*out)


def rate_with_floor(k: Column, n: Column, least: float, per: float = 1000.0) -> Column:
    return F.when(n >= least, k / n * per)


def difference_interval(k1: Column, n1: Column, k2: Column, n2: Column, z: float = Z) -> tuple[Column, Column, Column]:
    p, q = k1 / n1, k2 / n2
    half = z * F.sqrt(p * (1 - p) / n1 + q * (1 - q) / n2)
    return p - q, p - q - half, p - q + half


def table_block(df: DataFrame, variable: str, levels: list[str]) -> DataFrame:
    """Count and percent of known for ordered levels, and a row for unknown ones."""
    level = F.when(F.col(variable).isin(*levels), F.col(variable)).otherwise("Unknown")
    per = df.groupBy(level.alias("level")).agg(F.count(F.lit(1)).alias("n"))
    known = F.sum(F.when(F.col("level") != "Unknown", F.col("n"))).over(Window.partitionBy())
    place = F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, levels)), F.col("level")), F.lit(0)), F.lit(len(levels) + 1))
    return per.select(place.cast("int").alias("place"), "level", "n", F.when(F.col("level") != "Unknown", 100.0 * F.col("n") / known).alias("pct"))


def stratified_sample(df: DataFrame, stratum: str, id_: str, n: int, seed: str = "sample") -> DataFrame:
    """n rows of each stratum by seeded hash order, the same on every run."""
    order = F.md5(F.concat_ws(":", F.lit(seed), F.col(id_).cast("string")))
    place = F.row_number().over(Window.partitionBy(stratum).orderBy(order, F.col(id_)))
    return df.withColumn("_n", place).filter(F.col("_n") <= n).drop("_n")
