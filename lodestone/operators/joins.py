"""Joins with contracts: keys, coverage and fan-out are checked, null keys never match.

Each check is one aggregate over keys only; payload columns are not read for it.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


#: Ids with the same rows that are spread together.
PACK = 1024


class ContractError(ValueError):
    """A join, key or set contract does not hold."""


@dataclass(frozen=True)
class Coverage:
    left_rows: int
    matched_rows: int
    out_rows: int

    @property
    def share(self) -> float:
        return self.matched_rows / self.left_rows if self.left_rows else 1.0

    @property
    def fan_out(self) -> float:
        return self.out_rows / self.left_rows if self.left_rows else 1.0


def harmonise(left: DataFrame, right: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """Cast keys of different types to text on both sides."""
    for k in keys:
        if left.schema[k].dataType != right.schema[k].dataType:
            left, right = left.withColumn(k, left[k].cast("string")), right.withColumn(k, right[k].cast("string"))
    return left, right


def key_problems(df: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, rows, payloads) of keys with several rows; payloads counts distinct other columns."""
    rest = [c for c in df.columns if c not in keys]
    payload = F.count_distinct(F.to_json(F.struct(*rest))) if rest else F.lit(1).cast("long")
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows"), payload.alias("payloads")).filter("rows > 1")


def assert_unique(df: DataFrame, keys: list[str], dedupe: bool = False) -> DataFrame:
    """The frame, with equal rows merged when ``dedupe``; conflicting payloads are always an error."""
    bad = key_problems(df, keys).agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum((F.col("payloads") > 1).cast("int")), F.lit(0)).alias("conflicts")).first()
    if bad["n"] and (not dedupe or bad["conflicts"]):
        raise ContractError(f"{bad['n']} keys of {keys} are not unique, {bad['conflicts']} with conflicting rows")
    return df.distinct() if bad["n"] else df


def coverage(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """One row: left_rows, matched_rows, coverage, out_rows, fan_out of a left join, from keys alone."""
    left, right = harmonise(left.select(*keys), right.select(*keys), keys)
    n = right.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    joined = left.join(n, keys, "left")
    sums = joined.agg(
        F.count(F.lit(1)).alias("left_rows"),
        F.coalesce(F.sum(F.col("_n").isNotNull().cast("long")), F.lit(0)).cast("long").alias("matched_rows"),
        F.coalesce(F.sum(F.coalesce("_n", F.lit(1))), F.lit(0)).cast("long").alias("out_rows"),
    )
    share = lambda c: F.when(F.col("left_rows") == 0, F.lit(1.0)).otherwise(F.col(c) / F.col("left_rows"))
    return sums.withColumn("coverage", share("matched_rows")).withColumn("fan_out", share("out_rows"))


def report(left: DataFrame, right: DataFrame, keys: list[str]) -> Coverage:
    r = coverage(left, right, keys).first()
    return Coverage(r["left_rows"], r["matched_rows"], r["out_rows"])


@dataclass(frozen=True)
class Joined:
    """A checked join's rows, its coverage, and a report of the left keys that found nothing."""

    rows: DataFrame
    coverage: Coverage
    unmatched: DataFrame


def _checked(how: str, left: DataFrame, right: DataFrame, keys: list[str], bounds: list[tuple[str, bool]], r: Coverage) -> Joined:
    if broken := [text for text, holds in bounds if not holds]:
        raise ContractError(f"{how} join on {keys}: {'; '.join(broken)}")
    return Joined(left.join(right, keys, how), r, unmatched_keys(left, right, keys))


def checked_left_join(left: DataFrame, right: DataFrame, keys: list[str], min_coverage: float = 0.98, max_fan_out: float = 1.02, unique_right: bool = True, max_unmatched: int | None = None) -> Joined:
    """Left join with a unique right side, a least coverage, a bounded fan-out and a bound on unmatched rows."""
    left, right = harmonise(left, right, keys)
    if unique_right:
        assert_unique(right, keys)
    r = report(left, right, keys)
    lost = r.left_rows - r.matched_rows
    bounds = [
        (f"coverage {r.share:.4f}, at least {min_coverage}", r.share >= min_coverage),
        (f"fan-out {r.fan_out:.4f}, at most {max_fan_out}", r.fan_out <= max_fan_out),
        (f"{lost} unmatched rows, at most {max_unmatched}", max_unmatched is None or lost <= max_unmatched),
    ]
    return _checked("left", left, right, keys, bounds, r)


def checked_inner_join(left: DataFrame, right: DataFrame, keys: list[str], min_coverage: float = 0.90, unique_left: bool = True) -> Joined:
    """Inner join, unique on the right (and the left), with a least share of left rows matched."""
    left, right = harmonise(left, right, keys)
    if unique_left:
        assert_unique(left.select(*keys), keys)
    assert_unique(right, keys)
    r = report(left, right, keys)
    return _checked("inner", left, right, keys, [(f"coverage {r.share:.4f}, at least {min_coverage}", r.share >= min_coverage)], r)


def checked_semi_join(left: DataFrame, right: DataFrame, keys: list[str], min_kept: float = 0.50) -> Joined:
    left, right = harmonise(left, right, keys)
    r = report(left, right.select(*keys).distinct(), keys)
    return _checked("left_semi", left, right, keys, [(f"kept {r.share:.4f}, at least {min_kept}", r.share >= min_kept)], r)


def checked_anti_join(left: DataFrame, right: DataFrame, keys: list[str], max_matched: float = 0.50) -> Joined:
    left, right = harmonise(left, right, keys)
    r = report(left, right.select(*keys).distinct(), keys)
    return _checked("left_anti", left, right, keys, [(f"matched {r.share:.4f}, at most {max_matched}", r.share <= max_matched)], r)


def left_join(left: DataFrame, right: DataFrame, keys: list[str], **bounds) -> DataFrame:
    return checked_left_join(left, right, keys, **bounds).rows


def inner_join(left: DataFrame, right: DataFrame, keys: list[str], **bounds) -> DataFrame:
    return checked_inner_join(left, right, keys, **bounds).rows


def semi_join(left: DataFrame, right: DataFrame, keys: list[str], **bounds) -> DataFrame:
    return checked_semi_join(left, right, keys, **bounds).rows


def anti_join(left: DataFrame, right: DataFrame, keys: list[str], **bounds) -> DataFrame:
    return checked_anti_join(left, right, keys, **bounds).rows


def coverage_report(left: DataFrame, right: DataFrame, keys: list[str], warn=None) -> Coverage:
    """Coverage before a join; a share of nothing is worth a warning, one above all is an error."""
    r = report(left, right, keys)
    if r.share > 1:
        raise ContractError(f"{r.matched_rows} of {r.left_rows} rows matched on {keys}")
    if warn is not None and r.left_rows and not r.matched_rows:
        warn(f"no row of {r.left_rows} matched on {keys}")
    return r


def lookup(left: DataFrame, right: DataFrame, keys: list[str], max_bytes: int = 64 << 20) -> DataFrame:
    """Left join with a small table, broadcast only where Catalyst's own estimate of its size is within ``max_bytes``."""
    size = int(str(right._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return left.join(F.broadcast(right) if size <= max_bytes else right, keys, "left")


def unmatched_keys(left: DataFrame, right: DataFrame, keys: list[str], limit: int = 5000) -> DataFrame:
    """Distinct unmatched keys for a report, in key order."""
    return left.select(*keys).distinct().join(right.select(*keys), keys, "left_anti").orderBy(*keys).limit(limit)


def join_renamed(left: DataFrame, right: DataFrame, keys: dict[str, str], how: str = "left") -> DataFrame:
    """Join on keys whose names differ (left to right); the left's names stay."""
    return left.join(right.withColumnsRenamed({r: l for l, r in keys.items()}), list(keys), how)


def with_membership(left: DataFrame, right: DataFrame, keys: list[str], name: str) -> DataFrame:
    """Add whether a row's key is in the other table."""
    there = right.select(*keys).distinct().withColumn("_in", F.lit(True))
    return left.join(there, keys, "left").withColumn(name, F.coalesce("_in", F.lit(False))).drop("_in")


def alike(df: DataFrame, id_: str, columns: list[str]) -> tuple[DataFrame, DataFrame]:
    """(rows, members): the rows of one id of each group whose rows are the same in ``columns``, and (id, rep, n) of every id.

    ``rep`` is the least id of the group and stands for its ``n`` ids; repeated rows
    count. A missing id is a group of its own.
    """
    own, groups = _groups(df, id_, columns)
    rows = groups.select(F.col("rep").alias(id_), F.explode("_rows").alias("_row")).select(id_, "_row.*")
    return rows, own.join(groups, ["_rows", "_none"]).select(id_, "rep", "n")


def stand_ins(df: DataFrame, id_: str, columns: list[str]) -> DataFrame:
    """The rows of ``alike``, each with ``n``, the number of ids that it stands for."""
    _, groups = _groups(df, id_, columns)
    return groups.select(F.col("rep").alias(id_), "n", F.explode("_rows").alias("_row")).select(id_, "n", "_row.*")


def _groups(df: DataFrame, id_: str, columns: list[str]) -> tuple[DataFrame, DataFrame]:
    own = df.groupBy(id_).agg(F.sort_array(F.collect_list(F.struct(*columns))).alias("_rows")).withColumn("_none", F.col(id_).isNull())
    return own, own.groupBy("_rows", "_none").agg(F.min(id_).alias("rep"), F.count(F.lit(1)).alias("n"))


def each(rows: DataFrame, members: DataFrame, id_: str) -> DataFrame:
    """What was found for the ids that stand for others, for all ids."""
    found = rows.withColumnRenamed(id_, "_rep")
    return members.select(id_, "rep").join(found, F.col("rep").eqNullSafe(F.col("_rep"))).select(*rows.columns)


def spread(pairs: DataFrame, left: DataFrame, right: DataFrame, ids: tuple[str, str]) -> DataFrame:
    """Pairs of ids that stand for others, as all pairs of the ids they stand for.

    Members travel in packs, and pairs of packs are dealt to all tasks, so no pair of
    ids is shuffled and no large group is one task's work.
    """

    def packs(members: DataFrame, own: str) -> DataFrame:
        part = F.pmod(F.xxhash64(own), F.ceil(F.col("n") / PACK))
        return members.groupBy(F.col("rep").alias(f"_rep_{own}"), part.alias(f"_part_{own}")).agg(F.collect_list(own).alias(f"_ids_{own}"))

    wide = pairs
    for members, own in zip((left, right), ids, strict=True):
        wide = wide.join(packs(members, own), F.col(own).eqNullSafe(F.col(f"_rep_{own}"))).drop(own)
    tasks = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    wide = wide.repartition(tasks, *(f"_{c}_{own}" for own in ids for c in ("rep", "part")))
    for own in ids:
        wide = wide.withColumn(own, F.explode_outer(f"_ids_{own}")).drop(f"_ids_{own}")  # a missing id is an empty pack
    return wide.select(*pairs.columns)


def token_join(left: DataFrame, right: DataFrame, tokens: str, exact: list[str], ids: tuple[str, str]) -> DataFrame:
    """Distinct id pairs that share a token of the array column and all ``exact`` columns.

    Ids with the same tokens and columns are joined once and only then spread.
    """
    (left, a_ids), (right, b_ids) = alike(left, ids[0], [*exact, tokens]), alike(right, ids[1], [*exact, tokens])
    a = left.select(ids[0], *exact, F.explode(tokens).alias("_token"))
    b = right.select(ids[1], *exact, F.explode(tokens).alias("_token"))
    return spread(a.join(b, [*exact, "_token"]).select(*ids).distinct(), a_ids, b_ids, ids)


def _segment(length: Column, i: Column, parts: int) -> tuple[Column, Column]:
    """(start from 0, size) of part ``i`` of a text cut into ``parts`` nearly equal ones, the longer ones last."""
    base, longer = F.floor(length / parts).cast("int"), length % parts
    return i * base + F.greatest(F.lit(0), i - (parts - longer)), base + (i >= parts - longer).cast("int")


def edit_index(x: Column, most: int) -> Column:
    """Keys of a text: of its ``most + 1`` parts one at least stands unchanged in any text that is ``most`` edits away."""
    n = F.length(x)

    def key(i: Column) -> Column:
        start, size = _segment(n, i, most + 1)
        return F.struct(n.alias("n"), i.alias("i"), F.substring(x, start + 1, size).alias("part"))

    return F.transform(F.sequence(F.lit(0), F.lit(most)), key)


def edit_probes(x: Column, most: int) -> Column:
    """Keys under which a text finds the ones that ``edit_index`` lists within ``most`` edits.

    A part moves by as many places as letters were put in before it; those and the
    ones after it, by the difference of lengths, are ``most`` together.
    """
    shifts = F.array(*(F.struct(F.lit(d).alias("d"), F.lit(s).alias("s")) for d in range(-most, most + 1) for s in range(-most, most + 1) if abs(s) + abs(d - s) <= most))

    def key(shift: Column, i: Column) -> Column:
        n = F.length(x) - shift["d"]
        start, size = _segment(n, i, most + 1)
        at = start + shift["s"]
        fits = (n > 0) & (at >= 0) & (at + size <= F.length(x))
        return F.when(fits, F.struct(n.alias("n"), i.alias("i"), F.substring(x, at + 1, size).alias("part")))

    each = F.flatten(F.transform(shifts, lambda s: F.transform(F.sequence(F.lit(0), F.lit(most)), lambda i: key(s, i))))
    return F.array_distinct(F.filter(each, lambda k: k.isNotNull()))


def near_texts(left: DataFrame, right: DataFrame, text: tuple[str, str], exact: list[str], most: int = 2, least_length: int = 5) -> DataFrame:
    """(exact, text of the left, text of the right): distinct texts 1 to ``most`` edits apart, found by shared parts."""
    a = left.filter(F.length(text[0]) >= least_length).select(*exact, text[0]).distinct().withColumn("_k", F.explode(edit_index(F.col(text[0]), most)))
    b = right.filter(F.length(text[1]) >= least_length - most).select(*exact, text[1]).distinct().withColumn("_k", F.explode(edit_probes(F.col(text[1]), most)))
    near = F.levenshtein(text[0], text[1], most).between(1, most)
    return a.join(b, [*exact, "_k"]).filter(near).select(*exact, *text).distinct()


def edit_join(left: DataFrame, right: DataFrame, text: tuple[str, str], exact: list[str], most: int = 2, least_length: int = 5) -> DataFrame:
    """Pairs with equal ``exact`` columns and texts 1 to ``most`` edits apart, both of ``least_length``.

    The texts are compared once each, however many rows have them.
    """
    near = near_texts(left, right, text, exact, most, least_length).filter(F.length(text[1]) >= least_length)
    return left.join(near, [*exact, text[0]]).join(right, [*exact, text[1]])


def ordered_pairs(df: DataFrame, key: str, source: str, *carry: str) -> DataFrame:
    """Self join on ``key`` with source_a < source_b."""
    side = lambda s: df.select(key, *(F.col(c).alias(f"{c}_{s}") for c in (source, *carry)))
    return side("a").join(side("b"), key).filter(F.col(f"{source}_a") < F.col(f"{source}_b"))


def cascade_join(left: DataFrame, steps: list[tuple[DataFrame, list[str], str]], value: str) -> DataFrame:
    """Fill ``value`` and its source from several lookups, the first that has it wins."""
    found, how = F.lit(None).cast("string"), F.lit(None).cast("string")
    for k, (lookup, keys, label) in enumerate(steps):
        left = left.join(lookup.select(*keys, F.col(value).cast("string").alias(f"_v{k}")), keys, "left")
        found, how = F.coalesce(found, F.col(f"_v{k}")), F.coalesce(how, F.when(F.col(f"_v{k}").isNotNull(), label))
    return left.withColumn(value, found).withColumn(f"{value}_source", how).drop(*(f"_v{k}" for k in range(len(steps))))
