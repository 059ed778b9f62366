"""Resolution of organizations by several keys, with ambiguity kept apart."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .joins import alike, each


def key_candidates(left: DataFrame, right: DataFrame, families: dict[str, list[str]], id_: str, org: str, most: int | None = None) -> DataFrame:
    """(id, org, family) for each key family; null keys never match.

    The right side is one row a key and organization before the join; with ``most``,
    keys of more organizations are left out there, before they can multiply.
    """

    def one(name: str, keys: list[str]) -> DataFrame:
        orgs = right.select(org, *keys).distinct()
        if most is not None:
            orgs = orgs.join(orgs.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") <= most).drop("_n"), keys)
        return left.select(id_, *keys).distinct().join(orgs, keys).select(id_, org, F.lit(name).alias("family"))

    return reduce(DataFrame.unionByName, (one(n, k) for n, k in families.items()))


def cap_promiscuous(pairs: DataFrame, id_: str, most: int = 10) -> DataFrame:
    """Drop (id, family) groups that match more than ``most`` organizations."""
    n = F.count(F.lit(1)).over(Window.partitionBy(id_, "family"))
    return pairs.withColumn("_n", n).filter(F.col("_n") <= most).drop("_n")


def unique_key(pairs: DataFrame, id_: str, org: str, families: list[str]) -> DataFrame:
    rows = pairs.filter(F.col("family").isin(*families))
    return rows.groupBy(id_).agg(F.count_distinct(org).alias("n"), F.min(org).alias(org)).filter("n = 1").select(id_, org)


def multi_key(pairs: DataFrame, id_: str, org: str, least: int = 2) -> DataFrame:
    """The only organization that at least ``least`` key families agree on."""
    agreed = pairs.groupBy(id_, org).agg(F.count_distinct("family").alias("families")).filter(F.col("families") >= least)
    return agreed.groupBy(id_).agg(F.count(F.lit(1)).alias("n"), F.min(org).alias(org), F.min("families").alias("families")).filter("n = 1").select(id_, org, "families")


def resolve_tiers(pairs: DataFrame, id_: str, org: str, strong: list[str], weak: list[str], excluded: DataFrame | None = None, agreed: DataFrame | None = None, members: DataFrame | None = None) -> DataFrame:
    """(id, org, tier): unique strong key, agreement of keys, exclusion of classes, a second source, weak fallback; the first that decides.

    ``excluded`` has the organizations of unfit classes, ``agreed`` (id, org) pairs
    that another source supports.  All tiers come from one aggregate a pair and one an
    id: an organization is the only one where the least equals the greatest.  With
    ``members`` the pairs are those of stand-ins (``joins.alike``), results of all ids.
    """
    per = pairs.groupBy(id_, org).agg(F.count_distinct("family").alias("_families"), F.bool_or(F.col("family").isin(*strong)).alias("_strong"), F.bool_or(F.col("family").isin(*weak)).alias("_weak"))
    rules = {"unique_strong": F.col("_strong"), "multi_key": F.col("_families") >= 2}
    if excluded is not None:
        per = per.join(excluded.select(org).distinct().withColumn("_out", F.lit(True)), org, "left")
        rules["class_exclusion"] = F.col("_strong") & F.col("_out").isNull()
    rules["weak"] = F.col("_weak")
    ends = lambda rows, tiers: rows.groupBy(id_).agg(*(f(F.when(c, F.col(org))).alias(f"{n}_{t}") for t, c in tiers.items() for n, f in (("_low", F.min), ("_high", F.max))))
    out = ends(per, rules)
    out = out if members is None else each(out, members, id_)
    order = list(rules)
    if agreed is not None:
        order.insert(-1, "cross_source")
        rows, there = agreed.select(id_, org), per.select(F.col(id_).alias("_rep"), org)
        rows = rows.withColumn("_rep", F.col(id_)) if members is None else rows.join(members.select(id_, F.col("rep").alias("_rep")), id_)
        out = out.join(ends(rows.join(there, ["_rep", org], "left_semi"), {"cross_source": F.lit(True)}), id_, "left")
    sole = {t: F.col(f"_low_{t}") == F.col(f"_high_{t}") for t in order}
    tier = F.coalesce(*(F.when(ok, F.lit(t)) for t, ok in sole.items()))
    return out.select(id_, F.coalesce(*(F.when(ok, F.col(f"_low_{t}")) for t, ok in sole.items())).alias(org), tier.alias("tier")).filter("tier IS NOT NULL")


def address_status(left: DataFrame, right: DataFrame, keys: list[str], id_: str, org: str) -> DataFrame:
    """unique_exact, multiple_plausible or no_match for each id, with sorted distinct organizations."""
    rows, members = alike(left, id_, keys)  # ids with the same keys have the same organizations
    hits = rows.join(right, keys, "left").groupBy(id_).agg(F.array_sort(F.collect_set(org)).alias("orgs"))
    n = F.size("orgs")
    status = hits.select(id_, n.cast("long").alias("n"), F.when(n == 1, F.element_at("orgs", 1)).alias(org), F.when(n == 0, "no_match").when(n == 1, "unique_exact").otherwise("multiple_plausible").alias("status"), F.array_join(F.transform("orgs", lambda o: o.cast("string")), "|").alias("orgs"))
    return each(status, members, id_)


def precedence(pairs: DataFrame, id_: str, org: str, order: list[str]) -> DataFrame:
    """The best key family that matches: its only organization, or an ambiguity kept apart."""
    rank = reduce(lambda c, kf: c.when(F.col("family") == kf[1], kf[0]), enumerate(order, 1), F.when(F.lit(False), 0))
    rows = pairs.withColumn("rank", rank).withColumn("best", F.min("rank").over(Window.partitionBy(id_))).filter("rank = best")
    per = rows.groupBy(id_).agg(F.min("rank").alias("rank"), F.count_distinct(org).alias("n"), F.min(org).alias("_o"))
    return per.select(id_, "rank", "n", F.when(F.col("n") == 1, F.col("_o")).alias(org))


def without_deactivated(df: DataFrame, deactivated: str, reactivated: str) -> DataFrame:
    return df.filter(F.col(deactivated).isNull() | (F.col(reactivated).isNotNull() & (F.col(reactivated) >= F.col(deactivated))))


def rollup_arms(arms: DataFrame, keys: list[str], name: str, id_: str, evidence: str) -> DataFrame:
    """Pair rollup: longest name (ties to the smaller), sorted distinct ids, evidence range, number of arms."""
    return arms.groupBy(*keys).agg(
        F.min_by(name, F.struct(-F.length(name), F.col(name))).alias("name"),
        F.array_join(F.array_sort(F.collect_set(F.col(id_).cast("string"))), "|").alias("ids"),
        F.min(evidence).alias("least_evidence"),
        F.max(evidence).alias("most_evidence"),
        F.count_distinct("arm").alias("n_arms"),
    )


def suppress(value: Column, least: int = 11) -> tuple[Column, Column]:
    """(value or null, flag) of a small cell."""
    small = value < least
    return F.when(~small, value), F.coalesce(small, F.lit(False))


def share_within(df: DataFrame, group: str, n: str) -> DataFrame:
    return df.withColumn("share", 100.0 * F.col(n) / F.sum(n).over(Window.partitionBy(group)))


def best_level(df: DataFrame, entity: str, level: str, order: list[str]) -> DataFrame:
    rank = F.array_position(F.array(*map(F.lit, order)), F.col(level))
    best = df.filter(F.col(level).isin(*order)).groupBy(entity).agg(F.min(rank).alias("_r"))
    return best.select(entity, F.element_at(F.array(*map(F.lit, order)), F.col("_r").cast("int")).alias(level))


def cardinality_snapshot(df: DataFrame, a: str, b: str, period: str) -> DataFrame:
    """(period, a, b, n_b_for_a, n_a_for_b) of distinct pairs."""
    pairs = df.select(period, a, b).distinct()
    return pairs.withColumn("n_b_for_a", F.count(F.lit(1)).over(Window.partitionBy(period, a))).withColumn("n_a_for_b", F.count(F.lit(1)).over(Window.partitionBy(period, b)))


def cardinality_ever(snapshot: DataFrame, a: str, b: str, period: str) -> DataFrame:
    """Per pair: first and last seen, snapshots, whether ever unique or ambiguous, and the number at the latest one."""
    one = (F.col("n_b_for_a") == 1) & (F.col("n_a_for_b") == 1)
    return snapshot.groupBy(a, b).agg(F.min(period).alias("first_seen"), F.max(period).alias("last_seen"), F.count_distinct(period).alias("n_snapshots"), F.bool_or(one).alias("ever_unique"), F.bool_or(~one).alias("ever_ambiguous"), F.max_by("n_b_for_a", period).alias("n_b_at_latest"))


def cardinality_band(n: Column) -> Column:
    return F.when(n == 1, "1").when(n == 2, "2").when(n.between(3, 9), "3-9").when(n >= 10, "10+")


def coverage_matrix(spine: DataFrame, arms: dict[str, DataFrame], id_: str) -> DataFrame:
    """A boolean for each arm, their number and a class (none, single, several)."""
    out = spine.select(id_).distinct()
    for name, arm in arms.items():
        out = out.join(arm.select(id_).distinct().withColumn(name, F.lit(True)), id_, "left")
    flags = [F.coalesce(name, F.lit(False)).alias(name) for name in arms]
    out = out.select(id_, *flags)
    n = reduce(lambda x, y: x + y, (F.col(a).cast("int") for a in arms))
    return out.withColumn("n_arms", n).withColumn("class", F.when(n == 0, "none").when(n == 1, "single").otherwise("several"))


def affiliation_strength(identified: Column, solo: Column) -> Column:
    """What a reassignment to an organization shows."""
    return F.when(~F.coalesce(identified, F.lit(False)), "target_unidentified").when(F.coalesce(solo, F.lit(False)), "confirmed_solo_practitioner").otherwise("confirmed_billing")


def affiliation_classes(billing: dict[str, Column], place: dict[str, Column]) -> tuple[Column, Column]:
    """(class, layer) of the arms that support a pair: several, one by name, or unresolved; billing, place, or both."""
    arms = billing | place
    n = reduce(lambda x, y: x + y, (c.cast("int") for c in arms.values()))
    one = F.when(n >= 2, "several_sources")
    for name, c in arms.items():
        one = one.when(c, f"{name}_only")
    some = lambda cs: reduce(lambda x, y: x | y, cs.values())
    layer = F.when(some(billing) & some(place), "both_layers").when(some(billing), "billing_only").when(some(place), "place_only").otherwise("none")
    return one.otherwise("unresolved"), layer


def reconcile_names(rows: DataFrame, id_: str, source: str, name: str, org: str) -> DataFrame:
    """(id, source_a, source_b, class): how two sources' organizations of one id relate.

    same_identity, same_name_new_identity, renamed_identity, different, or one side missing.
    """
    pairs = rows.alias("a").join(rows.alias("b"), id_).filter(F.col(f"a.{source}") < F.col(f"b.{source}"))
    a, b = (lambda c: F.col(f"a.{c}")), (lambda c: F.col(f"b.{c}"))
    same_name, same_org = F.coalesce(a(name) == b(name), F.lit(False)), F.coalesce(a(org) == b(org), F.lit(False))
    missing = a(org).isNull() | b(org).isNull()
    kind = F.when(same_org & same_name, "same_identity").when(same_org, "renamed_identity").when(missing & same_name, "same_name_unidentified").when(missing, "one_side_unidentified").when(same_name, "same_name_new_identity").otherwise("different")
    return pairs.select(id_, a(source).alias("source_a"), b(source).alias("source_b"), kind.alias("class"))


def distribution_shift(before: DataFrame, after: DataFrame, org: str) -> DataFrame:
    """(org, n_before, n_after, gain)."""
    n = lambda df, c: df.groupBy(org).agg(F.count(F.lit(1)).alias(c))
    both = n(before, "n_before").join(n(after, "n_after"), org, "full").na.fill(0, ["n_before", "n_after"])
    return both.withColumn("gain", F.col("n_after") - F.col("n_before"))


def attribution(people: DataFrame, privileges: DataFrame, exact: DataFrame, near: DataFrame, id_: str, org: str) -> DataFrame:
    """(id, org, tier): a privilege, else an exact address, else the only organization near; several are kept as a number.

    Each argument has (id, org); of several privileges or addresses the least
    organization stands, near ones must be a single one.
    """
    side = lambda df, name: df.groupBy(id_).agg(F.min(org).alias(name), F.count_distinct(org).alias(f"n_{name}"))
    out = people.select(id_).distinct().join(side(privileges, "p"), id_, "left").join(side(exact, "e"), id_, "left").join(side(near, "s"), id_, "left")
    sole = F.col("n_s") == 1
    tier = F.when(F.col("p").isNotNull(), "privilege").when(F.col("e").isNotNull(), "exact_address").when(sole, "sole_nearby").when(F.col("n_s") > 1, "several_nearby").otherwise("none")
    return out.select(id_, F.coalesce("p", "e", F.when(sole, F.col("s"))).alias(org), tier.alias("tier"))


def pick_first(rows: DataFrame, id_: str, order: list[str]) -> DataFrame:
    """One row an id: the first by the given columns, missing ones last; the same on every run."""
    place = F.row_number().over(Window.partitionBy(id_).orderBy(*(F.col(c).asc_nulls_last() for c in order)))
    return rows.withColumn("_n", place).filter("_n = 1").drop("_n")


def latest_reported(rows: DataFrame, id_: str, year: str, value: str) -> DataFrame:
    """The latest year's most reported value of each id, ties to the smaller value."""
    per = rows.filter(F.col(value).isNotNull()).groupBy(id_, year, value).agg(F.count(F.lit(1)).alias("n"))
    place = F.row_number().over(Window.partitionBy(id_).orderBy(F.col(year).desc(), F.col("n").desc(), F.col(value).asc()))
    return per.withColumn("_n", place).filter("_n = 1").drop("_n")


def first_cause(causes: list[tuple[Column, str]], otherwise: str = "other") -> tuple[Column, Column]:
    """(the first cause that holds, all that hold joined by plus)."""
    holds = [(F.coalesce(c, F.lit(False)), name) for c, name in causes]
    first = F.coalesce(*(F.when(c, F.lit(name)) for c, name in holds), F.lit(otherwise))
    every = F.array_join(F.filter(F.array(*(F.when(c, F.lit(name)) for c, name in holds)), lambda x: x.isNotNull()), "+")
    return first, F.coalesce(F.nullif(every, F.lit("")), F.lit(otherwise))


def by_priority(sources: list[tuple[str, Column]]) -> tuple[Column, Column]:
    """(value, source) of the first source that has one; blank is none."""
    clean = [(name, F.nullif(F.trim(c), F.lit(""))) for name, c in sources]
    return F.coalesce(*(c for _, c in clean)), F.coalesce(*(F.when(c.isNotNull(), F.lit(name)) for name, c in clean))


def building_type(address: Column, campus: Column, centre: Column, office: str = r"(?i)\b(medical|professional)\s+(plaza|pavilion|building|arts)\b|\bMOB\b") -> Column:
    """Main campus by exact address, birth centre by list or name, medical office by pattern, else a clinic."""
    named = F.upper(F.coalesce(address, F.lit(""))).rlike("BIRTH(ING)? CENTER")
    return F.when(F.coalesce(campus, F.lit(False)), "main_campus").when(F.coalesce(centre, F.lit(False)) | named, "birth_centre").when(F.coalesce(address.rlike(office), F.lit(False)), "medical_office").otherwise("clinic")


def without_prefixes(df: DataFrame, column: str, prefixes: list[str]) -> DataFrame:
    """Rows whose code starts with none of the prefixes; a missing code stays."""
    code = F.upper(F.trim(F.coalesce(F.col(column).cast("string"), F.lit(""))))
    return df.filter(~code.rlike("^(" + "|".join(prefixes) + ")"))
