"""Conservative identity resolution: block, classify, resolve, allocate, tier.

Ties are quarantined; row order never decides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from . import joins as J

# Confidence by evidence class 1 to 5.
CONFIDENCE = (1.0, 0.9, 0.7, 0.5, 0.35)


def keyed(df: DataFrame, person: str, first: str, middle: str, last: str) -> DataFrame:
    """(person, first, middle, last, initial, tokens) with normalised keys."""
    return df.select(
        F.col(person).alias("person"),
        S.blank_key(F.col(first)).alias("first"),
        S.first_initial(F.col(middle)).alias("middle"),
        S.blank_key(F.col(last)).alias("last"),
        S.first_initial(F.col(first)).alias("initial"),
        S.surname_tokens(F.col(last)).alias("tokens"),
    )


def candidates(roster: DataFrame, register: DataFrame) -> DataFrame:
    """(id, npi, strategy, middle_match) by exact, initial, fuzzy and surname-token blocks, with the middle-initial veto.

    Exact and initial matches come from one join.  Fuzzy and token matches are sought
    among distinct names and only then spread to the rows that bear them.  One row a
    pair and strategy, for each pair of names that an id and an npi have.
    """
    side = lambda df, p, own: df.select(F.col("person").alias(own), *(F.col(c).alias(f"{p}_{c}") for c in ("middle", "last", "initial", "tokens")), F.col("first").alias(f"{p}_first"))
    a = side(roster, "a", "id").filter((F.col("a_first") != "") & (F.col("a_last") != ""))
    b = side(register, "b", "npi")
    same = F.col("a_first") == F.col("b_first")
    close = a.join(b, (F.col("a_last") == F.col("b_last")) & (F.col("a_initial") == F.col("b_initial"))).withColumn("strategy", F.when(same, 1).otherwise(2))
    names = lambda df, p: df.groupBy(F.col(f"{p}_first").alias("first"), f"{p}_last").agg(F.first(f"{p}_tokens").alias("tokens"))
    na, nb = names(a, "a"), names(b, "b")
    fuzzy = J.near_texts(na, nb, ("a_last", "b_last"), ["first"]).withColumn("strategy", F.lit(3))
    token = na.withColumn("token", F.explode("tokens")).drop("tokens").join(nb.withColumn("token", F.explode("tokens")).drop("tokens"), ["first", "token"])
    token = token.filter("a_last <> b_last").select("first", "a_last", "b_last").distinct().withColumn("strategy", F.lit(5))
    wide = fuzzy.unionByName(token).join(a.withColumnRenamed("a_first", "first"), ["first", "a_last"]).join(b.withColumnRenamed("b_first", "first"), ["first", "b_last"])
    columns = ["id", "npi", "strategy", "a_middle", "b_middle"]
    every = close.select(*columns).unionByName(wide.select(*columns))
    agree = F.col("a_middle") == F.col("b_middle")
    return every.filter(F.coalesce(agree, F.lit(True))).select("id", "npi", "strategy", F.coalesce(agree, F.lit(False)).cast("int").alias("middle_match"))


def evidence_class(strategy: Column, middle_match: Column) -> Column:
    """1 exact with middle, 2 exact, 3 initial, 4 fuzzy, 5 surname component."""
    return F.when((strategy == 1) & (middle_match == 1), 1).when(strategy == 1, 2).when(strategy == 2, 3).when(strategy == 3, 4).otherwise(5)


def per_npi(pairs: DataFrame) -> DataFrame:
    """One row a (id, npi): the best class and the best middle match."""
    return pairs.groupBy("id", "npi").agg(F.min("evidence_class").alias("evidence_class"), F.max("middle_match").alias("middle_match"), F.min_by("strategy", F.struct("evidence_class", "strategy")).alias("strategy"))


def alike_pairs(roster: DataFrame, register: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(pairs, ids, npis): ``per_npi`` of the candidates of one person of each group with the same names, and who stands for whom."""
    names = ["first", "middle", "last", "initial", "tokens"]
    (a, ids), (b, npis) = J.alike(roster, "person", names), J.alike(register, "person", names)
    pairs = candidates(a, b).withColumn("evidence_class", evidence_class(F.col("strategy"), F.col("middle_match")))
    return per_npi(pairs), ids.withColumnRenamed("person", "id"), npis.withColumnRenamed("person", "npi")


def pool_stats(rows: DataFrame, weight: Column | None = None) -> DataFrame:
    """Per id: candidates, the best class and how many stand at it; ``weight`` is the number of candidates of a row."""
    best, weight = Window.partitionBy("id"), F.lit(1) if weight is None else weight
    rows = rows.withColumn("best", F.min("evidence_class").over(best))
    return rows.groupBy("id").agg(F.sum(weight.cast("long")).alias("n_candidates"), F.min("best").alias("best_class"), F.sum(F.when(F.col("evidence_class") == F.col("best"), weight).otherwise(0).cast("long")).alias("n_at_best"))


def two_least(npis: DataFrame) -> DataFrame:
    """(rep, npi, weight): of each group its two least npis; the first counts for all but the second.

    These decide who is first and second of an id's candidates.
    """
    place = F.row_number().over(Window.partitionBy("rep").orderBy(F.col("npi").asc()))
    first = npis.withColumn("_n", place).filter("_n <= 2")
    return first.select("rep", "npi", F.when((F.col("_n") == 1) & (F.col("n") > 1), F.col("n") - 1).otherwise(1).alias("weight"))


def best_pool(pairs: DataFrame) -> DataFrame:
    """Per id of (id, npi, evidence_class): the best class, and the least and greatest npi there.

    One aggregate with sums on the map side; several rows of a pair change nothing.
    """
    at = lambda c: F.when(F.col("evidence_class") == c, F.col("npi"))
    classes = range(1, len(CONFIDENCE) + 1)
    per = pairs.groupBy("id").agg(*(f(at(c)).alias(f"{n}{c}") for c in classes for n, f in (("low", F.min), ("high", F.max))))
    best = F.coalesce(*(F.when(F.col(f"low{c}").isNotNull(), c) for c in classes))
    return per.select("id", best.alias("best_class"), F.coalesce(*(F.col(f"low{c}") for c in classes)).alias("low"), F.coalesce(*(F.col(f"high{c}") for c in classes)).alias("high"))


def resolve_best_class(pairs: DataFrame) -> DataFrame:
    """Accept an id only when exactly one candidate stands at its best class."""
    ok = best_pool(pairs).filter("low = high")
    how = F.when(F.col("best_class") == 1, "unique_best_class_with_middle").otherwise("unique_best_class")
    score = F.element_at(F.array(*map(F.lit, CONFIDENCE)), F.col("best_class"))
    return ok.select("id", F.col("low").alias("npi"), F.col("best_class").alias("evidence_class"), how.alias("resolution"), score.alias("confidence"))


def quarantined(pairs: DataFrame) -> DataFrame:
    """Ids with several candidates at their best class."""
    return best_pool(pairs).filter("low <> high").select("id")


def greedy_allocation(resolved: DataFrame, score: str = "confidence") -> DataFrame:
    """Each npi stays with its highest score, ties to the smaller id; the others lose it."""
    place = F.row_number().over(Window.partitionBy("npi").orderBy(F.col(score).desc(), F.col("id").asc()))
    return resolved.withColumn("kept", place == 1)


def contested_allocation(resolved: DataFrame) -> DataFrame:
    """An npi claimed by several ids is ambiguous for all of them."""
    return resolved.withColumn("claimants", F.count(F.lit(1)).over(Window.partitionBy("npi"))).withColumn("status", F.when(F.col("claimants") > 1, "ambiguous_contested").otherwise("accepted"))


def own_evidence(scored: DataFrame, floors: dict[str, float] | None = None, margin: float = 0.02, review: float = 0.75, weight: Column | None = None) -> DataFrame:
    """Decision per id from (id, npi, score, evidence): accept above the evidence's floor with a clear lead.

    ``weight`` is the number of candidates of a row, see ``two_least``.
    """
    floors = floors or {"strong": 0.82, "weak": 0.88, "none": 0.95}
    order = Window.partitionBy("id").orderBy(F.col("score").desc(), F.col("npi").asc())
    rows = scored.withColumn("place", F.row_number().over(order)).withColumn("second", F.lead("score").over(order)).withColumn("n", F.sum(F.lit(1).cast("long") if weight is None else weight).over(Window.partitionBy("id"))).filter("place = 1")
    floor = F.coalesce(*(F.when(F.col("evidence") == k, F.lit(v)) for k, v in floors.items()), F.lit(max(floors.values())))
    clear = F.col("second").isNull() | (F.col("score") - F.col("second") >= margin)
    sole = (F.col("evidence") != "none") | (F.col("n") == 1)
    decision = F.when((F.col("score") >= floor) & ~clear, "ambiguous").when((F.col("score") >= floor) & sole, "accept").when(F.col("score") >= review, "review").otherwise("reject")
    return rows.withColumn("decision", decision).select("id", "npi", "score", "evidence", "n", "decision")


def linkage_tier(linked: Column, ladder: list[tuple[Column, str]], held_back: Column, otherwise: str = "other") -> Column:
    """Exclusive tiers: the first rung of the ladder that a linked row fits, else quarantined or unmatched."""
    out = F.when(F.lit(False), "")
    for fits, label in ladder:
        out = out.when(linked & F.coalesce(fits, F.lit(False)), label)
    return out.when(linked, otherwise).when(F.coalesce(held_back, F.lit(False)), "quarantined").otherwise("unmatched")


def absence_demotion(resolved: DataFrame, vetoed: DataFrame, roster: DataFrame) -> DataFrame:
    """Flag class-5 rows whose rivals were vetoed and which have no middle initial themselves."""
    rivals = vetoed.groupBy("id").agg(F.count_distinct("npi").alias("n_rivals"))
    rows = resolved.join(rivals, "id", "left").join(roster.select(F.col("person").alias("id"), "middle"), "id", "left")
    return rows.withColumn("demoted", (F.col("evidence_class") == 5) & (F.coalesce("n_rivals", F.lit(0)) > 0) & F.col("middle").isNull()).drop("middle")


def waterfall(left: DataFrame, tiers: list[tuple[str, DataFrame, list[str]]], id_: str, target: str) -> DataFrame:
    """The first tier in which an id's keys have exactly one target.

    A key is one row before the join, with its least and greatest target; an id has
    one target where the two are the same over its keys. All tiers are joined to the
    rows, which are read and brought together by id once.
    """
    rows = left
    for k, (_, lookup, keys) in enumerate(tiers):
        rows = rows.join(lookup.groupBy(*keys).agg(F.min(target).alias(f"_low{k}"), F.max(target).alias(f"_high{k}")), keys, "left")
    order = range(len(tiers))
    ends = [f(f"{n}{k}").alias(f"{n}{k}") for k in order for n, f in (("_low", F.min), ("_high", F.max))]
    per = rows.filter(F.coalesce(*(F.col(f"_low{k}") for k in order)).isNotNull()).groupBy(id_).agg(*ends)
    first = lambda of: F.coalesce(*(F.when(F.col(f"_low{k}") == F.col(f"_high{k}"), of(k)) for k in order))
    return per.select(id_, first(lambda k: F.col(f"_low{k}")).alias(target), first(lambda k: F.lit(tiers[k][0])).alias("tier")).filter(F.col("tier").isNotNull())


def collision_quarantine(df: DataFrame, key: list[str], name: str) -> tuple[DataFrame, DataFrame]:
    """(clean, quarantined): keys held under several distinct names are quarantined whole."""
    bad = df.groupBy(*key).agg(F.count_distinct(name).alias("n")).filter("n > 1").select(*key)
    return df.join(bad, key, "left_anti"), df.join(bad, key, "left_semi")


def slots_to_long(df: DataFrame, id_: str, prefixes: dict[str, str], n: int) -> DataFrame:
    """Numbered column groups to rows, empty slots left out; absent columns are null."""
    def slot(i: int) -> Column:
        return F.struct(F.lit(i).alias("slot"), *((F.col(f"{p}{i}") if f"{p}{i}" in df.columns else F.lit(None)).cast("string").alias(own) for own, p in prefixes.items()))

    long = df.select(id_, F.explode(F.array(*(slot(i) for i in range(1, n + 1)))).alias("s")).select(id_, "s.*")
    return long.filter(F.coalesce(*(S.blank_to_null(F.col(c)) for c in prefixes)).isNotNull())


def former_names(df: DataFrame, id_: str, last: str, former: str) -> DataFrame:
    """(id, surname, kind): current, former or both, from a delimited list of former names."""
    current = df.select(id_, S.blank_key(F.col(last)).alias("surname"), F.lit(True).alias("c"), F.lit(False).alias("f"))
    past = df.select(id_, F.explode(F.split(F.col(former), r"[;|/,]")).alias("x")).select(id_, S.blank_key(F.col("x")).alias("surname"), F.lit(False).alias("c"), F.lit(True).alias("f"))
    rows = current.unionByName(past).filter("surname <> ''").groupBy(id_, "surname").agg(F.bool_or("c").alias("c"), F.bool_or("f").alias("f"))
    return rows.select(id_, "surname", F.when(F.col("c") & F.col("f"), "both").when(F.col("c"), "current").otherwise("former").alias("kind"))


def joined_names(names: DataFrame, id_: str) -> DataFrame:
    """One row a person from (id, surname, kind): surnames and kinds, sorted and joined."""
    rows = names.groupBy(id_).agg(F.array_sort(F.collect_set(F.struct("surname", "kind"))).alias("n"))
    return rows.select(id_, F.array_join(F.transform("n", lambda x: x["surname"]), "|").alias("surnames"), F.array_join(F.transform("n", lambda x: x["kind"]), "|").alias("kinds"))


def latest_attribute(df: DataFrame, id_: str, value: str, order: str) -> DataFrame:
    """The newest non-null value of each entity, ties to the smaller value."""
    rows = df.filter(F.col(value).isNotNull())
    place = F.row_number().over(Window.partitionBy(id_).orderBy(F.col(order).desc(), F.col(value).asc()))
    return rows.withColumn("_n", place).filter("_n = 1").select(id_, value, order)


def identity_flips(a: DataFrame, b: DataFrame, id_: str, value: str) -> DataFrame:
    both = a.select(id_, F.col(value).alias("before")).join(b.select(id_, F.col(value).alias("after")), id_, "full")
    return both.filter(~F.col("before").eqNullSafe(F.col("after")))


def transition(a: Column, b: Column) -> Column:
    """What became of a link between two versions."""
    return F.when(a == b, "same link").when(a.isNotNull() & b.isNotNull(), "different link").when(a.isNotNull(), "lost").when(b.isNotNull(), "gained").otherwise("still open")


def best_slot(slots: Column, primary: list[str], panel: list[str]) -> Column:
    """Best of (slot, code, is_primary) structs: wanted-primary, wanted-secondary, panel-primary, panel-secondary."""
    rank = lambda s: F.when(s["code"].isin(*primary) & s["is_primary"], 1).when(s["code"].isin(*primary), 2).when(s["code"].isin(*panel) & s["is_primary"], 3).when(s["code"].isin(*panel), 4)
    ranked = F.filter(F.transform(slots, lambda s: F.struct(rank(s).alias("rank"), s["slot"].alias("slot"), s["code"].alias("code"))), lambda s: s["rank"].isNotNull())
    return F.array_min(ranked)


def fitted_window(df: DataFrame, group: str, gap: str, least: int = 5) -> DataFrame:
    """10th and 90th percentile of a gap for each group, pooled ones for small groups."""
    ends = lambda: [F.percentile(gap, F.lit(q)).alias(n) for q, n in ((0.1, "low"), (0.9, "high"))]
    own = df.groupBy(group).agg(F.count(gap).alias("n"), *ends())
    pooled = df.agg(*(e.alias(f"all_{n}") for e, n in zip(ends(), ("low", "high"), strict=True)))  # one row
    rows = own.crossJoin(F.broadcast(pooled))
    return rows.select(group, "n", *(F.when(F.col("n") >= least, F.col(c)).otherwise(F.col(f"all_{c}")).alias(c) for c in ("low", "high")))
