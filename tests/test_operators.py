"""Contracts, edge cases and order independence of the library's operators."""

import random

import pytest
from pyspark.sql import functions as F

from lodestone.functions import scalars as S
from lodestone.operators import geography as G
from lodestone.operators import joins as J
from lodestone.operators import linkage as L
from lodestone.operators import panel as P
from lodestone.operators import statistics as X
from lodestone.sources import tables as T
from lodestone.streaming import ingest


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def test_left_join_contract(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y"), (None, "z")], "k int, a string")
    b = spark.createDataFrame([(1, "p"), (None, "q")], "k int, b string")
    assert J.report(a, b, ["k"]).matched_rows == 1  # null keys never match
    with pytest.raises(J.ContractError):
        J.left_join(a, b, ["k"])
    assert J.left_join(a, b, ["k"], min_coverage=0.3).count() == 3
    with pytest.raises(J.ContractError):
        J.left_join(a, b.union(b.filter("k = 1").withColumn("b", F.lit("other"))), ["k"], min_coverage=0.3)
    assert J.report(a.limit(0), b, ["k"]).share == 1.0


def test_unique_keys(spark):
    same = spark.createDataFrame([(1, "a"), (1, "a")], "k int, v string")
    assert J.assert_unique(same, ["k"], dedupe=True).count() == 1
    with pytest.raises(J.ContractError):
        J.assert_unique(same.union(spark.createDataFrame([(1, None)], "k int, v string")), ["k"], dedupe=True)


def test_resolution_does_not_depend_on_row_order(spark):
    rows = [("a", 1, 1, 0, 1), ("a", 2, 2, 0, 1), ("b", 3, 2, 0, 1), ("b", 4, 2, 0, 1), ("c", 5, 5, 0, 5)]
    seen = set()
    for seed in range(5):
        random.Random(seed).shuffle(rows)
        df = spark.createDataFrame(rows, "id string, npi int, evidence_class int, middle_match int, strategy int").repartition(3)
        seen.add(tuple(sorted((r["id"], r["npi"], r["confidence"]) for r in L.resolve_best_class(L.per_npi(df)).collect())))
    assert seen == {(("a", 1, 1.0), ("c", 5, 0.35))}


def test_contested_npi_is_ambiguous_for_all(spark):
    df = spark.createDataFrame([("a", 1), ("b", 1), ("c", 2)], "id string, npi int")
    assert {(r["id"], r["status"]) for r in L.contested_allocation(df).collect()} == {("a", "ambiguous_contested"), ("b", "ambiguous_contested"), ("c", "accepted")}


def test_scalars(spark):
    lit = F.lit
    assert one(spark, S.name_key(lit(" Zużka  quìntél "))) == "ZUZKA QUINTEL"
    assert one(spark, S.strip_name_noise(lit("Dr. Oda Żabik, CNM"))) == "Oda Żabik"
    p = one(spark, S.parse_person(lit("Pemberly, Oda Wren RN")))
    assert (p["first"], p["middle"], p["last"]) == ("ODA", "WREN", "PEMBERLY")
    assert one(spark, S.surname_tokens(lit("Van der Quill-Tamsin"))) == ["QUILL", "TAMSIN"]
    assert one(spark, S.pad(lit("1234567"), 5)) == "1234567"
    assert one(spark, S.npi_valid(lit("1234567893"))) is True
    assert one(spark, S.npi_valid(lit("1234567890"))) is False
    assert one(spark, S.address(lit("77 North Quarry Street, Suite 9"))) == "77 N QUARRY ST STE 9"
    assert one(spark, S.address_without_unit(lit("77 Quarry St # 9"))) == "77 QUARRY ST"
    assert one(spark, S.organization(lit("The Owl's Nest Bakery, Inc."))) == "OWLS NEST BAKERY"
    assert one(spark, S.state_code(lit("new  york"))) == "NY"
    assert one(spark, S.phone10(lit("1 (555) 123-4567"))) == "5551234567"
    assert one(spark, S.safe_divide(lit(1.0), lit(0.0))) is None
    assert one(spark, S.suppressed_count(lit("Suppressed")))["flag"] == "suppressed"
    assert round(S.jaro_winkler_of("MARTHA", "MARHTA"), 4) == 0.9611


def test_spells_and_reentry(spark):
    df = spark.createDataFrame([("a", p) for p in (1, 2, 3, 5, 6, 9)], "e string, p int").withColumn("o", F.col("p"))
    s = P.spells(df, ["e"], "p", "o").orderBy("spell_index").collect()
    assert [(r["first_seen"], r["last_seen"], r["n_seen"]) for r in s] == [(1, 3, 3), (5, 6, 2), (9, 9, 1)]
    assert P.reentries(P.spells(df, ["e"], "p", "o"), ["e"]).first()["n_spells"] == 3


def test_geocode_conflicts(spark):
    df = spark.createDataFrame([("a", 40.0, -80.0, 1.0), ("b", 40.0, -80.0, 1.0), ("b", 41.0, -80.0, 2.0), ("c", 40.0, -80.0, 1.0), ("c", 41.0, -80.0, 1.0), ("d", 40.0, -80.0, 1.0), ("d", 40.001, -80.0, 1.0)], "key string, lat double, lon double, quality double")
    got = {r["key"]: (r["status"], r["lat"]) for r in G.resolve_conflicts(df, "key").collect()}
    assert got["a"][0] == "unique" and got["b"] == ("by_quality", 41.0) and got["c"] == ("refused", None) and got["d"][0] == "within_tolerance"


def test_geocode_spread_is_pairwise(spark):
    """A triangle whose box is wider than any two of its corners, and random keys against all pairs."""
    rng = random.Random(3)
    rows = [("t", 45.0, -90.0, 1.0), ("t", 45.0, -89.9895, 1.0), ("t", 45.0075, -89.99475, 1.0)]
    for k in range(60):
        rows += [(f"k{k}", 30 + rng.random() * 0.012, 10 + rng.random() * 0.012, float(rng.randint(0, 2))) for _ in range(rng.randint(1, 6))]
    df = spark.createDataFrame(rows, "key string, lat double, lon double, quality double")
    pairs = df.alias("a").join(df.alias("b"), "key").groupBy("key").agg(F.max(S.haversine_km(F.col("a.lat"), F.col("a.lon"), F.col("b.lat"), F.col("b.lon"))).alias("km"), F.count_distinct("a.lat", "a.lon").alias("n"))
    want = {r["key"]: (r["n"] == 1, r["km"] <= 1.0) for r in pairs.collect()}
    got = {r["key"]: r["status"] for r in G.resolve_conflicts(df, "key").collect()}
    assert got["t"] == "within_tolerance"
    for k, (single, near) in want.items():
        assert (got[k] == "unique") == single and (got[k] == "within_tolerance") == (near and not single)


def test_nearest_far_north_and_across_the_date_line(spark):
    rng = random.Random(6)
    spot = lambda i: (i, rng.choice([rng.uniform(68, 72), rng.uniform(-1, 1), 89.7]), rng.choice([rng.uniform(-180, -179.8), rng.uniform(179.8, 180), rng.uniform(-150, -149.5)]))
    pts, org = spark.createDataFrame([spot(i) for i in range(200)], "id long, lat double, lon double"), spark.createDataFrame([spot(i) for i in range(200)], "origin_id long, lat double, lon double")
    far = pts.alias("p").crossJoin(org.alias("o")).select("id", "origin_id", S.haversine_km(F.col("p.lat"), F.col("p.lon"), F.col("o.lat"), F.col("o.lon")).alias("km")).filter("km <= 25")
    want = {r["id"]: r["origin_id"] for r in far.groupBy("id").agg(F.min_by("origin_id", F.struct("km", "origin_id")).alias("origin_id")).collect()}
    assert len(want) > 50 and {r["id"]: r["origin_id"] for r in G.nearest(pts, org, 25.0).collect()} == want


def test_edit_join_by_brute_force(spark):
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abc") for _ in range(rng.randint(3, 9)))
    left, right = [(i, "x" if i % 3 else "y", word()) for i in range(150)], [(i, "x" if i % 2 else "y", word()) for i in range(150)]
    a, b = spark.createDataFrame(left, "i int, k string, s string"), spark.createDataFrame(right, "j int, k string, t string")
    for most in (1, 2, 3):
        near = F.levenshtein("s", "t").between(1, most) & (F.length("s") >= 5) & (F.length("t") >= 5)
        want = {(r["i"], r["j"]) for r in a.join(b, "k").filter(near).collect()}
        got = [(r["i"], r["j"]) for r in J.edit_join(a, b, ("s", "t"), ["k"], most).collect()]
        assert want and len(got) == len(want) and set(got) == want


def test_checked_joins(spark):
    a, b = spark.createDataFrame([(1,), (2,), (3,), (None,)], "k int"), spark.createDataFrame([(1,), (2,)], "k int")
    assert sorted(r["k"] or 0 for r in J.checked_left_join(a, b, ["k"], min_coverage=0.5).unmatched.collect()) == [0, 3]
    with pytest.raises(J.ContractError, match="2 unmatched rows"):
        J.checked_left_join(a, b, ["k"], min_coverage=0.5, max_unmatched=1)
    with pytest.raises(J.ContractError):
        J.checked_anti_join(a, b, ["k"], max_matched=0.4)
    with pytest.raises(J.ContractError):
        J.checked_semi_join(a, b, ["k"], min_kept=0.6)
    with pytest.raises(J.ContractError):
        J.checked_inner_join(a, b.union(b), ["k"], min_coverage=0.1)
    said = []
    J.coverage_report(a.filter("k = 3"), b, ["k"], said.append)
    assert len(said) == 1 and J.lookup(a, b, ["k"]).count() == 4


def test_fisher_and_impute(spark):
    assert round(X.fisher_exact(1, 9, 11, 3), 6) == 0.002759
    df = spark.createDataFrame([(1.0, 2.0), (2.0, 4.0), (3.0, None)], "x double, y double")
    assert {(r["x"], round(r["y"], 6), r["imputed"]) for r in X.impute_linear(df, "y", "x").collect()} == {(1.0, 2.0, False), (2.0, 4.0, False), (3.0, 6.0, True)}


def test_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id,n\n001,1\n002,\n")
    df = T.read_any(spark, str(tmp_path / "a.csv"))
    assert [tuple(r) for r in df.orderBy("id").collect()] == [("001", "1"), ("002", None)]
    (tmp_path / "f.csv").write_text('County,Births\n"A, x",10\nB,Suppressed\n"Source: registry"\n')
    body, notes = T.read_csv_with_footer(spark, str(tmp_path / "f.csv"), required=("Source",))
    assert [tuple(r) for r in body.collect()] == [("A, x", "10"), ("B", "Suppressed")] and notes == {"Source": "registry"}
    (tmp_path / "j.jsonl").write_text('{"a": 1}\n{"a": 2}\n{"a": ')
    assert T.read_any(spark, str(tmp_path / "j.jsonl")).count() == 2
    T.write_with_provenance(df, str(tmp_path / "out"), [str(tmp_path / "a.csv")])
    assert T.stale_inputs(spark, str(tmp_path / "out")) == []
    (tmp_path / "a.csv").write_text("changed")
    assert T.stale_inputs(spark, str(tmp_path / "out")) == [str(tmp_path / "a.csv")]
    with pytest.raises(J.ContractError):
        T.freeze(spark.range(1).toDF("x"), str(tmp_path / "out"))


def test_vintages_and_resume(spark, tmp_path):
    df = spark.createDataFrame([(1, "2024-01"), (2, "2024-02")], "id int, vintage string")
    df.write.parquet(str(tmp_path / "in"))
    args = str(tmp_path / "in"), df.schema, str(tmp_path / "t"), str(tmp_path / "c")
    ingest.ingest_vintages(spark, *args)
    T.overwrite_vintage(df.filter("id = 2").withColumn("id", F.lit(9)), str(tmp_path / "t"), "vintage")
    assert sorted(r["id"] for r in spark.read.parquet(str(tmp_path / "t")).collect()) == [1, 9]
    done = str(tmp_path / "done")
    assert ingest.resume(df.limit(1), done, "id", lambda x: x).count() == 1
    assert ingest.resume(df, done, "id", lambda x: x).count() == 2


def test_content_hash_ignores_order(spark):
    df = spark.createDataFrame([(1, "a"), (2, None)], "a int, b string")
    assert T.content_hash(df) == T.content_hash(df.orderBy(F.desc("a"))) != T.content_hash(df.union(df.limit(1)))


def test_whole_tables_are_used(spark, sf):
    """The queries reach every supplier and customer."""
    from lodestone.plans import registry

    q, n = registry.queries(), lambda t: spark.read.parquet(f"{sf}/{t}.parquet")
    assert q["O17_rollup_arms"](spark, sf).count() == n("lineitem").select("l_suppkey").distinct().count()
    assert q["J03_full_outer_counts"](spark, sf).filter("before = 1").count() == n("customer").count()
    orgs = {x for r in q["O10_address_status"](spark, sf).collect() for x in r["orgs"].split("|") if x}
    served = n("supplier").join(n("customer").selectExpr("c_nationkey AS s_nationkey"), "s_nationkey", "left_semi").collect()
    assert orgs == {str(r["s_suppkey"]) for r in served}
