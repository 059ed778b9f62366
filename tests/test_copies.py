"""Queries on tables in which every row stands many times under other keys: right rows, and joins that don't grow with the square of the copies."""

import duckdb
import pytest
from test_oracle import rows

from lodestone.operators import linkage as L
from lodestone.plans import registry

COPIES = 30
KEYS = {"part": ["p_partkey"], "customer": ["c_custkey"], "supplier": ["s_suppkey"], "lineitem": ["l_orderkey", "l_partkey", "l_suppkey"]}
#: The most rows that the joins of a query may put out in all, by finding.
MOST = {
    "L32_author_links": 20_000,
    "O06_cross_source": 100_000,
    "O05_O08_tiers": 30_000,
    "O04_multi_key": 30_000,
    "L15_scored_candidates": 60_000,
    "L15_decisions": 60_000,
    "L38_anchor_tiers": 60_000,
    "L36_perturbed_scores": 60_000,
    "O10_address_status": 20_000,
    "L35_unique_then_place": 20_000,
    "L14_L16_own_evidence": 20_000,
    "L08_pool_stats": 20_000,
    "H13_address_then_city": 20_000,
    "L07_per_npi": 20_000,
    "J17_token_join": 20_000,
}


@pytest.fixture(scope="module")
def copies(sf, tmp_path_factory):
    folder, con = tmp_path_factory.mktemp("copies"), duckdb.connect()
    for name, keys in KEYS.items():
        shifted = ", ".join(f"({k} + i * 100000) AS {k}" for k in keys)
        con.execute(f"COPY (SELECT * REPLACE ({shifted}) FROM '{sf}/{name}.parquet', range({COPIES}) r(i)) TO '{folder}/{name}.parquet' (FORMAT parquet)")
    return str(folder)


def joined(plan) -> int:
    """Rows that the joins of an executed plan put out."""
    kind = plan.getClass().getSimpleName()
    inner = plan.executedPlan() if kind == "AdaptiveSparkPlanExec" else plan.plan() if kind.endswith("QueryStageExec") else None
    if inner is not None:
        return joined(inner)
    n = plan.metrics().apply("numOutputRows").value() if "Join" in kind else 0
    return n + sum(joined(plan.children().apply(i)) for i in range(plan.children().size()))


@pytest.mark.parametrize("name", sorted(MOST))
def test_copies(spark, copies, name):
    con = duckdb.connect()
    for table in KEYS:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{copies}/{table}.parquet'")
    df = registry.queries()[name](spark, copies)
    assert rows(df.toPandas()) == rows(con.sql(registry.oracle_sql()[name]).df())
    df.collect()
    assert joined(df._jdf.queryExecution().executedPlan()) <= MOST[name]


def test_waterfall_reads_once(spark):
    """Both tiers and the ties come out right where keys are shared by many rows; no join but one a tier, of as many rows as the left has."""
    n = 4_000
    kinds = [("sole", 1, 1, "name"), ("many", 1, 2, "place"), ("many", 2, None, None), ("many", 3, None, None), ("none", 1, None, None), (None, 1, None, None)]
    left = spark.createDataFrame([(i, *kinds[i % 6][:2]) for i in range(n)], "id int, name string, place int")
    register = spark.createDataFrame([(npi, name, place) for npi, name, place in ((1, "sole", 9), (2, "many", 1), (3, "many", 2), (4, "many", 2), (5, None, 1)) for _ in range(50)], "npi int, name string, place int")
    df = L.waterfall(left, [("name", register.select("npi", "name"), ["name"]), ("place", register, ["name", "place"])], "id", "npi")
    assert sorted(map(tuple, df.collect())) == [(i, *kinds[i % 6][2:]) for i in range(n) if kinds[i % 6][3]]
    assert joined(df._jdf.queryExecution().executedPlan()) <= 2 * n
