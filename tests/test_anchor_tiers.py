"""L38_anchor_tiers on tables of its own: no candidate is left out, and odd rows come out as in SQL."""

import duckdb
import pytest
from test_oracle import rows

from lodestone.plans import registry

NAME = "L38_anchor_tiers"


def both(spark, folder, parts):
    """Rows of the query and of its SQL over (p_partkey, p_name, p_brand, p_type, p_size)."""
    spark.createDataFrame(parts, "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int").write.parquet(f"{folder}/part.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW part AS SELECT * FROM '{folder}/part.parquet/*.parquet'")
    return rows(registry.queries()[NAME](spark, str(folder)).toPandas()), rows(con.sql(registry.oracle_sql()[NAME]).df())


@pytest.mark.parametrize("namesakes", [39, 45, 300])
def test_every_candidate(spark, tmp_path, namesakes):
    """The one candidate without a middle conflict wins, however many better named ones with evidence there are."""
    crowd = [(2 * k + 3, "blue ring", "B", "ECONOMY", 16) for k in range(namesakes)]
    ours, theirs = both(spark, tmp_path, [(0, "blue ring", "B", "XCONOMY", 16), (1, "blur ring", "B", "XCONOMY", 16), *crowd])
    assert ours == theirs == [("zip", 0, "Gold")]


def test_every_rival(spark, tmp_path):
    """A candidate without evidence is not the only one where others stand behind 40 that conflict."""
    crowd = [(2 * k + 5, "blue ring", "B", "ECONOMY", 16) for k in range(45)]
    ours, theirs = both(spark, tmp_path, [(0, "blue ring", "B", "XCONOMY", 16), (1, "blur ring", "B", "XCONOMY", 16), (3, "blond ring", "B", "XCONOMY", 18), *crowd])
    assert ours == theirs == [("zip", 0, None)]


def test_odd_rows(spark, tmp_path):
    """Missing and empty values, repeated keys and keys with several rows."""
    kinds = ["STANDARD", "PROMO", "SMALL", "", None]
    parts = [(k, [f"blue r{k % 3}ng", "", None, "ring", "blue ring"][k % 5], ["B", "C", "", None][k // 2 % 4], kinds[k // 3 % 5], [16, 17, 9, None][k // 5 % 4]) for k in range(400)]
    again = [(k, "blue ring", "B", "STANDARD", 16 + k % 3) for k in range(0, 400, 7)]
    ours, theirs = both(spark, tmp_path, [*parts, *parts[::5], *again, (None, "blue ring", "B", "STANDARD", 16)])
    assert ours == theirs and len(ours) > 100
