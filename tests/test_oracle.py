"""Every registered query against its SQL on the same tables."""

import os

import duckdb
import pandas as pd
import pytest

from lodestone.plans import registry

SQL = registry.oracle_sql()


def rows(df: pd.DataFrame) -> list[tuple]:
    df = df[sorted(df.columns)]
    clean = lambda v: None if v is None or v is pd.NaT or (isinstance(v, float) and v != v) or v is pd.NA else round(v, 6) if isinstance(v, float) else v
    return sorted((tuple(clean(v) for v in r) for r in df.astype(object).itertuples(index=False)), key=repr)


@pytest.fixture(scope="session")
def duck(sf):
    con = duckdb.connect()
    for f in os.listdir(sf):
        con.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{sf}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows(spark, duck, sf, name):
    ours = registry.queries()[name](spark, sf).toPandas()
    theirs = duck.sql(SQL[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert [repr(r) for r in rows(ours)] == [repr(r) for r in rows(theirs)] or rows(ours) == rows(theirs)


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(SQL)))
def test_runs(spark, sf, name):
    assert registry.queries()[name](spark, sf).count() >= 0
