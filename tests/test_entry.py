"""Driver contract and a fast oracle check of the SQL-checked queries at sf0.001."""

import math

import duckdb
import pytest

import __spark_entry__ as E
from dispatchlens.sources.fixtures import TABLES

from .conftest import SF_SMALL

SLOW = {"m5_random_forest", "m16_feature_importance", "m6_boosted_trees_a", "m7_boosted_trees_b",
        "m8_stacking_ensemble", "m18_tree_shapley"}


def test_entry_smoke(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) == 5
    assert df.columns == ["BOROUGH", "cases", "mean_minutes", "median_minutes", "p90_minutes",
                          "slow_share", "opportunity_minutes"]


def test_every_oracle_has_a_query():
    assert set(E.oracle_sql()) <= set(E.queries())


def _norm(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if hasattr(v, "to_pydatetime"):
        return v.to_pydatetime()
    return v


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(E.oracle_sql()))
def test_oracle_matches(spark, duck, name):
    sp = E.queries()[name](spark, SF_SMALL).toPandas()
    dk = duck.execute(E.oracle_sql()[name]).fetchdf()
    assert sorted(sp.columns) == sorted(dk.columns)
    cols = sorted(sp.columns)
    a = sorted((tuple(str(_norm(x)) for x in r) for r in sp[cols].itertuples(index=False, name=None)))
    b = sorted((tuple(str(_norm(x)) for x in r) for r in dk[cols].itertuples(index=False, name=None)))
    assert a == b
