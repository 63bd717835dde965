"""Relational operators against their SQL twins on the smallest tables."""

import duckdb
import pytest

from anchorite.plans import model, registry

SF = "/root/testdata/sf0.001"
#: No token of the tables is an abbreviation of another one.
EMPTY = {"N11_abbreviated"}
NAMES = sorted(registry.oracles())


@pytest.fixture(scope="module")
def oracle():
    con = duckdb.connect()
    for t in registry.INPUTS:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", NAMES)
def test_twin(spark, oracle, name):
    got = registry.queries()[name](spark, SF).toPandas()
    want = oracle.execute(registry.oracles()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    key = lambda d: sorted(map(repr, d[sorted(d.columns)].astype(object).where(d.notna(), None).itertuples(index=False, name=None)))
    assert key(got) == key(want)
    assert len(got) > 0 or name in EMPTY


def test_filters_and_columns_reach_the_scan(spark):
    plan = registry.queries()["Z9_dense_ids"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "props" not in plan


def test_only_needed_model_tables():
    assert "pairwise_sim" not in model.sql("SELECT * FROM surface_candidates", True)
