"""Every query of the catalogue against its SQL on the smallest data, and the contract of the entry module."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from graphloom.plans import catalog

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="the driver's tables are not here")


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA}/{t}.parquet')")
    return con


def canon(df):
    df = df[sorted(df.columns)]
    tidy = lambda x: None if x is None or x != x else round(x, 6) if isinstance(x, float) else x
    return sorted(str([tidy(x) for x in row]) for row in df.astype(object).itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_is_its_sql(spark, sql, name):
    got, want = catalog.QUERIES[name](spark, DATA).toPandas(), sql.execute(catalog.ORACLES[name]).fetchdf()
    assert sorted(got.columns) == sorted(want.columns)
    assert canon(got) == canon(want)


def test_entry(spark):
    assert set(catalog.QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0


def test_plans_have_no_cartesian_product(spark):
    for name in ("impact_two_hop", "discover_connections", "tiered_resolution", "entity_resolution", "edge_merge"):
        plan = catalog.QUERIES[name](spark, DATA)._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan, name
