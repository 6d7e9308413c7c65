"""Every registered query against its SQL in DuckDB, on the small tables."""

import datetime as dt

import duckdb
import pytest

from tidemark.plans import registry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in ("lineitem", "part", "events"):
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return con


def plain(value):
    if isinstance(value, dt.datetime):
        return value.date().isoformat()
    return value.isoformat() if isinstance(value, dt.date) else value


def test_every_query_has_sql():
    assert set(registry.QUERIES) == set(registry.ORACLES)


@pytest.mark.parametrize("name", list(registry.QUERIES))
def test_query(spark, duck, name):
    df = registry.QUERIES[name](spark, SF)
    relation = duck.sql(registry.ORACLES[name])
    columns = sorted(df.columns)
    assert sorted(relation.columns) == columns
    got = sorted(repr([plain(r[c]) for c in columns]) for r in df.collect())
    place = [relation.columns.index(c) for c in columns]
    assert got == sorted(repr([plain(r[i]) for i in place]) for r in relation.fetchall())


def test_no_python_in_plans(spark):
    for name, f in registry.QUERIES.items():
        assert "Python" not in f(spark, SF)._jdf.queryExecution().executedPlan().toString(), name


def test_scan_is_pruned(spark):
    plan = registry.QUERIES["append_after_cutoff"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(ts)" in plan and "props" not in plan


def test_top_k_plan(spark):
    plan = registry.QUERIES["top15_rs"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan and "WindowGroupLimit" in plan
