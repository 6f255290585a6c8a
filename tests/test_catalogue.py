"""Every query with SQL gives DuckDB's rows on the small tables."""

import duckdb
import pytest

from marquee.plans.catalogue import ORACLE_SQL, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents".split()


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    c.execute("SET timezone = 'UTC'")
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return c


def rows(frame):
    clean = frame.astype(object).where(frame.notna(), None)
    return sorted(map(repr, clean.itertuples(index=False, name=None)))


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_rows_equal_sql(spark, sf, con, name):
    got, want = QUERIES[name](spark, sf), con.execute(ORACLE_SQL[name]).df()
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    assert rows(got.select(columns).toPandas()) == rows(want[columns])


def test_all_queries_are_named(spark):
    import __spark_entry__ as entry

    assert set(QUERIES) <= set(entry.queries())
    assert entry.entry(spark).count() >= 0


def test_filters_reach_the_scan(spark, sf):
    from marquee.operators import listings as ops

    scan = spark.read.schema("id string, date string, venue string, image string").parquet(f"{sf}/nation.parquet")
    plan = ops.scan_month(scan.select("id", "date"), "2026-03")._jdf.queryExecution().executedPlan().toString()
    assert "StringStartsWith" in plan and "venue" not in plan


def test_pages_are_a_bounded_top_k(spark, sf):
    plan = QUERIES["page_n"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan
