"""Every registered query gives exactly the rows of its independent SQL."""

import pytest
from compare import assert_same, duck

import __spark_entry__ as entry_point
from tillroll.oracle import statements
from tillroll.plans.registry import QUERIES

FOLDER = "/root/testdata/sf0.01"
SQL = statements()


@pytest.fixture(scope="module")
def con():
    return duck(FOLDER)


def test_every_query_has_sql():
    assert set(SQL) == set(QUERIES)
    assert set(QUERIES) <= set(entry_point.queries())
    assert set(SQL) <= set(entry_point.oracle_sql())


@pytest.mark.parametrize("key", sorted(QUERIES))
def test_same_rows(spark, con, key):
    rows = assert_same(QUERIES[key](spark, FOLDER), con, SQL[key])
    # At this size every product has been sold.
    assert rows > 0 or key == "q21_products_never_sold"


def test_entry_runs(spark):
    assert entry_point.entry(spark).count() == 10


def test_every_mart_of_a_refresh_has_the_right_rows(spark, con):
    QUERIES["k04_refresh_marts"](spark, FOLDER)
    for name in [k for k in SQL if k.startswith("v_") and k != "v_customer_segment_counts"]:
        mart = spark.table(name)
        money = {c: mart[c].cast("double") for c, kind in mart.dtypes if kind.startswith("decimal")}
        assert assert_same(mart.withColumns(money), con, SQL[name]) > 0
