"""Facts bucketed by order: no shuffle of the lines, and hot orders apart."""

from __future__ import annotations

import re
import uuid
from functools import reduce

import pytest
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tables import retail, row_set

from tillroll.plans import dashboard, marts, preparation
from tillroll.plans.registry import NARROW, _retail_parts, _store_parts
from tillroll.sources import colocated
from tillroll.sources.warehouse import PreparedTables

FOLDER = "/root/testdata/sf0.001"


def final_plan(df):
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString()
    return plan.split("== Initial Plan ==")[0]


def above_lines(plan):
    """What stands above the scan of the lines, up to the first operator that sums rows of orders."""
    path = {}
    for line in plan.split("\n"):
        mark = re.search(r"[A-Z*]", line)
        path = {d: n for d, n in path.items() if d < (mark.start() if mark else 0)} | {mark.start() if mark else 0: line}
        if "FileScan" in line and "order_items" in line:
            return [path[d] for d in sorted(path, reverse=True)]
    raise AssertionError("no lines in the plan")


@pytest.mark.parametrize("name", ["master", "summary"])
def test_line_reports_have_no_exchange_of_lines(spark, name):
    if name == "master":
        df = preparation.sales_master(_retail_parts(spark, FOLDER)[0])
    else:
        df = marts.sales_summary(_store_parts(spark, FOLDER)[0])
    plan = above_lines(final_plan(df))
    assert not [line for line in plan if "Exchange" in line or "ShuffleQueryStage" in line]


@pytest.mark.parametrize("chosen", [dashboard.EVERYTHING, NARROW])
def test_sums_per_order_have_no_exchange_of_lines(spark, chosen):
    df = dashboard._sales_per_order(_retail_parts(spark, FOLDER)[0], chosen, ("customer_id",), profit=True)
    plan = above_lines(final_plan(df))
    assert not [line for line in plan if "Exchange" in line or "ShuffleQueryStage" in line]


def test_parts_hold_each_order_once(spark):
    parts = _retail_parts(spark, FOLDER)
    tables = PreparedTables(spark, FOLDER)
    for name in ("orders", "order_items"):
        counts = [getattr(part, name).count() for part in parts]
        assert sum(counts) == getattr(tables, name).count() and all(counts)
    assert parts[0].orders.join(parts[1].orders, "order_id", "left_semi").count() == 0


@pytest.fixture
def hot(spark):
    """A third of the lines under one order."""
    orders = [(f"o{i}", "c1", "2024-01-31", None, "Delivered", 1) for i in range(200)]
    items = [("o7", "p1", 1, 2)] * 1000 + [(f"o{i % 200}", "p1", 1, 1) for i in range(2000)] + [(None, "p1", 1, 5), ("zz", "p1", 1, 3)]
    return retail(spark, [("c1", "Ann", "A", "X")], [("p1", "Pen", "Office", "B", 1, 5)], orders, items)


def test_a_hot_order_lies_apart(spark, hot):
    database = f"hot_{uuid.uuid4().hex[:12]}"
    colocated.write_facts({"orders": hot.orders, "order_items": hot.order_items}, database, 4, 100)
    regular, apart = colocated.retail_parts(hot, database)
    assert regular.order_items.where("order_id = 'o7'").count() == 0
    assert apart.orders.count() == 1 and apart.order_items.count() == 1011
    # No bucket holds much more than its share of the other lines.
    sizes = regular.order_items.selectExpr("pmod(hash(order_id), 4) AS bucket").groupBy("bucket").count()
    assert max(r["count"] for r in sizes.collect()) < 1000
    masters = [preparation.sales_master(part) for part in (regular, apart)]
    together = reduce(DataFrame.unionByName, masters).groupBy("order_id", "customer_name", "profit").count()
    whole = preparation.sales_master(hot).groupBy("order_id", "customer_name", "profit").count()
    assert row_set(together) == row_set(whole)
    assert row_set(dashboard.home_kpis_of_parts([regular, apart])) == row_set(dashboard.home_kpis(hot))


def test_more_lines_have_more_buckets(spark, hot, monkeypatch):
    monkeypatch.setattr(colocated, "LINES_PER_BUCKET", 100)
    database = f"large_{uuid.uuid4().hex[:12]}"
    colocated.write_facts({"orders": hot.orders, "order_items": hot.order_items}, database, 2, 500)
    regular, apart = colocated.retail_parts(hot, database)
    buckets = {r["col_name"]: r["data_type"] for r in spark.sql(f"DESCRIBE FORMATTED {database}.order_items").collect()}
    assert buckets["Num Buckets"] == "31"
    sizes = regular.order_items.groupBy(F.input_file_name()).count()
    assert max(r["count"] for r in sizes.collect()) < 400
    assert sum(part.order_items.count() for part in (regular, apart)) == 3002

def test_buckets_hold_few_lines_and_are_no_more_than_spark_allows(spark, hot, monkeypatch):
    assert colocated.LINES_PER_BUCKET <= 200_000
    monkeypatch.setattr(colocated, "LINES_PER_BUCKET", 1)
    before = spark.conf.get("spark.sql.sources.bucketing.maxBuckets")
    spark.conf.set("spark.sql.sources.bucketing.maxBuckets", "40")
    try:
        database = f"few_{uuid.uuid4().hex}"
        facts = {"orders": hot.orders, "order_items": hot.order_items}
        colocated.write_facts(facts, database, buckets=4, hot_lines=500)
        buckets = {r["col_name"]: r["data_type"] for r in spark.sql(f"DESCRIBE FORMATTED {database}.order_items").collect()}
        assert buckets["Num Buckets"] == "40"
    finally:
        spark.conf.set("spark.sql.sources.bucketing.maxBuckets", before)

