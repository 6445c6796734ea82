"""Facts by month: date filters choose files."""

from __future__ import annotations

import glob
from datetime import date

import pytest
from tables import retail, row_set

from tillroll.operators.filters import SalesFilter
from tillroll.plans import dashboard
from tillroll.plans.registry import QUERIES
from tillroll.sources.dated import MONTH, DatedTables
from tillroll.sources.partitions import NO_VALUE
from tillroll.sources.warehouse import PreparedTables

FOLDER = "/root/testdata/sf0.001"
SPRING = SalesFilter(start=date(1997, 3, 15), end=date(1997, 5, 2))


def test_other_months_are_not_opened(spark, tmp_path):
    tables = PreparedTables(spark, FOLDER)
    dated = DatedTables(tables, str(tmp_path))
    dated.store()
    expected = row_set(dashboard.daily_sales(tables, SPRING))
    for path in glob.glob(str(tmp_path / f"*/{MONTH}=*/*.parquet")):
        if not any(f"{MONTH}={month}" in path for month in (199703, 199704, 199705)):
            with open(path, "wb") as file:
                file.write(b"not a table")
    assert row_set(dashboard.daily_sales(dated.within(SPRING), SPRING)) == expected
    with pytest.raises(Exception, match="Parquet|parquet|footer"):
        dashboard.daily_sales(dated.within(SalesFilter())).collect()


@pytest.mark.parametrize("key", ["d01_filtered_sales_dated", "d06_daily_sales_dated", "m16_year_quarter_slice_dated"])
def test_plans_prune_by_the_calendar(spark, key):
    spark.conf.set("spark.sql.maxMetadataStringLength", "4000")
    try:
        plan = QUERIES[key](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.maxMetadataStringLength")
    scans = [line for line in plan.split("\n") if "FileScan" in line and "/order_items" in line]
    assert scans and all("dynamicpruning" in line for line in scans)


def test_undated_and_unknown_orders_have_a_folder(spark, tmp_path):
    tables = retail(
        spark,
        products=[("p", "Pen", "Office", "B", 1, 5)],
        orders=[("o1", "c", "2024-01-31", None, "Delivered", 1), ("o2", "c", "2024-02-01", None, "Delivered", 1)],
        items=[("o1", "p", 1, 10), ("o2", "p", 1, 20), ("o9", "p", 1, 40), (None, "p", 1, 80)],
    )
    dated = DatedTables(tables, str(tmp_path))
    dated.store()
    assert glob.glob(str(tmp_path / f"order_items/{MONTH}={NO_VALUE}/*.parquet"))
    whole = dashboard.revenue_by_category(dated.within(SalesFilter()))
    assert row_set(whole) == {("Office", 150.0)}
    january = SalesFilter(start=date(2024, 1, 1), end=date(2024, 1, 31))
    assert row_set(dashboard.revenue_by_category(dated.within(january), january)) == {("Office", 10.0)}
    never = SalesFilter(start=date(2030, 1, 1), end=date(2030, 1, 31))
    assert row_set(dashboard.revenue_by_category(dated.within(never), never)) == set()


def test_a_hot_order_is_stored_whole(spark, tmp_path):
    items = [("o1", "p", 1, 1)] * 3000 + [("o2", "p", 1, 1)] * 10
    tables = retail(
        spark,
        products=[("p", "Pen", "Office", "B", 1, 5)],
        orders=[("o1", "c", "2024-01-31", None, "Delivered", 1), ("o2", "c", "2024-02-01", None, "Delivered", 1)],
        items=items,
    )
    dated = DatedTables(tables, str(tmp_path))
    dated.store()
    assert dated.read("order_items", [202401]).count() == 3000
    assert dated.read("order_items").count() == 3010


def test_an_append_and_a_removal(spark, tmp_path):
    tables = PreparedTables(spark, FOLDER)
    dated = DatedTables(tables, str(tmp_path))
    facts = {"orders": tables.orders, "order_items": tables.order_items}
    some = tables.orders.where("order_year = 1997 AND order_month = 4").select("order_id")
    dated.write({name: rows.join(some, "order_id", "left_anti") for name, rows in facts.items()})
    dated.append({name: rows.join(some, "order_id", "left_semi") for name, rows in facts.items()})
    dated.update_calendar()
    expected = row_set(dashboard.daily_sales(tables, SPRING))
    assert row_set(dashboard.daily_sales(dated.within(SPRING), SPRING)) == expected
    dated.remove(some, [199704])
    dated.update_calendar()
    days = {d for d, _ in row_set(dashboard.daily_sales(dated.within(SPRING), SPRING))}
    assert days == {d for d, _ in expected if d.month != 4}


def test_lines_are_not_sorted_to_find_their_month(spark, tmp_path):
    tables = PreparedTables(spark, FOLDER)
    dated = DatedTables(tables, str(tmp_path))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        orders = dated.dated_orders({"orders": tables.orders})
        lines = dated.dated_others({"order_items": tables.order_items}, orders)["order_items"]
        plan = lines._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "ShuffledHashJoin" in plan and "Sort" not in plan
