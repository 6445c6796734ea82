"""What the physical plans must and must not contain."""

from __future__ import annotations

import re

import pytest

from tillroll.model import RetailTables
from tillroll.plans import sales
from tillroll.plans.registry import QUERIES
from tillroll.sources.files import replace_table
from tillroll.sources.warehouse import WarehouseTables

FOLDER = "/root/testdata/sf0.001"
WRITES_FIRST = {
    "p06_csv_roundtrip",
    "p07_table_replace",
    "p08_csv_load",
    "p09_low_stock_export",
    "k04_refresh_marts",
    "k05_catalog_tables",
}


def physical(spark, key) -> str:
    return QUERIES[key](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("key", sorted(set(QUERIES) - WRITES_FIRST))
def test_plan_stays_in_the_jvm_without_row_pairs(spark, key):
    plan = physical(spark, key)
    for node in ("Python", "Arrow", "MapInPandas", "CartesianProduct", "BroadcastNestedLoopJoin"):
        assert node not in plan


@pytest.mark.parametrize(
    ("key", "pushed"),
    [
        ("q01_total_revenue", "EqualNullSafe(o_orderstatus,F)"),
        ("q06_top_customers", "EqualNullSafe(o_orderstatus,F)"),
        ("q07_top_products", "EqualNullSafe(o_orderstatus,F)"),
        ("q17_low_stock", "LessThan(p_size,10)"),
        ("q24_customer_orders", "EqualTo(o_custkey,1)"),
        ("d01_filtered_sales", "GreaterThanOrEqual(o_orderdate,1997-01-01T00:00)"),
        ("d06_daily_sales", "GreaterThanOrEqual(o_orderdate,1997-01-01T00:00)"),
        ("d10_top_brands", "In(p_type, [ECONOMY,LARGE,SMALL])"),
        ("m16_year_quarter_slice", "GreaterThanOrEqual(o_orderdate,1997-04-01T00:00)"),
    ],
)
def test_filters_reach_the_scan(spark, key, pushed):
    spark.conf.set("spark.sql.maxMetadataStringLength", "4000")
    try:
        assert pushed in physical(spark, key)
    finally:
        spark.conf.unset("spark.sql.maxMetadataStringLength")


def test_status_condition_reaches_a_stored_orders_table(spark, tmp_path):
    orders = WarehouseTables(spark, FOLDER).orders
    stored = replace_table(orders, str(tmp_path / "orders"))
    plan = sales.pending_orders(RetailTables(None, None, stored, None))
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(order_status,Pending)" in text
    assert "ReadSchema: struct<order_status:string,total_amount:decimal(18,2)>" in text


@pytest.mark.parametrize(
    ("key", "table", "columns"),
    [
        ("q03_yearly_revenue", "orders", {"o_orderstatus", "o_totalprice", "o_orderdate"}),
        ("q12_repeat_customer_pct", "orders", {"o_orderkey", "o_custkey"}),
        ("d11_items_by_category", "lineitem", {"l_orderkey", "l_partkey", "l_quantity"}),
        ("d18_low_stock_count", "part", {"p_size"}),
        ("m08_installment_groups", "orders", {"o_orderkey", "o_orderpriority"}),
        ("v_monthly_sales", "lineitem", {"l_orderkey", "l_extendedprice"}),
    ],
)
def test_scans_read_only_the_needed_columns(spark, key, table, columns):
    spark.conf.set("spark.sql.maxMetadataStringLength", "4000")
    try:
        found = re.findall(rf"{table}\.parquet.*?ReadSchema: struct<([^>]*)>", physical(spark, key))
    finally:
        spark.conf.unset("spark.sql.maxMetadataStringLength")
    assert {field.split(":")[0] for field in found[0].split(",")} == columns


@pytest.mark.parametrize(
    "key", ["q18_monthly_growth", "m04_mom_growth", "m14_payment_share", "m15_delivery_histogram"]
)
def test_single_partition_windows_run_on_aggregated_rows(spark, key):
    plan = physical(spark, key)
    below_window = plan.split("Exchange SinglePartition", 1)[1]
    assert "Exchange hashpartitioning" in below_window and "HashAggregate" in below_window


def test_lines_shuffle_once_for_revenue_by_payment_method(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = physical(spark, "d08_revenue_by_payment")
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    exchanges = re.findall(r"Exchange hashpartitioning\((\w+)#", plan)
    assert sorted(exchanges) == ["order_id", "order_id", "payment_method"]
    # the lines are summed per order below their exchange
    assert plan.count("partial_sum") == 2


def scans(plan: str, table: str) -> int:
    return len(re.findall(rf"FileScan parquet [^\n]*{table}\.parquet", plan))


@pytest.mark.parametrize(
    ("key", "lines"),
    [
        ("m01_core_kpis", 1),
        ("m02_on_time_pct", 1),
        ("m03_avg_delivery_days", 1),
        ("m12_state_details", 1),
        ("m15_delivery_histogram", 1),
        ("v_regional_sales", 1),
        ("v_sales_summary", 2),
        ("v_seller_performance", 2),
        ("m13_category_details", 2),
        ("d02_filter_options", 2),
        ("d03_home_kpis", 1),
    ],
)
def test_the_lines_are_read_as_often_as_needed(spark, key, lines):
    spark.conf.set("spark.sql.maxMetadataStringLength", "4000")
    try:
        assert scans(physical(spark, key), "lineitem") == lines
    finally:
        spark.conf.unset("spark.sql.maxMetadataStringLength")


@pytest.mark.parametrize("key", ["d03_home_kpis", "d05_order_status_counts", "d06_daily_sales", "d17_daily_profit", "m16_year_quarter_slice"])
def test_a_filter_on_orders_meets_the_lines_before_they_are_summed(spark, key):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = physical(spark, key)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    # Children are printed below their parents: the first sum of the lines stands above a join.
    depth = {}
    for line in plan.split("\n"):
        mark = re.search(r"[A-Z*]", line)
        indent = mark.start() if mark else 0
        depth = {d: n for d, n in depth.items() if d < indent} | {indent: line}
        if "lineitem" in line and "FileScan" in line:
            above = [depth[d] for d in sorted(depth)]
            joins = [i for i, n in enumerate(above) if "Join" in n]
            sums = [i for i, n in enumerate(above) if "HashAggregate" in n]
            assert joins and max(joins) > max(sums)
