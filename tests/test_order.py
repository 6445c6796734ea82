"""Lists that a report shows in order come in that order."""

from __future__ import annotations

import pytest

from tillroll.plans.registry import QUERIES

FOLDER = "/root/testdata/sf0.01"


def nulls_first(value):
    return (value is not None, value)


@pytest.mark.parametrize(
    ("key", "by"),
    [
        ("q02_monthly_revenue", [("order_year", 1), ("order_month", 1)]),
        ("q03_yearly_revenue", [("order_year", 1)]),
        ("q04_top_days", [("daily_revenue", -1), ("order_day", 1)]),
        ("q06_top_customers", [("total_spent", -1)]),
        ("q07_top_products", [("total_revenue", -1)]),
        ("q08_top_categories", [("total_revenue", -1), ("category", 1)]),
        ("q09_revenue_by_city", [("revenue", -1), ("city", 1)]),
        ("q10_revenue_by_state", [("revenue", -1), ("state", 1)]),
        ("q11_revenue_by_brand", [("revenue", -1), ("brand", 1)]),
        ("q15_payment_methods", [("total_revenue", -1)]),
        ("q17_low_stock", [("stock_quantity", 1)]),
        ("d09_top_product_names", [("revenue", -1), ("product_name", 1)]),
        ("d10_top_brands", [("revenue", -1), ("brand", 1)]),
        ("d13_top_customer_names", [("revenue", -1), ("customer_name", 1)]),
        ("d14_top_states", [("revenue", -1), ("state", 1)]),
        ("d16_profit_by_category", [("profit", -1), ("category", 1)]),
        ("d18_low_stock_report", [("stock_quantity", 1)]),
        ("d18_lowest_stock", [("stock_quantity", 1)]),
        ("m11_revenue_by_weekday", [("weekday", 1)]),
        ("m12_top_states", [("total_revenue", -1), ("customer_state", 1)]),
        ("m13_top_categories", [("total_revenue", -1), ("category", 1)]),
        ("v_customer_segment_counts", [("customers", -1), ("rfm_segment", 1)]),
    ],
)
def test_rows_come_in_order(spark, key, by):
    rows = QUERIES[key](spark, FOLDER).collect()
    expected = list(rows)
    for column, direction in reversed(by):
        expected.sort(key=lambda r: nulls_first(r[column]), reverse=direction < 0)
    assert [[r[c] for c, _ in by] for r in rows] == [[r[c] for c, _ in by] for r in expected]
    assert len(rows) > 1
