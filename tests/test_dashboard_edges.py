from __future__ import annotations

from datetime import date

import pytest
from tables import retail, row_set, rows

from tillroll.model import RetailTables
from tillroll.operators.filters import SalesFilter
from tillroll.plans import dashboard, preparation


@pytest.fixture(scope="module")
def shop(spark):
    return retail(
        spark,
        customers=[("c1", "same", "x", "north"), ("c2", "same", "y", "south"), ("c3", "solo", "z", None)],
        products=[("p1", "lamp", "home", "b1", 6, 10), ("p2", "lamp", "garden", "b2", 1, 20),
                  ("p3", "rope", None, None, 2, 60)],
        orders=[
            ("o1", "c1", "2024-01-31", "UPI", "Delivered", 1),
            ("o2", "c2", "2024-02-01", None, "Cancelled", 1),
            ("o3", "c3", "2024-02-29", "Card", "Delivered", 1),
            ("o4", "c1", "2024-03-01", "UPI", "Pending", 1),
        ],
        items=[
            ("o1", "p1", 2, 10),
            ("o1", "p2", 1, 5),
            ("o2", "p2", 3, 5),
            ("o3", "p3", 1, 7),
            ("o9", "p1", 1, 100),
            ("o2", "p8", 1, 50),
        ],
    )


def test_kpis_of_everything(spark, shop):
    # o9 is not among the orders: its line counts, its customer is unknown.
    assert rows(dashboard.home_kpis(shop)) == [(197.0, 8.0 + 4.0 + 12.0 + 5.0 + 94.0, 4, 3)]


def test_kpis_with_dates_drop_lines_without_an_order(spark, shop):
    whole = SalesFilter(start=date(2024, 1, 1), end=date(2024, 12, 31))
    assert rows(dashboard.home_kpis(shop, whole)) == [(97.0, 29.0, 3, 3)]


def test_the_last_day_is_included(spark, shop):
    january = SalesFilter(start=date(2024, 1, 1), end=date(2024, 1, 31))
    assert rows(dashboard.home_kpis(shop, january))[0][0] == 25.0
    one_day = SalesFilter(start=date(2024, 2, 29), end=date(2024, 2, 29))
    assert rows(dashboard.home_kpis(shop, one_day))[0][0] == 7.0


def test_one_sided_date_range_is_ignored(spark, shop):
    assert rows(dashboard.home_kpis(shop, SalesFilter(start=date(2024, 2, 1)))) == rows(
        dashboard.home_kpis(shop)
    )


def test_groups_without_a_name_are_left_out(spark, shop):
    assert row_set(dashboard.revenue_by_category(shop)) == {("home", 120.0), ("garden", 20.0)}
    assert row_set(dashboard.revenue_by_payment_method(shop)) == {("UPI", 25.0), ("Card", 7.0)}
    assert row_set(dashboard.top_states(shop)) == {("north", 25.0), ("south", 65.0)}
    assert row_set(dashboard.items_by_category(shop)) == {("home", 3), ("garden", 4)}


def test_namesakes_are_merged(spark, shop):
    assert rows(dashboard.top_product_names(shop)) == [("lamp", 140.0), ("rope", 7.0)]
    assert rows(dashboard.top_customer_names(shop)) == [("same", 90.0), ("solo", 7.0)]


def test_months_are_not_padded(spark, shop):
    assert row_set(dashboard.monthly_sales(shop).select("month_year", "revenue")) == {
        ("2024-1", 25.0), ("2024-2", 72.0)
    }


def test_status_counts_count_orders_not_lines(spark, shop):
    assert row_set(dashboard.order_status_counts(shop)) == {("Delivered", 2), ("Cancelled", 1)}


def test_category_and_state_filters(spark, shop):
    garden = SalesFilter(categories=("garden",))
    assert rows(dashboard.home_kpis(shop, garden)) == [(20.0, 16.0, 2, 2)]
    south = SalesFilter(states=("south",))
    assert rows(dashboard.home_kpis(shop, south)) == [(65.0, 12.0, 1, 1)]
    assert row_set(dashboard.revenue_by_category(shop, south)) == {("garden", 15.0)}
    both = SalesFilter(categories=("home",), states=("south",))
    assert rows(dashboard.home_kpis(shop, both)) == [(0.0, 0.0, 0, 0)]
    assert rows(dashboard.profit_margin(shop, both)) == [(0.0, 0.0, 0.0)]


def test_filtered_lines_agree_with_the_summaries(spark, shop):
    for chosen in (SalesFilter(), SalesFilter(categories=("home", "garden")), SalesFilter(states=("north",)),
                   SalesFilter(start=date(2024, 2, 1), end=date(2024, 3, 1))):
        lines = dashboard.filtered_sales(shop, chosen)
        total = lines.selectExpr(
            "cast(coalesce(sum(unit_price * quantity), 0) as double)",
            "cast(coalesce(sum(profit), 0) as double)",
            "count(distinct order_id)",
            "count(distinct customer_id)",
        )
        assert rows(total) == rows(dashboard.home_kpis(shop, chosen))


def test_stored_profit_gives_the_same_pages_without_products(spark, shop):
    items = preparation.with_profit(shop.order_items, shop.products)
    loaded = RetailTables(shop.customers, shop.products, shop.orders, items)
    garden = SalesFilter(categories=("garden",))
    for page in (dashboard.home_kpis, dashboard.daily_profit, dashboard.profit_by_category):
        for chosen in (SalesFilter(), garden):
            assert row_set(page(loaded, chosen)) == row_set(page(shop, chosen))
    assert row_set(dashboard.filtered_sales(loaded)) == row_set(dashboard.filtered_sales(shop))


def test_filter_options(spark, shop):
    february = SalesFilter(start=date(2024, 2, 1), end=date(2024, 2, 29))
    assert row_set(dashboard.filter_options(shop, february)) == {
        ("category", "garden"), ("category", None), ("state", "south"), ("state", None),
        ("first_day", "2024-01-31"), ("last_day", "2024-02-29"),
    }


def test_margin_is_zero_without_sales(spark):
    assert rows(dashboard.profit_margin(retail(spark))) == [(0.0, 0.0, 0.0)]
    assert rows(dashboard.home_kpis(retail(spark))) == [(0.0, 0.0, 0, 0)]


def test_low_stock_pages(spark, shop):
    assert rows(dashboard.low_stock_count(shop)) == [(2,)]
    assert rows(dashboard.lowest_stock(shop, n=1)) == [("lamp", 10)]
    assert [r[3] for r in rows(dashboard.low_stock_report(shop))] == [10, 20]


def test_customer_acquisition_skips_missing_dates(spark):
    customers = spark.createDataFrame(
        [("a", date(2024, 1, 3)), ("b", date(2024, 1, 9)), ("c", None)],
        "customer_id string, registration_date date",
    )
    assert rows(dashboard.customer_acquisition(customers)) == [("2024-01", 2)]
