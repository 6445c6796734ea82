"""NULLs, ties, gaps and empty tables in the sales analyses."""

from __future__ import annotations

import pytest
from tables import retail, row_set, rows

from tillroll.plans import sales

D, C = "Delivered", "Cancelled"


def order(n, customer="c1", when="2024-01-10", amount=10, status=D, method="UPI"):
    return (f"o{n}", customer, when, method, status, amount)


def test_growth_after_a_gap_uses_the_last_month_with_sales(spark):
    t = retail(spark, orders=[
        order(1, when="2024-01-05", amount=100),
        order(2, when="2024-03-05", amount=150),
        order(3, when="2024-04-05", amount=75),
    ])
    assert rows(sales.monthly_growth(t).orderBy("order_year", "order_month")) == [
        (2024, 1, 100.0, None, None),
        (2024, 3, 150.0, 100.0, 50.0),
        (2024, 4, 75.0, 150.0, -50.0),
    ]


def test_growth_from_a_month_without_revenue_is_null(spark):
    t = retail(spark, orders=[
        order(1, when="2024-01-05", amount=0),
        order(2, when="2024-02-05", amount=5),
    ])
    assert rows(sales.monthly_growth(t).orderBy("order_month"))[1] == (2024, 2, 5.0, 0.0, None)


def test_growth_crosses_the_year(spark):
    t = retail(spark, orders=[
        order(1, when="2023-12-31", amount=10),
        order(2, when="2024-01-01", amount=20),
    ])
    assert (2024, 1, 20.0, 10.0, 100.0) in row_set(sales.monthly_growth(t))


def test_ranks_with_equal_totals(spark):
    totals = {"c1": 50, "c2": 50, "c3": 40, "c4": 30, "c5": 90}
    t = retail(
        spark,
        customers=[(c, f"name {c}", "x", "north") for c in totals],
        orders=[order(n, customer=c, amount=a) for n, (c, a) in enumerate(totals.items())],
    )
    ranked = sales.customer_rank_by_state(t)
    assert row_set(ranked.drop("row_num")) == {
        ("north", "name c5", 90.0, 1, 1),
        ("north", "name c1", 50.0, 2, 2),
        ("north", "name c2", 50.0, 2, 2),
    }
    # any order among equals will do, but no number twice
    assert {(r.row_num, r.rank_val) for r in ranked.collect()} == {(1, 1), (2, 2), (3, 2)}


def test_ranks_of_customers_without_a_state(spark):
    t = retail(
        spark,
        customers=[("c1", "a", "x", None), ("c2", "b", "x", None), ("c3", "c", "x", "n")],
        orders=[order(1, "c1", amount=5), order(2, "c2", amount=8), order(3, "c3", amount=1),
                order(4, "c3", amount=None)],
    )
    assert row_set(sales.customer_rank_by_state(t)) == {
        (None, "b", 8.0, 1, 1, 1), (None, "a", 5.0, 2, 2, 2), ("n", "c", 1.0, 1, 1, 1)
    }


def test_ranks_keep_all_customers_tied_on_the_last_rank(spark):
    t = retail(
        spark,
        customers=[(f"c{n}", f"name {n}", "x", "north") for n in range(5)],
        orders=[order(n, customer=f"c{n}", amount=7) for n in range(5)],
    )
    ranked = rows(sales.customer_rank_by_state(t))
    assert sorted(r[3] for r in ranked) == [1, 2, 3, 4, 5]
    assert {(r[4], r[5]) for r in ranked} == {(1, 1)}


def test_only_delivered_orders_count_in_ranks(spark):
    t = retail(
        spark,
        customers=[("c1", "a", "x", "north"), ("c2", "b", "x", "north")],
        orders=[order(1, "c1", amount=5), order(2, "c2", amount=500, status=C)],
    )
    assert row_set(sales.customer_rank_by_state(t)) == {("north", "a", 5.0, 1, 1, 1)}


def test_payment_methods_keep_the_null_group(spark):
    t = retail(spark, orders=[order(1, method=None), order(2), order(3, method=None)])
    assert row_set(sales.payment_methods(t)) == {(None, 2, 20.0), ("UPI", 1, 10.0)}


PRODUCTS = [
    ("p1", "lamp", "home", "b", 5, 3),
    ("p2", "vase", "home", "b", 5, 60),
    (None, "ghost", "home", "b", 5, 70),
]


@pytest.mark.parametrize(
    ("sold", "expected"),
    [
        ([("o1", "p1", 1, 9)], {("vase", "home")}),
        ([("o1", "p1", 1, 9), ("o1", None, 1, 9)], set()),
        ([], {("lamp", "home"), ("vase", "home"), ("ghost", "home")}),
        ([("o1", "p9", 1, 9)], {("lamp", "home"), ("vase", "home")}),
    ],
)
def test_never_sold_follows_not_in(spark, sold, expected):
    t = retail(spark, products=PRODUCTS, items=sold)
    assert row_set(sales.products_never_sold(t)) == expected


def test_city_average_ignores_customers_without_a_city(spark):
    t = retail(
        spark,
        customers=[("c1", "a", "x", "n"), ("c2", "b", "x", "n"), ("c3", "d", None, "n")],
        orders=[
            order(1, "c1", amount=10),
            order(2, "c2", amount=20, status=C),
            order(3, "c3", amount=99),
            order(4, "c3", amount=1),
            order(5, "c9", amount=500),
        ],
    )
    assert row_set(sales.orders_above_city_average(t)) == {("o2", "b", "x", 20.0)}


def test_an_order_equal_to_the_average_is_not_above_it(spark):
    t = retail(
        spark,
        customers=[("c1", "a", "x", "n")],
        orders=[order(n, "c1", amount=0.1) for n in range(3)],
    )
    assert rows(sales.orders_above_city_average(t)) == []


def test_namesakes_stay_apart_by_id(spark):
    t = retail(
        spark,
        customers=[("c1", "same", "x", "n"), ("c2", "same", "y", "n")],
        orders=[order(1, "c1", amount=5), order(2, "c2", amount=6)],
    )
    assert rows(sales.top_customers(t)) == [("same", "y", "n", 6.0), ("same", "x", "n", 5.0)]


def test_profit_skips_unknown_products_but_revenue_does_not(spark):
    t = retail(
        spark,
        products=[("p1", "lamp", "home", "b", 6, 1)],
        orders=[order(1), order(2, status=C)],
        items=[("o1", "p1", 2, 10), ("o1", "p7", 1, 20), ("o2", "p1", 5, 99)],
    )
    assert rows(sales.profit_margin(t)) == [(8.0, 20.0)]


def test_profit_margin_without_revenue_is_null(spark):
    t = retail(
        spark,
        products=[("p1", "lamp", "home", "b", 6, 1)],
        orders=[order(1)],
        items=[("o1", "p1", 2, 0)],
    )
    assert rows(sales.profit_margin(t)) == [(-12.0, None)]


def test_ties_in_a_top_list_go_to_the_smaller_key(spark):
    t = retail(
        spark,
        orders=[order(1, when="2024-02-02"), order(2, when="2024-01-01"), order(3, when="2024-03-03")],
    )
    days = [str(r[0]) for r in rows(sales.top_days(t, n=2))]
    assert days == ["2024-01-01", "2024-02-02"]


def test_largest_order_counts_any_status(spark):
    t = retail(
        spark,
        customers=[("c1", "a", "x", "n"), ("c2", "b", "y", "n")],
        orders=[order(1, "c1", amount=5), order(2, "c2", amount=9, status=C)],
    )
    assert rows(sales.biggest_order_customer(t)) == [("b", "y")]


def test_high_value_view(spark):
    t = retail(
        spark,
        customers=[("c1", "a", "x", "n"), ("c2", "b", "y", "n")],
        orders=[order(1, "c1", amount=30_000), order(2, "c1", amount=30_000, status=C),
                order(3, "c2", amount=50_000)],
    )
    assert rows(sales.high_value_customers(t)) == [("c1", "a", 60_000.0)]
    assert rows(spark.sql("SELECT customer_name FROM high_value_customers")) == [("a",)]


def test_low_stock_is_strictly_below_the_threshold(spark):
    t = retail(spark, products=[("p1", "a", "c", "b", 1, 50), ("p2", "d", "c", "b", 1, 49),
                                ("p3", "e", "c", "b", 1, None)])
    assert rows(sales.low_stock(t)) == [("d", "c", 49)]


def test_customer_orders(spark):
    t = retail(spark, orders=[order(1, "c1"), order(2, "c2"), order(3, "c1", status=C)])
    assert {r[0] for r in rows(sales.customer_orders(t, "c1"))} == {"o1", "o3"}


def test_empty_tables(spark):
    t = retail(spark)
    assert rows(sales.total_revenue(t)) == [(None,)]
    assert rows(sales.average_order_value(t)) == [(None,)]
    assert rows(sales.repeat_customer_percentage(t)) == [(None,)]
    assert rows(sales.cancelled_orders(t)) == [(0, None)]
    assert rows(sales.profit_margin(t)) == [(None, None)]
    assert rows(sales.row_counts(t)) == [
        ("customers", 0), ("products", 0), ("orders", 0), ("order_items", 0)
    ]
    for plan in (sales.monthly_growth, sales.customer_rank_by_state, sales.top_products,
                 sales.orders_above_city_average, sales.biggest_order_customer):
        assert rows(plan(t)) == []
