"""A third of all rows under one key: right results, and the hot part is split."""

from __future__ import annotations

import contextlib
import re
from datetime import date

import pytest
from tables import row_set, rows

from tillroll.model import RetailTables, StoreModel
from tillroll.operators.filters import SalesFilter
from tillroll.plans import dashboard, marts, measures, preparation, sales

LINES = 60_000


@contextlib.contextmanager
def settings(spark, **values):
    old = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


# No broadcast, and limits that make a test-sized hot key count as oversized.
SMALL_LIMITS = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20KB",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20KB",
    "spark.sql.adaptive.coalescePartitions.enabled": "false",
}


@pytest.fixture(scope="module")
def hot(spark):
    """Order 0, product 0 and customer 0 each hold a third of their rows."""
    ids = spark.range(0, LINES, 1, 16)
    items = ids.selectExpr(
        "id AS order_item_id",
        "if(id % 3 = 0, 0, id % 6000) AS order_id",
        "if(id % 3 = 1, 0, id % 500) AS product_id",
        "cast(id % 5 + 1 AS int) AS quantity",
        "cast(id % 97 + 0.25 AS decimal(18,2)) AS unit_price",
    )
    orders = spark.range(0, 6000, 1, 16).selectExpr(
        "id AS order_id",
        "if(id % 3 = 0, 0, id % 700) AS customer_id",
        "timestamp_ntz'2024-01-01' + make_dt_interval(cast(id % 300 AS int)) AS order_date",
        "if(id % 7 = 0, 'Card', 'UPI') AS payment_method",
        "if(id % 4 = 3, 'Pending', 'Delivered') AS order_status",
        "cast(id % 89 + 1 AS decimal(18,2)) AS total_amount",
    )
    products = spark.range(0, 500, 1, 4).selectExpr(
        "id AS product_id", "concat('n', id % 50) AS product_name",
        "if(id % 3 = 0, 'hot', concat('c', id % 5)) AS category", "concat('b', id % 9) AS brand",
        "cast(id % 11 + 0.5 AS decimal(18,2)) AS cost_price", "cast(id % 80 AS int) AS stock_quantity",
    )
    customers = spark.range(0, 700, 1, 4).selectExpr(
        "id AS customer_id", "concat('k', id) AS customer_name",
        "if(id % 3 = 0, 'hot', concat('y', id % 40)) AS city",
        "if(id % 3 = 0, 'hot', concat('s', id % 4)) AS state",
    )
    return RetailTables(customers, products, preparation.with_calendar(orders), items)


@pytest.fixture(scope="module")
def pandas_master(hot):
    items, orders = hot.order_items.toPandas(), hot.orders.toPandas()
    for frame, columns in ((items, ["unit_price"]), (orders, ["total_amount"])):
        for c in columns:
            frame[c] = frame[c].astype(float)
    products, customers = hot.products.toPandas(), hot.customers.toPandas()
    products["cost_price"] = products["cost_price"].astype(float)
    lines = items.merge(orders, on="order_id", how="left").merge(products, on="product_id", how="left")
    lines = lines.merge(customers, on="customer_id", how="left")
    lines["amount"] = lines.unit_price * lines.quantity
    lines["profit"] = (lines.unit_price - lines.cost_price) * lines.quantity
    return lines, orders.merge(customers, on="customer_id", how="left")


def final_plan(df) -> str:
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def test_hot_order_is_split_in_the_line_join(spark, hot, pandas_master):
    lines, _ = pandas_master
    with settings(spark, **SMALL_LIMITS):
        plan = sales.revenue_by_brand(hot)
        assert "SortMergeJoin(skew=true)" in final_plan(plan)
        found = dict(rows(plan))
    delivered = lines[lines.order_status == "Delivered"]
    assert found == pytest.approx(delivered.groupby("brand").amount.sum().to_dict())


def test_hot_product_is_split_when_lines_look_up_costs(spark, hot, pandas_master):
    lines, _ = pandas_master
    with settings(spark, **SMALL_LIMITS):
        plan = preparation.with_profit(hot.order_items, hot.products)
        assert "SortMergeJoin(skew=true)" in final_plan(plan)
        total = plan.selectExpr("cast(sum(profit) as double)", "count(*)").first()
    assert total[0] == pytest.approx(lines.profit.sum()) and total[1] == LINES


def test_hot_order_is_split_in_the_master(spark, hot):
    with settings(spark, **SMALL_LIMITS):
        master = preparation.sales_master(hot)
        assert final_plan(master).split("SortMergeJoin", 1)[1].startswith("(skew=true)")
        assert master.count() == LINES


def test_hot_customer_is_split_above_the_city_average(spark, hot, pandas_master):
    _, orders = pandas_master
    with settings(spark, **SMALL_LIMITS):
        plan = sales.orders_above_city_average(hot)
        assert "skew=true" in final_plan(plan)
        found = {r[0] for r in rows(plan)}
    means = orders.groupby("city").total_amount.transform("mean")
    assert found == set(orders[orders.total_amount > means].order_id)


def test_sums_per_order_shrink_the_hot_order_before_the_shuffle(spark, hot, pandas_master):
    lines, _ = pandas_master
    with settings(spark, **SMALL_LIMITS):
        found = dict(rows(dashboard.revenue_by_payment_method(hot)))
        kpis = rows(dashboard.home_kpis(hot))[0]
    assert found == pytest.approx(lines.groupby("payment_method").amount.sum().to_dict())
    assert kpis[:2] == pytest.approx((lines.amount.sum(), lines.profit.sum()))
    assert kpis[2:] == (lines.order_id.nunique(), lines.customer_id.nunique())


def test_filtered_pages_on_hot_keys(spark, hot, pandas_master):
    lines, _ = pandas_master
    chosen = SalesFilter(date(2024, 2, 1), date(2024, 5, 31), ("hot", "c1"), ("hot", "s1"))
    kept = lines[
        (lines.order_date >= "2024-02-01") & (lines.order_date < "2024-06-01")
        & lines.category.isin(["hot", "c1"]) & lines.state.isin(["hot", "s1"])
    ]
    with settings(spark, **SMALL_LIMITS):
        assert dict(rows(dashboard.profit_by_category(hot, chosen))) == pytest.approx(
            kept.groupby("category").profit.sum().to_dict()
        )
        assert dict(rows(dashboard.order_status_counts(hot, chosen))) == (
            kept.groupby("order_status").order_id.nunique().to_dict()
        )
        assert dashboard.filtered_sales(hot, chosen).count() == len(kept)


def test_hot_state_sends_a_few_rows_per_task_to_the_ranking(spark, hot, pandas_master):
    _, orders = pandas_master
    plan = sales.customer_rank_by_state(hot)
    before_shuffle = re.split(r"Exchange hashpartitioning\(state#\d+, \d+\)", final_plan(plan))[1]
    assert "WindowGroupLimit" in before_shuffle.split("Exchange")[0]
    spend = orders[orders.order_status == "Delivered"].groupby(["state", "customer_id"]).total_amount.sum()
    place = spend.groupby("state").rank(method="min", ascending=False)
    wanted = {(s, f"k{c}", spend[s, c], int(p)) for (s, c), p in place.items() if p <= 3}
    assert {(r[0], r[1], r[2], r[4]) for r in rows(plan)} == wanted


def test_a_hot_value_is_numbered_in_pieces(spark):
    """A third of the customers share the top total of the hot state."""
    customers = spark.range(0, 9000, 1, 8).selectExpr(
        "id AS customer_id", "concat('k', id) AS customer_name", "'x' AS city",
        "if(id % 2 = 0, 'hot', concat('s', id % 5)) AS state",
    )
    orders = spark.range(0, 9000, 1, 8).selectExpr(
        "id AS customer_id", "'Delivered' AS order_status",
        "cast(if(id % 3 = 0, 500, id % 400) AS decimal(18,2)) AS total_amount",
    )
    ranked = sales.customer_rank_by_state(RetailTables(customers, None, orders, None))
    hot = ranked.where("state = 'hot'").collect()
    assert len(hot) == 1500 and {r.rank_val for r in hot} == {1}
    assert sorted(r.row_num for r in hot) == list(range(1, 1501))


def test_hot_order_is_split_in_the_sales_summary(spark):
    lines = spark.range(0, LINES, 1, 16).selectExpr(
        "if(id % 3 = 0, 0, id % 6000) AS order_id", "id % 500 AS product_id", "id % 90 AS seller_id",
        "cast(id % 97 + 0.25 AS decimal(18,2)) AS price",
    )
    orders = spark.range(0, 6000, 1, 16)
    model = StoreModel(
        orders=orders.selectExpr(
            "id AS order_id", "if(id % 3 = 0, 0, id % 700) AS customer_id",
            "timestamp_ntz'2024-01-01' AS order_purchase_timestamp",
            "timestamp_ntz'2024-01-03' AS order_delivered_customer_date",
            "timestamp_ntz'2024-01-09' AS order_estimated_delivery_date",
        ),
        order_items=lines,
        order_payments=orders.selectExpr(
            "id AS order_id", "'card' AS payment_type", "1 AS payment_installments",
            "cast(1 AS decimal(18,2)) AS payment_value",
        ),
        order_reviews=orders.selectExpr("id AS order_id", "cast(id % 5 + 1 AS int) AS review_score"),
        customers=spark.range(700).selectExpr(
            "id AS customer_id", "id AS customer_unique_id", "concat('s', id % 9) AS customer_state"
        ),
        products=spark.range(500).selectExpr("id AS product_id", "concat('c', id % 7) AS category"),
        sellers=spark.range(90).selectExpr("id AS seller_id", "concat('n', id) AS seller_name"),
    )
    with settings(spark, **SMALL_LIMITS):
        summary = marts.sales_summary(model)
        top_join = final_plan(summary).split("SortMergeJoin", 1)[1]
        assert top_join.startswith("(skew=true)")
        assert summary.count() == LINES
        by_part = measures.core_kpis(measures.part_facts(model, "category", "review_score"), "category")
        from_summary = marts.category_performance(
            marts.summary_facts(summary, "category", "review_score")
        )
        assert row_set(by_part) == row_set(from_summary)


def test_hot_duplicate_leaves_one_row_per_task_before_the_shuffle(spark):
    raw = spark.range(0, 9000, 1, 8).selectExpr(
        "if(id % 3 = 0, 0, id) AS customer_id", "'n' AS customer_name", "string(null) AS email"
    )
    plan = preparation.clean_customers(raw)
    before_shuffle = final_plan(plan).split("Exchange hashpartitioning(customer_id")[1]
    assert "WindowGroupLimit" in before_shuffle
    assert len(row_set(plan.select("customer_id"))) == 6001
