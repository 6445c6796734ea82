"""Revenue, ranking, retention, payment, profit and stock analyses.

Sums are taken per key before a join wherever the join key allows it. The
partial sums absorb a hot customer or product inside each task, and the join
then meets one row per key on both sides.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillroll.functions.money import reported
from tillroll.functions.ratios import ratio, rounded_ratio
from tillroll.model import RetailTables
from tillroll.operators import averages, membership, periods, ranking, toplists
from tillroll.operators.filters import SalesFilter, orders_in_scope
from tillroll.plans.rollups import profit_of_product, sales_per_product
from tillroll.sources.catalog import replace_view

DELIVERED = "Delivered"
CANCELLED = "Cancelled"
PENDING = "Pending"


def total_revenue(t: RetailTables, status: str = DELIVERED) -> DataFrame:
    return _with_status(t, status).agg(reported(F.sum("total_amount")).alias("total_revenue"))


def monthly_revenue(t: RetailTables, status: str = DELIVERED) -> DataFrame:
    return (
        _with_status(t, status)
        .groupBy("order_year", "order_month")
        .agg(reported(F.sum("total_amount")).alias("monthly_revenue"))
        .orderBy("order_year", "order_month")
    )


def yearly_revenue(t: RetailTables, status: str = DELIVERED) -> DataFrame:
    return (
        _with_status(t, status)
        .groupBy("order_year")
        .agg(reported(F.sum("total_amount")).alias("yearly_revenue"))
        .orderBy("order_year")
    )


def top_days(t: RetailTables, n: int = 10, status: str = DELIVERED) -> DataFrame:
    daily = (
        _with_status(t, status)
        .groupBy(F.to_date("order_date").alias("order_day"))
        .agg(reported(F.sum("total_amount")).alias("daily_revenue"))
    )
    return toplists.top_n(daily, "daily_revenue", n, "order_day")


def average_order_value(t: RetailTables, status: str = DELIVERED) -> DataFrame:
    mean = rounded_ratio(F.sum("total_amount"), F.count("total_amount"))
    return _with_status(t, status).agg(mean.alias("average_order_value"))


def top_customers(t: RetailTables, n: int = 10, status: str = DELIVERED) -> DataFrame:
    spenders = _spend_per_customer(t, status).join(
        t.customers.select("customer_id", "customer_name", "city", "state"), "customer_id"
    )
    best = toplists.top_n(spenders, "total_spent", n, "customer_id")
    return best.select(
        "customer_name", "city", "state", reported("total_spent").alias("total_spent")
    )


def top_products(t: RetailTables, n: int = 10, status: str = DELIVERED) -> DataFrame:
    sold = _sales_per_product(t, status).join(
        t.products.select("product_id", "product_name", "category"), "product_id"
    )
    best = toplists.top_n(sold, "revenue", n, "product_id")
    return best.select("product_name", "category", reported("revenue").alias("total_revenue"))


def top_categories(t: RetailTables, n: int = 10, status: str = DELIVERED) -> DataFrame:
    by_category = _revenue_by_product_column(t, "category", "total_revenue", status)
    return toplists.top_n(by_category, "total_revenue", n, "category")


def revenue_by_city(t: RetailTables, n: int = 10, status: str = DELIVERED) -> DataFrame:
    return toplists.top_n(_revenue_by_customer_column(t, "city", status), "revenue", n, "city")


def revenue_by_state(t: RetailTables, status: str = DELIVERED) -> DataFrame:
    return _revenue_by_customer_column(t, "state", status).orderBy(F.desc("revenue"), "state")


def revenue_by_brand(t: RetailTables, status: str = DELIVERED) -> DataFrame:
    by_brand = _revenue_by_product_column(t, "brand", "revenue", status)
    return by_brand.orderBy(F.desc("revenue"), "brand")


def repeat_customer_percentage(t: RetailTables) -> DataFrame:
    """Customers with more than one order, of those with any, over all statuses."""
    per_customer = t.orders.groupBy("customer_id").agg(F.count("order_id").alias("num_orders"))
    repeaters = F.count_if(F.col("num_orders") > 1)
    return per_customer.agg(
        ratio(repeaters * F.lit(100.0), F.count(F.lit(1))).alias("repeat_customer_percentage")
    )


def cancelled_orders(t: RetailTables) -> DataFrame:
    return _with_status(t, CANCELLED).agg(
        F.count(F.lit(1)).alias("cancelled_orders"),
        reported(F.sum("total_amount")).alias("lost_revenue"),
    )


def pending_orders(t: RetailTables) -> DataFrame:
    return _with_status(t, PENDING).agg(
        F.count(F.lit(1)).alias("pending_orders"),
        reported(F.sum("total_amount")).alias("pending_revenue"),
    )


def payment_methods(t: RetailTables, status: str = DELIVERED) -> DataFrame:
    return (
        _with_status(t, status)
        .groupBy("payment_method")
        .agg(
            F.count(F.lit(1)).alias("transaction_count"),
            reported(F.sum("total_amount")).alias("total_revenue"),
        )
        .orderBy(F.desc("total_revenue"), "payment_method")
    )


def profit_margin(t: RetailTables, status: str = DELIVERED) -> DataFrame:
    costs = t.products.select("product_id", "cost_price")
    delivered = _sales_per_product(t, status).join(costs, "product_id", "left")
    total_profit = F.sum(profit_of_product())
    return delivered.agg(
        reported(total_profit).alias("total_profit"),
        rounded_ratio(total_profit * 100, F.sum("revenue")).alias(
            "overall_profit_margin_percentage"
        ),
    )


def low_stock(t: RetailTables, threshold: int = 50) -> DataFrame:
    return (
        t.products.where(F.col("stock_quantity") < threshold)
        .orderBy("stock_quantity", "product_id")
        .select("product_name", "category", "stock_quantity")
    )


def monthly_growth(t: RetailTables, status: str = DELIVERED) -> DataFrame:
    """Growth against the preceding month that has sales; NULL for the first."""
    monthly = (
        _with_status(t, status)
        .groupBy("order_year", "order_month")
        .agg(F.sum("total_amount").alias("revenue"))
    )
    before = F.col("prev_month_revenue")
    growth = rounded_ratio((F.col("revenue") - before) * 100, before)
    return periods.with_previous_row(monthly, "revenue", "prev_month_revenue").select(
        "order_year",
        "order_month",
        reported("revenue").alias("revenue"),
        reported("prev_month_revenue").alias("prev_month_revenue"),
        growth.alias("growth_rate_percentage"),
    )


def customer_rank_by_state(t: RetailTables, up_to: int = 3, status: str = DELIVERED) -> DataFrame:
    spenders = _spend_per_customer(t, status).join(
        t.customers.select("customer_id", "customer_name", "state"), "customer_id"
    )
    ranked = ranking.rank_within(spenders, "state", "total_spent", "customer_id", up_to)
    return ranked.select(
        "state",
        "customer_name",
        reported("total_spent").alias("total_spent"),
        F.col("row_num").cast("int").alias("row_num"),
        F.col("rank_val").cast("int").alias("rank_val"),
        "dense_rank_val",
    )


def biggest_order_customer(t: RetailTables) -> DataFrame:
    """Who placed the largest single order, whatever its status."""
    buyer = toplists.largest(t.orders, "total_amount", "customer_id", "order_id")
    return t.customers.where(F.col("customer_id") == buyer).select("customer_name", "city")


def products_never_sold(t: RetailTables, chosen: SalesFilter = SalesFilter()) -> DataFrame:
    """Products without a line, or without one in the chosen days and states."""
    sold = t.order_items
    if chosen.narrows_orders:
        orders = orders_in_scope(t.orders, t.customers, chosen).select("order_id")
        sold = sold.join(orders, "order_id", "left_semi")
    unsold = membership.not_in(t.products, sold, "product_id")
    return unsold.select("product_name", "category")


def orders_above_city_average(t: RetailTables) -> DataFrame:
    above = averages.above_group_average(
        t.orders.select("order_id", "customer_id", "total_amount"),
        t.customers.select("customer_id", "customer_name", "city"),
        key="customer_id",
        group="city",
        value="total_amount",
    )
    return above.select(
        "order_id", "customer_name", "city", reported("total_amount").alias("total_amount")
    )


def high_value_customers(
    t: RetailTables, above: int = 50_000, view: str = "high_value_customers"
) -> DataFrame:
    """Customers whose orders of any status sum to more than ``above``, as a view."""
    spend = t.orders.groupBy("customer_id").agg(F.sum("total_amount").alias("total_spent"))
    rows = spend.where(F.col("total_spent") > above).join(
        t.customer_names, "customer_id"
    )
    return replace_view(
        rows.select("customer_id", "customer_name", reported("total_spent").alias("total_spent")),
        view,
    )


def customer_orders(t: RetailTables, customer_id: str | int) -> DataFrame:
    """All orders of one customer; the condition reaches the scan."""
    return t.orders.where(F.col("customer_id") == F.lit(customer_id))


def row_counts(t: RetailTables) -> DataFrame:
    counts = [
        df.agg(F.count(F.lit(1)).alias("row_count")).select(
            F.lit(name).alias("table_name"), "row_count"
        )
        for name, df in t.named().items()
    ]
    return reduce(DataFrame.unionByName, counts)


def _with_status(t: RetailTables, status: str) -> DataFrame:
    return t.orders.where(F.col("order_status") == status)


def _spend_per_customer(t: RetailTables, status: str) -> DataFrame:
    return _with_status(t, status).groupBy("customer_id").agg(
        F.sum("total_amount").alias("total_spent")
    )


def _revenue_by_customer_column(t: RetailTables, column: str, status: str) -> DataFrame:
    return (
        _spend_per_customer(t, status)
        .join(t.customers.select("customer_id", column), "customer_id")
        .groupBy(column)
        .agg(reported(F.sum("total_spent")).alias("revenue"))
    )


def _sales_per_product(t: RetailTables, status: str) -> DataFrame:
    return sales_per_product(t.order_items, _with_status(t, status))


def _revenue_by_product_column(
    t: RetailTables, column: str, name: str, status: str
) -> DataFrame:
    return (
        _sales_per_product(t, status)
        .join(t.products.select("product_id", column), "product_id")
        .groupBy(column)
        .agg(reported(F.sum("revenue")).alias(name))
    )
