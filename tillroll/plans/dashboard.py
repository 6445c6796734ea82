"""Dashboard pages over the filtered sales lines, whatever the order status.

Three grains keep the joins small and free of hot keys:

* order grain: lines are summed per order before they meet the orders;
* product grain: lines are summed per product before they meet the products;
* line grain: only where a report shows the lines themselves.

Groups without a key value are left out, as the dashboard leaves them out.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillroll.functions.dates import plain_month_label, year_month
from tillroll.functions.money import line_amount, reported
from tillroll.functions.ratios import percent_or_zero
from tillroll.model import RetailTables
from tillroll.operators import toplists
from tillroll.operators.filters import (
    SalesFilter,
    apply_filters,
    lines_in_scope,
    orders_in_scope,
    products_in_scope,
)
from tillroll.plans.preparation import sales_master, with_profit
from tillroll.plans.rollups import profit_of_product, sales_per_product

EVERYTHING = SalesFilter()


def filtered_sales(t: RetailTables, chosen: SalesFilter = EVERYTHING) -> DataFrame:
    return apply_filters(sales_master(t), chosen)


def filter_options(t: RetailTables, chosen: SalesFilter = EVERYTHING) -> DataFrame:
    """What the filter widgets offer: option rows by kind.

    Categories and states are those left by the date filter. The first and
    last day are those of all sales.
    """
    dated = SalesFilter(start=chosen.start, end=chosen.end)
    kept = t.order_items.select("order_id", "product_id")
    if dated.has_dates:
        orders = orders_in_scope(t.orders, t.customers, dated)
        kept = kept.join(orders.select("order_id"), "order_id", "left_semi")
    products = kept.select("product_id").distinct()
    categories = products.join(t.products.select("product_id", "category"), "product_id", "left")
    return _options(categories, "category").unionByName(_state_and_day_options(t, dated))


def _state_and_day_options(t: RetailTables, dated: SalesFilter) -> DataFrame:
    """States and days from one pass: sold orders, then their customers, then the states."""
    bought = F.col("order_date")
    inside = dated.date_condition(bought) if dated.has_dates else F.lit(True)
    extent = [
        F.min("first").alias("first"),
        F.max("last").alias("last"),
        F.max("inside").alias("inside"),
    ]
    buyers = (
        t.order_items.select("order_id")
        .distinct()
        .join(t.orders.select("order_id", "customer_id", "order_date"), "order_id", "left")
        .select("customer_id", bought.alias("first"), bought.alias("last"), inside.alias("inside"))
        .groupBy("customer_id")
        .agg(*extent)
    )
    states = (
        buyers.join(t.customers.select("customer_id", "state"), "customer_id", "left")
        .groupBy("state")
        .agg(*extent)
    )
    day = lambda ts: F.to_date(ts).cast("string")
    option = lambda kind, value: F.struct(
        F.lit(kind).alias("option_kind"), value.alias("option_value")
    )
    # One entry per state, so the array is as short as the list that the page shows.
    left = F.collect_list(F.when(F.col("inside"), option("state", F.col("state"))))
    limits = F.array(option("first_day", day(F.min("first"))), option("last_day", day(F.max("last"))))
    options = states.agg(F.concat(left, limits).alias("options"))
    return options.select(F.explode("options").alias("o")).select("o.*")


def home_kpis(t: RetailTables, chosen: SalesFilter = EVERYTHING) -> DataFrame:
    """Revenue, profit, distinct orders, distinct customers.

    Summing per order, then per customer, makes both distinct counts plain
    counts of rows that are already unique.
    """
    return _kpis_of_orders(_sales_per_order(t, chosen, ("customer_id",), profit=True))


def home_kpis_of_parts(parts: Sequence[RetailTables], chosen: SalesFilter = EVERYTHING) -> DataFrame:
    """:func:`home_kpis` of tables that are stored in parts, of which each order lies in one with all its lines."""
    per_order = [_sales_per_order(t, chosen, ("customer_id",), profit=True) for t in parts]
    return _kpis_of_orders(reduce(DataFrame.unionByName, per_order))


def _kpis_of_orders(per_order: DataFrame) -> DataFrame:
    per_customer = per_order.groupBy("customer_id").agg(
        F.sum("revenue").alias("revenue"),
        F.sum("profit").alias("profit"),
        F.count("order_id").alias("orders"),
    )
    return per_customer.agg(
        _sum_or_zero("revenue").alias("total_revenue"),
        _sum_or_zero("profit").alias("total_profit"),
        F.coalesce(F.sum("orders"), F.lit(0)).alias("total_orders"),
        F.count("customer_id").alias("total_customers"),
    )


def revenue_by_category(t: RetailTables, chosen: SalesFilter = EVERYTHING) -> DataFrame:
    return _revenue_by_product_column(t, chosen, "category")


def order_status_counts(t: RetailTables, chosen: SalesFilter = EVERYTHING) -> DataFrame:
    orders = orders_in_scope(t.orders, t.customers, chosen).select("order_id", "order_status")
    sold = lines_in_scope(t.order_items, t.products, chosen).select("order_id")
    if chosen.narrows_orders:
        sold = sold.join(orders, "order_id").distinct()
    else:
        sold = sold.distinct().join(orders, "order_id")
    return (
        sold.dropna(subset=["order_status"])
        .groupBy("order_status")
        .agg(F.count(F.lit(1)).alias("count"))
    )


def daily_sales(t: RetailTables, chosen: SalesFilter = EVERYTHING) -> DataFrame:
    return (
        _sales_per_order(t, chosen, ("order_date",))
        .dropna(subset=["order_date"])
        .groupBy(F.to_date("order_date").alias("Date"))
        .agg(_sum_or_zero("revenue").alias("Revenue"))
    )


def monthly_sales(t: RetailTables, chosen: SalesFilter = EVERYTHING) -> DataFrame:
    months = ["order_year", "order_month"]
    label = plain_month_label(F.col("order_year"), F.col("order_month"))
    return (
        _sales_per_order(t, chosen, tuple(months))
        .dropna(subset=months)
        .groupBy(*months)
        .agg(_sum_or_zero("revenue").alias("revenue"))
        .withColumn("month_year", label)
    )


def revenue_by_payment_method(t: RetailTables, chosen: SalesFilter = EVERYTHING) -> DataFrame:
    return _group_revenue(_sales_per_order(t, chosen, ("payment_method",)), "payment_method")


def top_product_names(t: RetailTables, chosen: SalesFilter = EVERYTHING, n: int = 10) -> DataFrame:
    """By name, so products that share a name count as one."""
    by_name = _revenue_by_product_column(t, chosen, "product_name")
    return toplists.top_n(by_name, "revenue", n, "product_name")


def top_brands(t: RetailTables, chosen: SalesFilter = EVERYTHING, n: int = 10) -> DataFrame:
    return toplists.top_n(_revenue_by_product_column(t, chosen, "brand"), "revenue", n, "brand")


def items_by_category(t: RetailTables, chosen: SalesFilter = EVERYTHING) -> DataFrame:
    return (
        _sales_per_product(t, chosen, "category")
        .dropna(subset=["category"])
        .groupBy("category")
        .agg(F.coalesce(F.sum("units"), F.lit(0)).alias("quantity"))
    )


def customer_acquisition(customers: DataFrame) -> DataFrame:
    """New customers per month, over all customers."""
    return (
        customers.dropna(subset=["registration_date"])
        .groupBy(year_month(F.col("registration_date")).alias("registration_date"))
        .agg(F.count(F.lit(1)).alias("new_customers"))
    )


def top_customer_names(t: RetailTables, chosen: SalesFilter = EVERYTHING, n: int = 10) -> DataFrame:
    """By name, so customers that share a name count as one."""
    per_customer = (
        _sales_per_order(t, chosen, ("customer_id",))
        .groupBy("customer_id")
        .agg(F.sum("revenue").alias("revenue"))
    )
    named = per_customer.join(t.customer_names, "customer_id")
    return toplists.top_n(
        _group_revenue(named, "customer_name"), "revenue", n, "customer_name"
    )


def top_states(t: RetailTables, chosen: SalesFilter = EVERYTHING, n: int = 10) -> DataFrame:
    per_customer = (
        _sales_per_order(t, chosen, ("customer_id",))
        .groupBy("customer_id")
        .agg(F.sum("revenue").alias("revenue"))
    )
    located = per_customer.join(t.customers.select("customer_id", "state"), "customer_id")
    return toplists.top_n(_group_revenue(located, "state"), "revenue", n, "state")


def profit_margin(t: RetailTables, chosen: SalesFilter = EVERYTHING) -> DataFrame:
    """Percent of revenue kept as profit; 0 unless there is revenue."""
    totals = _sales_per_product(t, chosen, "cost_price").agg(
        F.coalesce(F.sum("revenue"), F.lit(0)).alias("revenue"),
        F.coalesce(F.sum(profit_of_product()), F.lit(0)).alias("profit"),
    )
    margin = percent_or_zero(F.col("profit"), F.col("revenue"))
    return totals.select(
        reported("revenue").alias("total_revenue"),
        reported("profit").alias("total_profit"),
        F.when(F.col("revenue") > 0, margin).otherwise(F.lit(0.0)).alias("margin_percentage"),
    )


def profit_by_category(t: RetailTables, chosen: SalesFilter = EVERYTHING) -> DataFrame:
    return (
        _sales_per_product(t, chosen, "category", "cost_price")
        .dropna(subset=["category"])
        .groupBy("category")
        .agg(_sum_or_zero(profit_of_product()).alias("profit"))
        .orderBy(F.desc("profit"), "category")
    )


def daily_profit(t: RetailTables, chosen: SalesFilter = EVERYTHING) -> DataFrame:
    return (
        _sales_per_order(t, chosen, ("order_date",), profit=True)
        .dropna(subset=["order_date"])
        .groupBy(F.to_date("order_date").alias("Date"))
        .agg(_sum_or_zero("profit").alias("Profit"))
    )


def low_stock_count(t: RetailTables, threshold: int = 50) -> DataFrame:
    return _low_stock(t, threshold).agg(F.count(F.lit(1)).alias("low_stock_products"))


def lowest_stock(t: RetailTables, threshold: int = 50, n: int = 20) -> DataFrame:
    return toplists.bottom_n(_low_stock(t, threshold), "stock_quantity", n, "product_id").select(
        "product_name", "stock_quantity"
    )


def low_stock_report(t: RetailTables, threshold: int = 50) -> DataFrame:
    return (
        _low_stock(t, threshold)
        .orderBy("stock_quantity", "product_id")
        .select("product_name", "category", "brand", "stock_quantity")
    )


def low_stock_products(t: RetailTables, threshold: int = 50) -> DataFrame:
    """The rows behind the report, with all product columns, as they are exported."""
    return _low_stock(t, threshold)


def _low_stock(t: RetailTables, threshold: int) -> DataFrame:
    return t.products.where(F.col("stock_quantity") < threshold)


def _sales_per_order(
    t: RetailTables,
    chosen: SalesFilter,
    order_columns: tuple[str, ...],
    profit: bool = False,
) -> DataFrame:
    """order_id, revenue, the order columns and, if asked for, profit.

    A profit stored with the lines saves the join to the products. A filter on
    orders reaches the lines before they are summed, so that lines of other
    orders can be dropped before their shuffle.
    """
    sums = [F.sum(line_amount()).alias("revenue")]
    if profit:
        sums.append(F.sum("profit").alias("profit"))
    if profit and "profit" not in t.order_items.columns:
        products = products_in_scope(t.products, chosen)
        lines = with_profit(t.order_items, products, "inner" if chosen.categories else "left")
    else:
        lines = lines_in_scope(t.order_items, t.products, chosen)
    orders = orders_in_scope(t.orders, t.customers, chosen).select("order_id", *order_columns)
    if chosen.narrows_orders:
        return lines.join(orders, "order_id").groupBy("order_id", *order_columns).agg(*sums)
    return lines.groupBy("order_id").agg(*sums).join(orders, "order_id", "left")


def _sales_per_product(t: RetailTables, chosen: SalesFilter, *product_columns: str) -> DataFrame:
    """product_id, revenue, units and priced_units, with the product columns."""
    orders = orders_in_scope(t.orders, t.customers, chosen) if chosen.narrows_orders else None
    products = products_in_scope(t.products, chosen).select("product_id", *product_columns)
    return sales_per_product(t.order_items, orders).join(
        products, "product_id", "inner" if chosen.categories else "left"
    )


def _revenue_by_product_column(t: RetailTables, chosen: SalesFilter, column: str) -> DataFrame:
    return _group_revenue(_sales_per_product(t, chosen, column), column)


def _group_revenue(df: DataFrame, column: str) -> DataFrame:
    return (
        df.dropna(subset=[column])
        .groupBy(column)
        .agg(_sum_or_zero("revenue").alias("revenue"))
    )


def _sum_or_zero(amount: Column | str) -> Column:
    return reported(F.coalesce(F.sum(amount), F.lit(0)))


def _options(df: DataFrame, column: str) -> DataFrame:
    return df.select(
        F.lit(column).alias("option_kind"), F.col(column).alias("option_value")
    ).distinct()
