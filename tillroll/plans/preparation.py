"""Cleaning and enrichment of raw extracts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillroll.functions.money import line_amount, line_profit
from tillroll.model import RetailTables
from tillroll.operators.toplists import keep_first
from tillroll.sources import files

# What stands in for a missing entry.
NO_EMAIL = "no_email@example.com"
NO_PAYMENT_METHOD = "Unknown"


def clean_customers(customers: DataFrame, order_by: list[str] | None = None) -> DataFrame:
    """One row per customer, with a placeholder for a missing email.

    Files have no row order on a cluster, so where duplicates differ the first
    by ``order_by`` stays. The other columns decide among equals, so a repeated
    task keeps the same row.
    """
    first = list(order_by or [])
    rest = [c for c in customers.columns if c not in first and c != "customer_id"]
    return keep_first(customers, "customer_id", first + rest).fillna({"email": NO_EMAIL})


def fill_payment_method(orders: DataFrame) -> DataFrame:
    return orders.fillna({"payment_method": NO_PAYMENT_METHOD})


def with_calendar(orders: DataFrame) -> DataFrame:
    """Add order_year and order_month. Text dates are parsed; a bad one raises."""
    order_date = F.col("order_date").cast("timestamp_ntz")
    return orders.withColumns(
        {
            "order_date": order_date,
            "order_year": F.year(order_date),
            "order_month": F.month(order_date),
        }
    )


def clean_orders(orders: DataFrame) -> DataFrame:
    return with_calendar(fill_payment_method(orders))


def with_profit(order_items: DataFrame, products: DataFrame, how: str = "left") -> DataFrame:
    """Look up each line's cost price and derive its profit.

    Lines of an unknown product stay, with NULL profit, unless ``how`` is
    "inner".
    """
    costs = products.select("product_id", "cost_price")
    lines = order_items.drop("cost_price", "profit")
    return lines.join(costs, "product_id", how).withColumn("profit", line_profit())


def order_totals(orders: DataFrame, order_items: DataFrame) -> DataFrame:
    """Set each order's total_amount from its lines, 0 for an order without any."""
    per_order = order_items.groupBy("order_id").agg(F.sum(line_amount()).alias("_total"))
    total = F.round(F.coalesce(F.col("_total"), F.lit(0)), 2).cast("decimal(18,2)")
    return (
        orders.drop("total_amount")
        .join(per_order, "order_id", "left")
        .withColumn("total_amount", total)
        .drop("_total")
    )


def sales_master(tables: RetailTables) -> DataFrame:
    """Every order line with its order, product and customer.

    Customers are attached to the orders, not to the lines. The narrow product
    columns come before the wide order columns, so the finished rows never
    shuffle again.
    """
    order_side = tables.orders.join(tables.customers, "customer_id", "left")
    lines = tables.order_items.drop("cost_price", "profit")
    return (
        lines.join(tables.products, "product_id", "left")
        .withColumn("profit", line_profit())
        .join(order_side, "order_id", "left")
    )


def prepare(raw: RetailTables) -> RetailTables:
    """All four tables ready for the analyses."""
    return RetailTables(
        customers=clean_customers(raw.customers),
        products=raw.products,
        orders=clean_orders(raw.orders),
        order_items=with_profit(raw.order_items, raw.products),
    )


def prepare_folder(spark: SparkSession, csv_folder: str, table_folder: str) -> RetailTables:
    """The load job: CSV extracts in, replaced parquet tables out."""
    prepared = prepare(files.read_csv_tables(spark, csv_folder))
    folder = table_folder.rstrip("/")
    return RetailTables(
        **{name: files.replace_table(df, f"{folder}/{name}") for name, df in prepared.named().items()}
    )

