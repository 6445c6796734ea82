"""All sums of the dashboard's pages from one read of the lines.

The lines are summed per order and per product in one aggregation with two grouping sets, which is stored. Orders then
get their attributes, products theirs, and every section comes out of one of two lattices of groupings. A section has
the rows of the function of its name in :mod:`tillroll.plans.dashboard`.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillroll.functions.dates import plain_month_label
from tillroll.functions.money import line_amount, reported
from tillroll.functions.ratios import percent_or_zero
from tillroll.model import RetailTables
from tillroll.operators import toplists
from tillroll.operators.filters import SalesFilter, lines_in_scope, orders_in_scope
from tillroll.operators.lattice import cuboids
from tillroll.plans.dashboard import EVERYTHING
from tillroll.plans.rollups import profit_of_product
from tillroll.session import stored

TOP = 10
ORDER_GROUPINGS = {
    "shape": ("day", "order_year", "order_month", "order_status", "payment_method"),
    "customers": ("customer_id", "state"),
    "days": ("day",),
    "months": ("order_year", "order_month"),
    "statuses": ("order_status",),
    "payments": ("payment_method",),
    "states": ("state",),
    "sold": (),
}
PRODUCT_GROUPINGS = {
    "goods": ("category", "brand", "product_name"),
    "categories": ("category",),
    "brands": ("brand",),
    "names": ("product_name",),
    "earned": (),
}


def line_sums(t: RetailTables, chosen: SalesFilter = EVERYTHING) -> DataFrame:
    """revenue, units and priced_units per order and per product: the one read of the lines.

    ``per_order`` tells the two kinds of rows apart.
    """
    lines = lines_in_scope(t.order_items, t.products, chosen)
    if chosen.narrows_orders:
        kept = orders_in_scope(t.orders, t.customers, chosen).select("order_id")
        lines = lines.join(kept, "order_id", "left_semi")
    lines = lines.select("order_id", "product_id", "quantity", "unit_price")
    priced = F.when(F.col("unit_price").isNotNull(), F.col("quantity"))
    return lines.groupingSets([["order_id"], ["product_id"]], "order_id", "product_id").agg(
        (F.grouping("product_id") == 1).alias("per_order"),
        F.sum(line_amount()).alias("revenue"),
        F.sum("quantity").alias("units"),
        F.sum(priced).alias("priced_units"),
    )


def page_sections(t: RetailTables, chosen: SalesFilter = EVERYTHING) -> dict[str, DataFrame]:
    """Each section of the pages by the name of its dashboard function."""
    sums = stored(line_sums(t, chosen), "line-sums")
    located = t.orders.join(t.customers.select("customer_id", "state"), "customer_id", "left")
    order_columns = located.select(
        "order_id",
        "customer_id",
        "state",
        F.to_date("order_date").alias("day"),
        "order_year",
        "order_month",
        "order_status",
        "payment_method",
    )
    known = F.when(F.col("order_id").isNotNull(), F.lit(1))
    per_order = sums.where("per_order").select("order_id", "revenue", known.alias("orders"))
    per_order = stored(per_order.join(order_columns, "order_id", "left").drop("order_id"), "order-sums")
    by = cuboids(per_order, ORDER_GROUPINGS, ["revenue", "orders"])

    goods = t.products.select("product_id", "category", "brand", "product_name", "cost_price")
    per_product = sums.where("NOT per_order").join(goods, "product_id", "left")
    per_product = per_product.withColumn("profit", profit_of_product())
    per_product = per_product.select("category", "brand", "product_name", "revenue", "units", "profit")
    by |= cuboids(stored(per_product, "product-sums"), PRODUCT_GROUPINGS, ["revenue", "units", "profit"])

    revenue, profit = _or_zero("revenue"), _or_zero("profit")
    totals = [
        by["earned"].select(revenue.alias("total_revenue"), profit.alias("total_profit")),
        by["sold"].select(F.coalesce("orders", F.lit(0)).alias("total_orders")),
        by["customers"].agg(F.count("customer_id").alias("total_customers")),
    ]
    # One row each, of which every column has one value.
    kpis = reduce(lambda rows, more: rows.unionByName(more, allowMissingColumns=True), totals)
    margin = percent_or_zero(F.coalesce("profit", F.lit(0)), F.coalesce("revenue", F.lit(0)))
    return {
        "home_kpis": kpis.agg(*[F.max(column).alias(column) for column in kpis.columns]),
        "revenue_by_category": _section(by["categories"], "category", revenue=revenue),
        "order_status_counts": _section(by["statuses"], "order_status", count=F.col("orders")),
        "daily_sales": _section(by["days"], "day", Revenue=revenue).withColumnRenamed("day", "Date"),
        "monthly_sales": by["months"]
        .dropna(subset=["order_year", "order_month"])
        .select("order_year", "order_month", revenue.alias("revenue"))
        .withColumn("month_year", plain_month_label(F.col("order_year"), F.col("order_month"))),
        "revenue_by_payment_method": _section(by["payments"], "payment_method", revenue=revenue),
        "top_product_names": _top(_section(by["names"], "product_name", revenue=revenue), "product_name"),
        "top_brands": _top(_section(by["brands"], "brand", revenue=revenue), "brand"),
        "items_by_category": _section(by["categories"], "category", quantity=F.coalesce("units", F.lit(0))),
        "top_states": _top(_section(by["states"], "state", revenue=revenue), "state"),
        "profit_margin": by["earned"].select(
            revenue.alias("total_revenue"),
            profit.alias("total_profit"),
            F.when(F.col("revenue") > 0, margin).otherwise(F.lit(0.0)).alias("margin_percentage"),
        ),
        "profit_by_category": _section(by["categories"], "category", profit=profit),
    }


def page(t: RetailTables, chosen: SalesFilter = EVERYTHING) -> DataFrame:
    """(section, label, measure, amount): every number of every section.

    The label of a row is its group, a day as 2024-06-01 and a month as 2024-6; a section of one row has none.
    """
    rows = []
    for name, section in page_sections(t, chosen).items():
        measures = [c for c, kind in section.dtypes if kind in ("double", "bigint") or c == "count"]
        label = next((c for c in ("month_year", *section.columns) if c in section.columns and c not in measures), None)
        pairs = [F.struct(F.lit(c).alias("measure"), F.col(c).cast("double").alias("amount")) for c in measures]
        rows.append(
            section.select(
                F.lit(name).alias("section"),
                (F.col(label).cast("string") if label else F.lit(None).cast("string")).alias("label"),
                F.inline(F.array(*pairs)),
            )
        )
    return reduce(DataFrame.unionByName, rows)


def _section(rows: DataFrame, key: str, **columns: Column) -> DataFrame:
    """A section leaves out the rows without a key."""
    return rows.dropna(subset=[key]).select(key, *[column.alias(name) for name, column in columns.items()])


def _top(rows: DataFrame, key: str) -> DataFrame:
    return toplists.top_n(rows, "revenue", TOP, key)


def _or_zero(column: str) -> Column:
    return reported(F.coalesce(column, F.lit(0)))
