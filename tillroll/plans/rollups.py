"""Order lines summed per product."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillroll.functions.money import line_amount


def sales_per_product(order_items: DataFrame, orders: DataFrame | None = None) -> DataFrame:
    """product_id, revenue, units and priced_units, over the given orders only.

    Every task sums its lines per product before the shuffle, so a hot product
    arrives as a few rows. The lines need one shuffle, by order_id, and none
    when no orders are given.
    """
    lines = order_items.select("order_id", "product_id", "quantity", "unit_price")
    if orders is not None:
        lines = lines.join(orders.select("order_id"), "order_id", "left_semi")
    return lines.groupBy("product_id").agg(
        F.sum(line_amount()).alias("revenue"),
        F.sum("quantity").alias("units"),
        F.sum(F.when(F.col("unit_price").isNotNull(), F.col("quantity"))).alias("priced_units"),
    )


def profit_of_product() -> Column:
    """Profit of all lines of one product, whose cost price is the same for each.

    sum((unit_price - cost_price) * quantity) = revenue - cost_price * units,
    where only the units of priced lines count.
    """
    known = F.col("cost_price").isNotNull() & F.col("priced_units").isNotNull()
    return F.when(known, F.col("revenue") - F.col("cost_price") * F.col("priced_units"))
