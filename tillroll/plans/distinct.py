"""Distinct orders and customers that can be added up over any groups.

Distinct counts of two groups cannot be added, sets can. Orders and customers are numbered without gaps, and the table
kept here holds, for each (category, state, month), the numbers of its orders and of its customers as bitmaps of
32,768 numbers. A distinct count over any choice of groups joins the bitmaps of each stretch of numbers and adds up
their sizes: exact, and without a shuffle of the lines.

Orders are numbered month by month and customers state by state, so that a group has bitmaps for few stretches, and a
stretch is well filled. The rows of a stretch meet in one task, whose number of rows does not grow with the table, and
are put into bitmaps there. A bitmap takes 4,096 bytes in memory; Parquet squeezes the empty ones.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillroll.functions.dates import year_month
from tillroll.model import RetailTables
from tillroll.operators.numbering import dense_numbers
from tillroll.session import stored

GROUPS = ("category", "state", "month")
ORDERS, CUSTOMERS = "orders", "customers"
ROWS_AT_ONCE = 500_000


def sold_groups(t: RetailTables) -> DataFrame:
    """(order_id, customer_id, category, state, month), once for each order and category with a line."""
    lines = t.order_items.select("order_id", "product_id")
    goods = t.products.select("product_id", "category")
    sold = lines.join(goods, "product_id", "left").select("order_id", "category").distinct()
    buyers = t.orders.join(t.customers.select("customer_id", "state"), "customer_id", "left")
    buyers = buyers.select("order_id", "customer_id", "state", year_month(F.col("order_date")).alias("month"))
    return sold.where(F.col("order_id").isNotNull()).join(buyers, "order_id", "left")


def bitmap_rows(t: RetailTables) -> DataFrame:
    """(kind, category, state, month, stretch, numbers): what is stored."""
    sold = stored(sold_groups(t), "sold-groups")
    kinds = []
    for kind, key, cluster in ((ORDERS, "order_id", "month"), (CUSTOMERS, "customer_id", "state")):
        known = sold.where(F.col(key).isNotNull()).select(key, *GROUPS)
        if kind == CUSTOMERS:
            # One row of a customer in a group is enough; so has a hot one no more rows than there are groups.
            known = stored(known.distinct(), "customer-groups")
        # An order has one month and a customer one state; should a source disagree, the first counts for the number.
        keys = stored(known.groupBy(key).agg(F.min(cluster).alias(cluster)), f"{kind}-keys")
        tasks = -(-max(known.count(), 1) // ROWS_AT_ONCE)
        numbered = known.repartition(tasks, key).join(dense_numbers(keys, key, cluster), key)
        numbered = numbered.select(*GROUPS, "number", F.bitmap_bucket_number("number").alias("stretch"))
        kinds.append(
            numbered.repartition(tasks, "stretch")
            .groupBy(*GROUPS, "stretch")
            .agg(F.bitmap_construct_agg(F.bitmap_bit_position("number")).alias("numbers"))
            .select(F.lit(kind).alias("kind"), "*")
        )
    return reduce(DataFrame.unionByName, kinds)


def distinct_counts(bitmaps: DataFrame, *by: str, chosen: Column | None = None) -> DataFrame:
    """Distinct orders and customers by some of the groups, over the chosen ones; overall without any.

    A group without any order does not appear; the overall count then is 0.
    """
    rows = bitmaps if chosen is None else bitmaps.where(chosen)
    joined = rows.groupBy("kind", *by, "stretch").agg(F.bitmap_or_agg("numbers").alias("numbers"))
    size = F.bitmap_count("numbers")
    count = lambda kind: F.coalesce(F.sum(F.when(F.col("kind") == kind, size)), F.lit(0))
    return joined.groupBy(*by).agg(
        count(ORDERS).alias("distinct_orders"), count(CUSTOMERS).alias("distinct_customers")
    )


def bitmap_bytes(bitmaps: DataFrame) -> DataFrame:
    """Rows and bytes of the bitmaps of each kind, as they are in memory."""
    size = F.sum(F.octet_length("numbers")).alias("bytes")
    return bitmaps.groupBy("kind").agg(F.count(F.lit(1)).alias("rows"), size)
