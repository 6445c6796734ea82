"""Bind the star-schema parquet files to the retail and marketplace models.

The binding is a pure projection or a join on a key, so filters and column
selection in the analyses reach the parquet scans. A table is opened when an
analysis first asks for it.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillroll.operators.filters import SalesFilter, products_in_scope
from tillroll.plans import preparation

# Declared, so that opening a table runs no job to look at its files.
COLUMNS = {
    "region": "r_regionkey INT, r_name STRING",
    "nation": "n_nationkey INT, n_name STRING, n_regionkey INT",
    "customer": "c_custkey BIGINT, c_name STRING, c_nationkey INT",
    "supplier": "s_suppkey BIGINT, s_name STRING",
    "part": "p_partkey BIGINT, p_name STRING, p_brand STRING, p_type STRING, p_size INT, "
    "p_retailprice DOUBLE",
    "orders": "o_orderkey BIGINT, o_custkey BIGINT, o_orderstatus STRING, o_totalprice DOUBLE, "
    "o_orderdate TIMESTAMP_NTZ, o_orderpriority STRING",
    "lineitem": "l_orderkey BIGINT, l_partkey BIGINT, l_suppkey BIGINT, l_linenumber INT, "
    "l_quantity DOUBLE, l_extendedprice DOUBLE, l_shipdate TIMESTAMP_NTZ",
}



class WarehouseTables:
    """Clean retail tables: payment gaps kept, calendar columns present."""

    def __init__(self, spark: SparkSession, folder: str):
        self._spark = spark
        self._folder = folder.rstrip("/")

    @cached_property
    def customers(self) -> DataFrame:
        nation = self.scan("nation")
        region = self.scan("region")
        return (
            self.scan("customer")
            .join(nation, F.col("c_nationkey") == F.col("n_nationkey"), "left")
            .join(region, F.col("n_regionkey") == F.col("r_regionkey"), "left")
            .selectExpr(
                "c_custkey AS customer_id",
                "c_name AS customer_name",
                "n_name AS city",
                "r_name AS state",
            )
        )

    @cached_property
    def customer_names(self) -> DataFrame:
        """Without the place, which takes two joins."""
        return self.scan("customer").selectExpr("c_custkey AS customer_id", "c_name AS customer_name")

    @cached_property
    def products(self) -> DataFrame:
        return self.scan("part").selectExpr(
            "p_partkey AS product_id",
            "p_name AS product_name",
            "p_type AS category",
            "p_brand AS brand",
            "CAST(p_retailprice AS DECIMAL(18,2)) AS cost_price",
            "p_size AS stock_quantity",
        )

    @cached_property
    def orders(self) -> DataFrame:
        return preparation.with_calendar(self.uncleaned_orders)

    @cached_property
    def order_items(self) -> DataFrame:
        return self.scan("lineitem").selectExpr(
            "l_orderkey * 10 + l_linenumber AS order_item_id",
            "l_orderkey AS order_id",
            "l_partkey AS product_id",
            "CAST(l_quantity AS INT) AS quantity",
            "CAST(l_extendedprice AS DECIMAL(18,2)) AS unit_price",
        )

    @cached_property
    def uncleaned_orders(self) -> DataFrame:
        return self.scan("orders").selectExpr(
            "o_orderkey AS order_id",
            "o_custkey AS customer_id",
            "o_orderdate AS order_date",
            "nullif(o_orderpriority, '4-NOT SPECIFIED') AS payment_method",
            # Nested if and <=>: order_status = 'Delivered' then folds into
            # o_orderstatus <=> 'F' and reaches the scan.
            "if(o_orderstatus <=> 'F', 'Delivered', if(o_orderstatus <=> 'P', 'Pending',"
            " if(o_orderkey % 2 = 0, 'Shipped', 'Cancelled'))) AS order_status",
            "CAST(o_totalprice AS DECIMAL(18,2)) AS total_amount",
        )

    @cached_property
    def registered_customers(self) -> DataFrame:
        """Customers with the day of their first order as registration date."""
        first_order = self.uncleaned_orders.groupBy("customer_id").agg(
            F.to_date(F.min("order_date")).alias("registration_date")
        )
        return self.customers.join(first_order, "customer_id", "left")

    @cached_property
    def uncleaned_customers(self) -> DataFrame:
        """Customers with missing emails and repeated rows, as a raw extract has them."""
        rows = self.registered_customers.withColumn(
            "email", F.expr("CASE WHEN customer_id % 20 != 0 THEN concat(customer_name, '@x') END")
        )
        copies = F.explode(F.expr("sequence(0, if(customer_id % 100 = 0, 1, 0))"))
        return rows.withColumn("copy", copies).drop("copy")

    def named(self) -> dict[str, DataFrame]:
        return {
            "customers": self.customers,
            "products": self.products,
            "orders": self.orders,
            "order_items": self.order_items,
        }

    def scan(self, table: str) -> DataFrame:
        return self._spark.read.schema(COLUMNS[table]).parquet(f"{self._folder}/{table}.parquet")


class PreparedTables(WarehouseTables):
    """What the dashboard reads: payment gaps are filled."""

    @cached_property
    def orders(self) -> DataFrame:
        return preparation.clean_orders(self.uncleaned_orders)


class WarehouseStore:
    """The marketplace model behind the marts, or the part of it that a report's slicers leave.

    A slice has the lines of the chosen categories, in the orders of the chosen
    days and customer states, and these orders' payments and reviews. Its
    conditions meet the scans before any sum.
    """

    def __init__(self, spark: SparkSession, folder: str, chosen: SalesFilter = SalesFilter()):
        self._tables = WarehouseTables(spark, folder)
        self._chosen = chosen

    def sliced(self, chosen: SalesFilter) -> WarehouseStore:
        return WarehouseStore(self._tables._spark, self._tables._folder, chosen)

    @cached_property
    def orders(self) -> DataFrame:
        """Orders with their delivery and mean review, both from one read of the lines."""
        from_lines = self._line_sums.drop("price", "lines")
        return self._delivered(self._purchases.join(from_lines, "order_id", "left"))

    def order_facts(self, *columns: str) -> DataFrame:
        """The rows of :func:`measures.order_facts`, from one read of the lines.

        Delivery, review, price and line count of an order are sums over the
        same lines, so they leave one aggregate together.
        """
        facts = self._line_sums
        if set(columns) - {"review_score"}:
            orders = self._purchases
            if {"customer_unique_id", "customer_state"} & set(columns):
                orders = orders.join(self.customers, "customer_id", "left")
            facts = self._delivered(facts.join(orders, "order_id", "left"))
        return facts.where("lines > 0").select("order_id", "price", "lines", *columns)

    @cached_property
    def _scanned_orders(self) -> DataFrame:
        orders = self._tables.scan("orders")
        if self._chosen.has_dates:
            orders = orders.where(self._chosen.date_condition(F.col("o_orderdate")))
        if self._chosen.states:
            here = self.customers.where(F.col("customer_state").isin(*self._chosen.states))
            here = here.select(F.col("customer_id").alias("o_custkey"))
            orders = orders.join(here, "o_custkey", "left_semi")
        return orders

    @cached_property
    def _scanned_lines(self) -> DataFrame:
        """Lines of the chosen orders, with ``wanted``: whether the category is a chosen one."""
        lines = self._tables.scan("lineitem")
        if self._chosen.narrows_orders:
            kept = self._scanned_orders.select(F.col("o_orderkey").alias("l_orderkey"))
            lines = lines.join(kept, "l_orderkey", "left_semi")
        if not self._chosen.categories:
            return lines.withColumn("wanted", F.lit(True))
        parts = products_in_scope(self.products, self._chosen)
        parts = parts.select(F.col("product_id").alias("l_partkey"), F.lit(True).alias("wanted"))
        return lines.join(parts, "l_partkey", "left")

    @cached_property
    def _purchases(self) -> DataFrame:
        return self._scanned_orders.selectExpr(
            "o_orderkey AS order_id",
            "o_custkey AS customer_id",
            "o_orderdate AS order_purchase_timestamp",
            "o_orderdate + INTERVAL 60 DAYS AS order_estimated_delivery_date",
        )

    @cached_property
    def _line_sums(self) -> DataFrame:
        """price, lines, last_arrival and review_score of each order that has lines.

        Price and lines are those of the chosen categories; delivery and
        review are the order's own.
        """
        score = "least(l_linenumber, 5)"
        price = F.expr("CAST(l_extendedprice AS DECIMAL(18,2))")
        return (
            self._scanned_lines.groupBy(F.col("l_orderkey").alias("order_id"))
            .agg(
                F.sum(F.when(F.col("wanted"), price)).alias("price"),
                F.count_if("wanted").alias("lines"),
                F.max("l_shipdate").alias("last_arrival"),
                F.expr(f"CAST(max({score}) + min({score}) AS DOUBLE) / 2").alias("review_score"),
            )
        )

    @staticmethod
    def _delivered(orders: DataFrame) -> DataFrame:
        known = "CASE WHEN last_arrival >= order_purchase_timestamp THEN last_arrival END"
        return orders.withColumn("order_delivered_customer_date", F.expr(known)).drop(
            "last_arrival"
        )

    @cached_property
    def order_items(self) -> DataFrame:
        return self._scanned_lines.where("wanted").selectExpr(
            "l_orderkey AS order_id",
            "l_partkey AS product_id",
            "l_suppkey AS seller_id",
            "CAST(l_extendedprice AS DECIMAL(18,2)) AS price",
        )

    @cached_property
    def order_payments(self) -> DataFrame:
        """One payment for most orders; every third has two vouchers of 30 % besides."""
        amount = "CAST(o_totalprice AS DECIMAL(18,2))"
        voucher = f"CAST({amount} * 0.3 AS DECIMAL(18,2))"
        several = "o_orderkey % 3 = 0"
        rows = self._scanned_orders.withColumn(
            "nth", F.expr(f"explode(sequence(0, if({several}, 2, 0)))")
        )
        return rows.selectExpr(
            "o_orderkey AS order_id",
            "if(nth = 0, o_orderpriority, 'VOUCHER') AS payment_type",
            "CAST(if(nth = 0, o_orderkey % 24 + 1, 1) AS INT) AS payment_installments",
            f"CAST(CASE WHEN nth > 0 THEN {voucher} WHEN {several} THEN {amount} - 2 * {voucher}"
            f" ELSE {amount} END AS DECIMAL(18,2)) AS payment_value",
        )

    @cached_property
    def order_reviews(self) -> DataFrame:
        """Two reviews per order."""
        score = "least(l_linenumber, 5)"
        return (
            self._scanned_lines.groupBy(F.col("l_orderkey").alias("order_id"))
            .agg(F.expr(f"array(max({score}), min({score}))").alias("scores"))
            .select("order_id", F.explode("scores").alias("review_score"))
        )

    @cached_property
    def customers(self) -> DataFrame:
        return self._tables.customers.selectExpr(
            "customer_id", "customer_id AS customer_unique_id", "city AS customer_state"
        )

    @cached_property
    def products(self) -> DataFrame:
        return self._tables.products.select("product_id", "category")

    @cached_property
    def sellers(self) -> DataFrame:
        return self._tables.scan("supplier").selectExpr(
            "s_suppkey AS seller_id", "s_name AS seller_name"
        )
