"""Facts stored by the month of their order.

Orders and everything that hangs on an order (lines, payments, reviews) lie in one folder a month, so that a date
filter or a refresh opens the files of its months only. Rows whose order is unknown or has no date have a folder of
their own. Lines get the month of their order by a join when they are stored, once; a hot order's lines are spread
over several files like those of any month.

An append adds files to the months it touches. A removal, or a correction, writes only the months it names anew.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillroll.model import RetailTables, StoreModel
from tillroll.operators.filters import SalesFilter
from tillroll.session import stored
from tillroll.sources.partitions import (
    Values,
    among,
    append_partitions,
    read_partitions,
    replace_partitions,
    write_partitions,
)

MONTH = "sale_month"
Months = Values


def month_of(ts: Column) -> Column:
    """199704; null for null."""
    return F.year(ts) * 100 + F.month(ts)


def in_months(months: Months) -> Column:
    """Rows of the given months, of which None is that of rows without one; all rows for None."""
    return among(MONTH, months)


def read_months(spark: SparkSession, path: str, schema: T.StructType, months: Months = None) -> DataFrame:
    """The rows of some months, with their month as the last column."""
    return read_partitions(spark, path, schema, MONTH, months)


def write_months(rows: DataFrame, path: str) -> DataFrame:
    return write_partitions(rows, path, MONTH)


def replace_months(rows: DataFrame, path: str, months: Iterable[int | None]) -> DataFrame:
    """Make rows, which must be of these months, their whole content."""
    return replace_partitions(rows, path, MONTH, months)


class DatedFacts:
    """Tables of a folder that share the months of their orders; each has an order_id."""

    def __init__(self, spark: SparkSession, folder: str, schemas: dict[str, T.StructType], ordered_at: str):
        self.spark, self.folder, self.schemas, self.ordered_at = spark, folder.rstrip("/"), schemas, ordered_at

    def path(self, name: str) -> str:
        return f"{self.folder}/{name}"

    def dated_orders(self, facts: dict[str, DataFrame]) -> DataFrame:
        orders = facts["orders"].withColumn(MONTH, month_of(F.col(self.ordered_at)))
        return orders.select(*self.schemas["orders"].names, MONTH)

    def dated_others(self, facts: dict[str, DataFrame], orders: DataFrame) -> dict[str, DataFrame]:
        """The other tables with the month of each row's order; order_id is unique in orders.

        The months, two narrow columns, are the side that is hashed, so that the wide rows need no sort.
        """
        months = orders.select("order_id", MONTH).hint("shuffle_hash")
        return {
            name: facts[name].join(months, "order_id", "left").select(*schema.names, MONTH)
            for name, schema in self.schemas.items()
            if name != "orders"
        }

    def write(self, facts: dict[str, DataFrame]) -> None:
        """Orders first: the others take their months from the written ones."""
        orders = write_months(self.dated_orders(facts), self.path("orders"))
        for name, rows in self.dated_others(facts, orders).items():
            write_months(rows, self.path(name))

    def append(self, facts: dict[str, DataFrame]) -> None:
        """Add orders with all that hangs on them."""
        orders = stored(self.dated_orders(facts), "added-orders")
        append_partitions(orders, self.path("orders"), MONTH)
        for name, rows in self.dated_others(facts, orders).items():
            append_partitions(rows, self.path(name), MONTH)

    def remove(self, orders: DataFrame, months: Iterable[int | None]) -> None:
        """Drop orders, by order_id, and all that hangs on them, from the months that hold them."""
        months, gone = list(months), orders.select("order_id")
        for name in self.schemas:
            kept = self.read(name, months).join(gone, "order_id", "left_anti")
            replace_months(kept.select(*self.schemas[name].names, MONTH), self.path(name), months)

    def read(self, name: str, months: Months = None) -> DataFrame:
        return read_months(self.spark, self.path(name), self.schemas[name], months)


def _schemas(tables: dict[str, DataFrame]) -> dict[str, T.StructType]:
    return {name: rows.schema for name, rows in tables.items()}


class DatedStore(DatedFacts):
    """The marketplace model with its facts stored by month."""

    def __init__(self, model: StoreModel, folder: str):
        spark = model.orders.sparkSession
        super().__init__(spark, folder, _schemas(facts_of(model)), "order_purchase_timestamp")
        self.model = model

    def months(self, months: Months = None) -> StoreModel:
        """The model with the facts of some months."""
        facts = {name: self.read(name, months) for name in self.schemas}
        return StoreModel(
            **facts, customers=self.model.customers, products=self.model.products, sellers=self.model.sellers
        )


def facts_of(model: StoreModel) -> dict[str, DataFrame]:
    return {
        "orders": model.orders,
        "order_items": model.order_items,
        "order_payments": model.order_payments,
        "order_reviews": model.order_reviews,
    }


class DatedTables(DatedFacts):
    """The retail model with orders and lines stored by month, and a calendar of the months.

    The calendar has a row a month. Lines meet the months that a date filter leaves of it, and Spark prunes the folders
    by them before it reads any.
    """

    def __init__(self, tables: RetailTables, folder: str):
        facts = {"orders": tables.orders, "order_items": tables.order_items}
        super().__init__(tables.orders.sparkSession, folder, _schemas(facts), "order_date")
        self.tables = tables

    def store(self) -> None:
        self.write({"orders": self.tables.orders, "order_items": self.tables.order_items})
        self.update_calendar()

    def update_calendar(self) -> None:
        """After a write, an append or a removal."""
        day = F.to_date(self.ordered_at)
        months = self.read("orders").where(F.col(MONTH).isNotNull()).groupBy(MONTH)
        days = months.agg(F.min(day).alias("first_day"), F.max(day).alias("last_day"))
        days.coalesce(1).write.mode("overwrite").parquet(self.path("calendar"))

    @property
    def calendar(self) -> DataFrame:
        schema = f"{MONTH} INT, first_day DATE, last_day DATE"
        return self.spark.read.schema(schema).parquet(self.path("calendar"))

    def within(self, chosen: SalesFilter) -> RetailTables:
        """What a date filter leaves of the files; the filter's exact days are the analysis' own to apply."""
        facts = {name: self.read(name) for name in self.schemas}
        if chosen.has_dates:
            touched = (F.col("last_day") >= F.lit(chosen.start)) & (F.col("first_day") <= F.lit(chosen.end))
            months = self.calendar.where(touched).select(MONTH)
            facts = {name: rows.join(months, MONTH, "left_semi") for name, rows in facts.items()}
        facts = {name: rows.drop(MONTH) for name, rows in facts.items()}
        return RetailTables(self.tables.customers, self.tables.products, **facts)
