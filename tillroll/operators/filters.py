"""The dashboard's global filters."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillroll.functions.dates import on_days


@dataclass(frozen=True)
class SalesFilter:
    """Date range (both ends or none), categories and states (empty means all)."""

    start: date | None = None
    end: date | None = None
    categories: tuple[str, ...] = ()
    states: tuple[str, ...] = ()

    @property
    def has_dates(self) -> bool:
        return self.start is not None and self.end is not None

    @property
    def narrows_orders(self) -> bool:
        return self.has_dates or bool(self.states)

    def date_condition(self, ts: Column) -> Column:
        return on_days(ts, self.start, self.end)


def apply_filters(sales: DataFrame, chosen: SalesFilter) -> DataFrame:
    """Filter the joined sales lines.

    The conditions reject NULLs, so Catalyst turns the outer joins below into
    inner joins and moves each condition to the scan of its own table.
    """
    if chosen.has_dates:
        sales = sales.where(chosen.date_condition(F.col("order_date")))
    if chosen.categories:
        sales = sales.where(F.col("category").isin(*chosen.categories))
    if chosen.states:
        sales = sales.where(F.col("state").isin(*chosen.states))
    return sales


def products_in_scope(products: DataFrame, chosen: SalesFilter) -> DataFrame:
    if chosen.categories:
        products = products.where(F.col("category").isin(*chosen.categories))
    return products


def orders_in_scope(
    orders: DataFrame,
    customers: DataFrame,
    chosen: SalesFilter,
    customer_columns: tuple[str, ...] = (),
) -> DataFrame:
    """Orders within the date and state filters.

    Customers are joined only for a state filter or a requested column.
    """
    if chosen.has_dates:
        orders = orders.where(chosen.date_condition(F.col("order_date")))
    if chosen.states:
        customers = customers.where(F.col("state").isin(*chosen.states))
    if chosen.states or customer_columns:
        orders = orders.join(
            customers.select("customer_id", *customer_columns),
            "customer_id",
            "inner" if chosen.states else "left",
        )
    return orders


def lines_in_scope(lines: DataFrame, products: DataFrame, chosen: SalesFilter) -> DataFrame:
    """Order lines within the category filter."""
    if chosen.categories:
        wanted = products_in_scope(products, chosen).select("product_id")
        lines = lines.join(wanted, "product_id", "left_semi")
    return lines
