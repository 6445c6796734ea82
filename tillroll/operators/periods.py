"""Comparing months. Every input here is one row per month, so the ordered
windows run over a few hundred rows whatever the size of the sales data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tillroll.functions.dates import month_number


def with_previous_row(monthly: DataFrame, value: str, name: str) -> DataFrame:
    """The preceding month that has sales, however long ago."""
    order = Window.orderBy("order_year", "order_month")
    return monthly.withColumn(name, F.lag(value).over(order))


def with_previous_calendar_month(monthly: DataFrame, value: str, name: str) -> DataFrame:
    """The calendar month before, NULL when it has no sales."""
    number = month_number(F.col("order_year"), F.col("order_month"))
    one_back = Window.orderBy(number).rangeBetween(-1, -1)
    return monthly.withColumn(name, F.sum(value).over(one_back))


def running_in_year(monthly: DataFrame, value: str, name: str) -> DataFrame:
    to_date = (
        Window.partitionBy("order_year")
        .orderBy("order_month")
        .rangeBetween(Window.unboundedPreceding, Window.currentRow)
    )
    return monthly.withColumn(name, F.sum(value).over(to_date))


def growth_percent(current: Column, previous: Column) -> Column:
    change = (current - previous).cast("double")
    return F.try_divide(change, previous.cast("double")) * F.lit(100.0)
