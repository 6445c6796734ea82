"""Division that never raises: NULL in SQL analyses, 0 in measures."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ratio(numerator: Column, denominator: Column) -> Column:
    """numerator / denominator as a double, NULL when the denominator is 0."""
    return F.try_divide(numerator.cast("double"), denominator.cast("double"))


def ratio_or_zero(numerator: Column, denominator: Column) -> Column:
    return F.coalesce(ratio(numerator, denominator), F.lit(0.0))


def rounded_ratio(numerator: Column, denominator: Column, places: int = 2) -> Column:
    """numerator / denominator of decimals, rounded half up before it becomes a double."""
    quotient = F.try_divide(numerator.cast("decimal(28,4)"), denominator.cast("decimal(20,2)"))
    return F.round(quotient, places).cast("double")


def percent(numerator: Column, denominator: Column) -> Column:
    return ratio(numerator, denominator) * F.lit(100.0)


def percent_or_zero(numerator: Column, denominator: Column) -> Column:
    return ratio_or_zero(numerator, denominator) * F.lit(100.0)
