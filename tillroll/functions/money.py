"""Exact money arithmetic: decimals inside, doubles only on output."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def line_amount(price: Column | str = "unit_price", quantity: Column | str = "quantity") -> Column:
    return _col(price) * _col(quantity)


def line_profit(
    price: Column | str = "unit_price",
    cost: Column | str = "cost_price",
    quantity: Column | str = "quantity",
) -> Column:
    return (_col(price) - _col(cost)) * _col(quantity)


def reported(amount: Column | str) -> Column:
    """Round a decimal amount to cents and hand it out as a double."""
    return F.round(_col(amount), 2).cast("double")


def _col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value
