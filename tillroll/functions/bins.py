"""Grouping numbers into labelled or fixed-width bins."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Upper bound and label of each installment group.
INSTALLMENT_GROUPS = ((3, "2–3"), (6, "4–6"), (12, "7–12"))
SINGLE_PAYMENT = "1 (Full)"
MANY_INSTALLMENTS = "13+"


def installment_group(installments: Column) -> Column:
    label = F.when(installments == 1, SINGLE_PAYMENT)
    for upper, name in INSTALLMENT_GROUPS:
        label = label.when(installments <= upper, name)
    return label.otherwise(MANY_INSTALLMENTS)


def bin_start(value: Column, width: int) -> Column:
    """Lower edge of the fixed-width bin that holds ``value``."""
    return (F.floor(value / F.lit(width)) * width).cast("int")
