"""Share of the grand total, and a year-by-month matrix.

Inputs are aggregated rows, one per category shown in a chart. A window over
all of them costs next to nothing, while a separate total would scan the
sales a second time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tillroll.functions.ratios import percent_or_zero, ratio


def share_of_total(grouped: DataFrame, value: str, name: str) -> DataFrame:
    """Percent of the sum over all rows."""
    total = F.sum(value).over(Window.partitionBy())
    return grouped.withColumn(name, percent_or_zero(F.col(value), total))


def ratio_of_totals(grouped: DataFrame, above: str, below: str, name: str) -> DataFrame:
    """The same overall ratio sum(above) / sum(below) on every row."""
    everything = Window.partitionBy()
    overall = ratio(F.sum(above).over(everything), F.sum(below).over(everything))
    return grouped.withColumn(name, overall)


def month_matrix(sales: DataFrame, year: str, month: str, value: str) -> DataFrame:
    """One row per year, columns m01 to m12. The months are listed, so no
    extra job looks for them, and a month without sales stays NULL."""
    months = list(range(1, 13))
    wide = sales.groupBy(year).pivot(month, months).agg(F.sum(value))
    return wide.select(
        year, *[F.col(str(m)).cast("double").alias(f"m{m:02d}") for m in months]
    )
