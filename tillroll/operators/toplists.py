"""Top and bottom lists with a fixed order among ties, and first rows per key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def top_n(df: DataFrame, by: str, n: int, ties: str | list[str]) -> DataFrame:
    return df.orderBy(F.desc(by), *_columns(ties)).limit(n)


def bottom_n(df: DataFrame, by: str, n: int, ties: str | list[str]) -> DataFrame:
    return df.orderBy(F.asc(by), *_columns(ties)).limit(n)


def largest(df: DataFrame, by: str, column: str, ties: str) -> Column:
    """``column`` of the single largest row, as a scalar subquery."""
    return top_n(df, by, 1, ties).select(column).scalar()


def keep_first(df: DataFrame, key: str, order_by: list[str | Column]) -> DataFrame:
    """One row per key, the first by ``order_by``.

    The ``= 1`` filter lets every task keep one row per key before the shuffle.
    """
    place = Window.partitionBy(key).orderBy(*order_by)
    return df.withColumn("_place", F.row_number().over(place)).where("_place = 1").drop("_place")


def _columns(ties: str | list[str]) -> list[str]:
    return [ties] if isinstance(ties, str) else ties
