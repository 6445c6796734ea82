"""NOT IN with SQL's NULL rules, without a broadcast of the inner side."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def not_in(outer: DataFrame, inner: DataFrame, key: str) -> DataFrame:
    """Rows of ``outer`` whose key is NOT IN the keys of ``inner``.

    A NULL among the inner keys empties the result; a NULL outer key passes
    only when ``inner`` has no rows. Both checks are scalar subqueries that
    stop at the first row found; NULL statistics in the files answer the first.
    """
    inner_keys = inner.select(key)
    null_keys = _rows_up_to_one(inner_keys.where(F.col(key).isNull()))
    any_keys = _rows_up_to_one(inner_keys)
    known = inner_keys.where(F.col(key).isNotNull()).distinct()
    return outer.join(known, key, "left_anti").where(
        (null_keys == 0) & (F.col(key).isNotNull() | (any_keys == 0))
    )


def _rows_up_to_one(df: DataFrame) -> Column:
    return df.limit(1).agg(F.count(F.lit(1))).scalar()
