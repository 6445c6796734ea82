"""Key checks: Spark does not enforce keys on write, so they are queries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillroll.schemas import FOREIGN_KEYS, PRIMARY_KEYS


def primary_key_violations(df: DataFrame, table: str, key: str) -> DataFrame:
    """table_name, duplicated key values, surplus rows and NULL keys."""
    per_key = df.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    repeated = F.col(key).isNotNull() & (F.col("n") > 1)
    return per_key.agg(
        F.count_if(repeated).alias("duplicate_keys"),
        F.coalesce(F.sum(F.when(repeated, F.col("n") - 1)), F.lit(0)).alias("surplus_rows"),
        F.coalesce(F.sum(F.when(F.col(key).isNull(), F.col("n"))), F.lit(0)).alias("null_keys"),
    ).select(F.lit(table).alias("table_name"), "duplicate_keys", "surplus_rows", "null_keys")


def foreign_key_violations(
    child: DataFrame, child_table: str, key: str, parent: DataFrame, parent_table: str, parent_key: str
) -> DataFrame:
    """Orphan key values and the rows that carry them.

    The child is counted per key first, so a hot key meets the parent as one row.
    """
    used = child.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    present = parent.select(F.col(parent_key).alias(key))
    orphans = used.join(present, key, "left_anti")
    return orphans.agg(
        F.count(F.lit(1)).alias("orphan_keys"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("orphan_rows"),
    ).select(
        F.lit(child_table).alias("child_table"),
        F.lit(key).alias("child_column"),
        F.lit(parent_table).alias("parent_table"),
        "orphan_keys",
        "orphan_rows",
    )


def check_primary_keys(tables: dict[str, DataFrame]) -> DataFrame:
    parts = [primary_key_violations(tables[t], t, key) for t, key in PRIMARY_KEYS.items()]
    return reduce(DataFrame.unionByName, parts)


def check_foreign_keys(tables: dict[str, DataFrame]) -> DataFrame:
    parts = [
        foreign_key_violations(tables[child], child, key, tables[parent], parent, PRIMARY_KEYS[parent])
        for child, key, parent in FOREIGN_KEYS
    ]
    return reduce(DataFrame.unionByName, parts)
