"""Rows above the average of their group."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def above_group_average(
    facts: DataFrame, members: DataFrame, key: str, group: str, value: str
) -> DataFrame:
    """Facts above the average of their member's group, with the member's columns.

    The facts are summed per member before they meet the groups, and the
    group's sum and count come back at member grain. So the facts shuffle once
    by ``key`` and never by ``group``, which may be hot. Comparing
    ``value * count > sum`` keeps the test exact. Members without a group have
    no average and drop out.
    """
    per_member = facts.groupBy(key).agg(
        F.sum(value).alias("_sum"), F.count(value).alias("_count")
    )
    grouped = members.where(F.col(group).isNotNull())
    per_group = (
        per_member.join(grouped.select(key, group), key)
        .groupBy(group)
        .agg(F.sum("_sum").alias("_sum"), F.sum("_count").alias("_count"))
    )
    bars = grouped.join(per_group, group)
    return (
        facts.join(bars, key)
        .where(F.col(value) * F.col("_count") > F.col("_sum"))
        .drop("_sum", "_count")
    )
