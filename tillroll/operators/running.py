"""Running totals over many rows, without one task that sees them all."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillroll.session import stored


def running_total(
    rows: DataFrame, order_by: Sequence[str], value: str, name: str, within: Sequence[str] = (), parts: int | None = None
) -> DataFrame:
    """Add ``name``: the sum of ``value`` over this row and those before it, restarting for each ``within``.

    The order must be unique inside a group; nulls come first. The rows are dealt to ranges of the order and stored; each
    range is summed, the sums of the ranges before it become its offset, and inside a range a window adds up. Only
    one sum for each range and group meets the driver: as many as there are ranges and groups that share one.
    """
    spark = rows.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    kind = rows.agg(F.sum(value).alias("total")).schema["total"].dataType
    places = list(within) + list(order_by)
    dealt = rows.repartitionByRange(parts, *places).withColumn("_part", F.spark_partition_id())
    dealt = stored(dealt, "ranges")
    group = F.struct(*within) if within else F.struct(F.lit(0).alias("all"))
    sums = dealt.groupBy("_part", group.alias("_group")).agg(F.sum(value).alias("_sum")).orderBy("_part").collect()
    so_far, offsets = {}, []
    for row in sums:
        before = so_far.get(row["_group"])
        offsets.append((row["_part"], row["_group"], before))
        if row["_sum"] is not None:
            so_far[row["_group"]] = row["_sum"] if before is None else before + row["_sum"]
    schema = T.StructType(
        [T.StructField("_of_part", T.IntegerType()), T.StructField("_of_group", dealt.select(group).schema[0].dataType)]
    ).add("_offset", kind)
    # As many rows as sums, which the driver has just held: small enough for every task.
    offsets = F.broadcast(spark.createDataFrame(offsets, schema))
    window = Window.partitionBy("_part", *within).orderBy(*order_by)
    inside = F.sum(value).over(window.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    total = F.coalesce(F.col("_inside") + F.col("_offset"), F.col("_inside"), F.col("_offset")).cast(kind)
    same = (F.col("_part") == F.col("_of_part")) & group.eqNullSafe(F.col("_of_group"))
    return (
        dealt.withColumn("_inside", inside)
        .join(offsets, same, "left")
        .select(*rows.columns, total.alias(name))
    )
