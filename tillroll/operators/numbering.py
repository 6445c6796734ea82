"""Numbers without gaps for the values of a key, made without a global sort."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

PIECES = 64
KEYS_PER_PIECE = 500_000


def dense_numbers(keys: DataFrame, key: str, cluster: str, pieces: int = PIECES) -> DataFrame:
    """(key, number): the rows of ``keys``, which has each key once, numbered from 1 on without gaps.

    Keys of one cluster get neighbouring numbers. A cluster is cut into pieces by the hash of the key; a piece is
    numbered in one task, its offset comes from counts per piece. Only clusters are ever ordered as a whole, and only
    as one count each. ``keys`` is read three times, so pass a stored table; there are at least ``pieces``, and more where
    one would not fit a task.
    """
    number = keys.count()
    pieces = max(pieces, -(-number // KEYS_PER_PIECE))
    rows = keys.select(key, cluster, F.pmod(F.xxhash64(key), F.lit(pieces)).alias("piece"))
    counts = rows.groupBy(cluster, "piece").agg(F.count(F.lit(1)).alias("rows"))
    earlier = lambda window: F.coalesce(F.sum("rows").over(window.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    clusters = counts.groupBy(cluster).agg(F.sum("rows").alias("rows"))
    clusters = clusters.select(F.col(cluster).alias("_cluster"), earlier(Window.orderBy(cluster)).alias("before"))
    within = Window.partitionBy(cluster).orderBy("piece")
    offsets = (
        counts.withColumn("inside", earlier(within))
        .join(clusters, F.col(cluster).eqNullSafe(F.col("_cluster")))
        .select("_cluster", F.col("piece").alias("_piece"), (F.col("before") + F.col("inside")).alias("offset"))
    )
    same = F.col(cluster).eqNullSafe(F.col("_cluster")) & (F.col("piece") == F.col("_piece"))
    nth = F.row_number().over(Window.partitionBy(cluster, "piece").orderBy(key))
    # Few bytes a key would let many pieces into one task.
    rows = rows.repartition(max(2, -(-number // KEYS_PER_PIECE)), cluster, "piece")
    return rows.join(offsets, same).select(key, (F.col("offset") + nth).alias("number"))
