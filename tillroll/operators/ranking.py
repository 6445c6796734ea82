"""Ranks within a group that may hold a large part of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# Equal values are numbered in this many independent pieces.
TIE_PIECES = 1024


def rank_within(
    df: DataFrame, group: str, by: str, id_column: str, up_to: int, tie_pieces: int = TIE_PIECES
) -> DataFrame:
    """Rows with rank up to ``up_to`` by descending ``by``, with row_num,
    rank_val and dense_rank_val.

    Ranks depend only on how often each value occurs, so they are worked out
    on one row per (group, value), of which each task forwards at most
    ``up_to`` per group. The rows then join the few leading values. Neither a
    hot group nor a hot value is ever gathered in one task.
    """
    leading = _leading_values(df, group, by, up_to)
    same_value = F.col("r." + group).eqNullSafe(F.col("v." + group)) & F.col("r." + by).eqNullSafe(
        F.col("v." + by)
    )
    kept = (
        df.alias("r")
        .join(leading.alias("v"), same_value)
        .select("r.*", "v.rank_val", "v.dense_rank_val")
    )
    return _number_rows(kept, group, by, id_column, tie_pieces)


def _leading_values(df: DataFrame, group: str, by: str, up_to: int) -> DataFrame:
    best_first = Window.partitionBy(group).orderBy(F.desc(by))
    before = best_first.rowsBetween(Window.unboundedPreceding, -1)
    per_value = df.groupBy(group, by).agg(F.count(F.lit(1)).alias("_rows"))
    # Values are distinct here, so their row number is the dense rank.
    leading = per_value.withColumn("dense_rank_val", F.row_number().over(best_first)).where(
        F.col("dense_rank_val") <= up_to
    )
    rank = F.coalesce(F.sum("_rows").over(before), F.lit(0)) + 1
    return leading.withColumn("rank_val", rank).where(F.col("rank_val") <= up_to).drop("_rows")


def _number_rows(
    ranked: DataFrame, group: str, by: str, id_column: str, tie_pieces: int
) -> DataFrame:
    """row_num: rank plus the place among equal values.

    Equal values are cut into pieces by a hash of their id. A row's place is
    the size of the pieces before its own plus its place inside the piece.
    """
    pieces = ranked.withColumn("_piece", F.pmod(F.xxhash64(id_column), F.lit(tie_pieces)))
    keys = [group, by, "_piece"]
    earlier = (
        Window.partitionBy(group, by)
        .orderBy("_piece")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    sizes = pieces.groupBy(*keys).agg(F.count(F.lit(1)).alias("_size"))
    offsets = sizes.withColumn("_before", F.coalesce(F.sum("_size").over(earlier), F.lit(0)))
    inside = Window.partitionBy(*keys).orderBy(id_column)
    placed = pieces.withColumn("_place", F.row_number().over(inside))
    same_piece = [F.col(f"p.{k}").eqNullSafe(F.col(f"o.{k}")) for k in keys]
    row_num = F.col("rank_val") + F.col("_before") + F.col("_place") - 1
    return (
        placed.alias("p")
        .join(offsets.alias("o"), same_piece[0] & same_piece[1] & same_piece[2])
        .select("p.*", "o._before")
        .withColumn("row_num", row_num)
        .drop("_piece", "_place", "_before")
    )
