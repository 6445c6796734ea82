"""Connected components of a link table, by alternating star steps.

Each step replaces links by links to the smallest neighbour, first for the larger neighbours of a node,
then for the smaller ones, until every node hangs on the smallest node of its component. Only one number
for each step reaches the driver. Steps are written to the shared folder, so a lost executor costs a task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillroll.session import stored


def _both_ways(links: DataFrame) -> DataFrame:
    return links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _large_star(links: DataFrame) -> DataFrame:
    """Link the larger neighbours of every node to its smallest neighbour, or to itself if none is smaller."""
    both = _both_ways(links)
    least = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(links: DataFrame) -> DataFrame:
    """Link every node and its smaller neighbours to the smallest of them. Links go from larger to smaller."""
    least = links.groupBy("a").agg(F.min("b").alias("m"))
    moved = links.join(least, "a").where("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(least.select("a", F.col("m").alias("b"))).distinct()


def connected(links: DataFrame, most_steps: int = 200) -> DataFrame:
    """(node, root) for each node of links (a, b), the smallest node of its component being the root.

    Links with a null end or from a node to itself are left out; repeated links count once. No links, no rows.
    """
    a, b = (F.col(f"`{name}`") for name in links.columns)
    links = links.where((a != b) & a.isNotNull() & b.isNotNull())
    links = stored(links.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).distinct(), "links")
    seen = None
    for _ in range(most_steps):
        links = stored(_small_star(_large_star(links)), "links")
        # The links are a set; when their count and the sum of their digests stay, the set stays.
        now = links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == seen:
            return links.select(F.col("a").alias("node"), F.col("b").alias("root")).union(
                links.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
            )
        seen = now
    raise RuntimeError(f"components did not settle in {most_steps} steps")
