"""Orders and their facts as catalog tables bucketed and sorted by order_id.

Rows of one order lie in buckets of the same number, so that joins and sums by order need no shuffle. A bucket is read
by one task, and nothing splits it at run time. Orders with more than ``hot_lines`` lines therefore go to tables of
their own, which are not bucketed: joins over them shuffle, and adaptive execution splits them. There are at most as
many such orders as lines / hot_lines. Every order lies in one of the two parts, so results by order are those of the
parts put together. A larger table gets more buckets, so that one fits a task at any size.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillroll.model import RetailTables, StoreModel
from tillroll.session import run_folder, stored

HOT_LINES = 1_000_000
BUCKETS = 64
LINES_PER_BUCKET = 200_000
KEY = "order_id"
REGULAR, HOT = "", "_hot"


def write_facts(
    facts: dict[str, DataFrame], database: str, buckets: int = BUCKETS, hot_lines: int = HOT_LINES
) -> None:
    """Store tables that have an order_id, one of them ``order_items``, in a new database.

    There are ``buckets`` of them, or more where a bucket would hold over LINES_PER_BUCKET lines on average, up to the
    number that Spark allows. Facts without an order go with the hot ones, as nothing is known of their number.
    """
    spark = facts["order_items"].sparkSession
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {database} LOCATION '{run_folder(spark, database)}'")
    counts = facts["order_items"].where(F.col(KEY).isNotNull()).groupBy(KEY).agg(F.count(F.lit(1)).alias("lines"))
    hot = stored(counts.where(F.col("lines") > hot_lines).select(KEY), "hot-orders")
    most = int(spark.conf.get("spark.sql.sources.bucketing.maxBuckets"))
    buckets = max(buckets, min(most, -(-facts["order_items"].count() // LINES_PER_BUCKET)))
    for name, rows in facts.items():
        regular = rows.where(F.col(KEY).isNotNull()).join(hot, KEY, "left_anti").select(*rows.columns)
        bucketed = regular.repartition(buckets, KEY).write.bucketBy(buckets, KEY).sortBy(KEY)
        bucketed.mode("overwrite").saveAsTable(f"{database}.{name}{REGULAR}")
        others = rows.join(hot, KEY, "left_semi").unionByName(rows.where(F.col(KEY).isNull()))
        others.select(*rows.columns).write.mode("overwrite").saveAsTable(f"{database}.{name}{HOT}")


def _facts(spark: SparkSession, database: str, names: list[str], part: str) -> dict[str, DataFrame]:
    return {name: spark.table(f"{database}.{name}{part}") for name in names}


def retail_parts(tables: RetailTables, database: str) -> list[RetailTables]:
    """The regular and the hot part, with customers and products as they are in ``tables``."""
    spark = tables.customers.sparkSession
    return [
        RetailTables(tables.customers, tables.products, **_facts(spark, database, ["orders", "order_items"], part))
        for part in (REGULAR, HOT)
    ]


def store_parts(model: StoreModel, database: str) -> list[StoreModel]:
    names = ["orders", "order_items", "order_payments", "order_reviews"]
    spark = model.customers.sparkSession
    return [replace(model, **_facts(spark, database, names, part)) for part in (REGULAR, HOT)]
