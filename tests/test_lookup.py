"""Point lookups read a small part of a clustered table."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F
from tables import row_set

from tillroll.plans.registry import QUERIES
from tillroll.sources.lookup import write_clustered

FOLDER = "/root/testdata/sf0.01"


def rows_read(df):
    """Rows that the scan handed out, once the rows are collected."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    scans, waiting = [], [plan]
    while waiting:
        node = waiting.pop()
        if "Scan" in node.nodeName():
            scans.append(node.metrics().apply("numOutputRows").value())
        children = node.children()
        waiting += [children.apply(i) for i in range(children.size())]
    (found,) = scans
    return found


@pytest.fixture(scope="module")
def clustered(spark, tmp_path_factory):
    """Every second key is missing, and key 8 has a third of the rows."""
    rows = spark.range(30_000).select(
        F.when(F.col("id") % 3 == 0, 8).otherwise(2 * (F.col("id") % 5000)).alias("k"), F.col("id").alias("tie")
    )
    path = str(tmp_path_factory.mktemp("lookup") / "t")
    return write_clustered(rows, path, "k", "tie", files=20, keys_per_file=1000)


def test_a_key_reads_its_file(clustered):
    wanted = clustered.where("k = 5000")
    assert rows_read(wanted) <= 30_000 / 20 * 1.5 and wanted.count() == 4


def test_a_missing_key_inside_the_ranges_reads_nothing(clustered):
    assert [rows_read(clustered.where(F.col("k") == k)) for k in (1001, 4999, 7777, 2_000_000)] == [0, 0, 0, 0]


def test_a_hot_key_fills_several_files(clustered):
    hot = clustered.where("k = 8")
    assert hot.count() > 10_000 and hot.select(F.col("_metadata.file_path")).distinct().count() >= 6


def test_registered_lookup(spark):
    whole = QUERIES["q24_customer_orders"](spark, FOLDER)
    found = QUERIES["q24_customer_orders_clustered"](spark, FOLDER)
    assert row_set(found) == row_set(whole) and found.count() > 0
    assert rows_read(QUERIES["q24_customer_orders_clustered"](spark, FOLDER)) <= 15_000 / 16 * 1.5
