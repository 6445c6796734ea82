"""Distinct counts out of stored bitmaps, over any choice of groups."""

from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F
from tables import retail, row_set

from tillroll.operators import numbering
from tillroll.operators.numbering import dense_numbers
from tillroll.plans import distinct
from tillroll.plans.preparation import sales_master
from tillroll.session import stored
from tillroll.sources.warehouse import WarehouseTables

FOLDER = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def tables(spark):
    return WarehouseTables(spark, FOLDER)


@pytest.fixture(scope="module")
def bitmaps(tables):
    return stored(distinct.bitmap_rows(tables), "bitmaps")


@pytest.fixture(scope="module")
def lines(tables):
    columns = ["order_id", "customer_id", "category", "state", F.date_format("order_date", "yyyy-MM").alias("month")]
    return sales_master(tables).select(*columns).cache()


@pytest.mark.parametrize("seed", range(8))
def test_any_union_of_groups(bitmaps, lines, seed):
    rng = random.Random(seed)
    values = {c: [r[0] for r in lines.select(c).distinct().collect()] for c in distinct.GROUPS}
    chosen = F.lit(True)
    for column in distinct.GROUPS:
        chosen &= F.col(column).isin(*rng.sample(values[column], rng.randint(1, len(values[column]))))
    by = rng.sample(distinct.GROUPS, rng.randint(0, 2))
    found = distinct.distinct_counts(bitmaps, *by, chosen=chosen)
    expected = lines.where(chosen).groupBy(*by).agg(F.count_distinct("order_id"), F.count_distinct("customer_id"))
    assert row_set(found) == row_set(expected)


def test_lines_are_not_read_again(bitmaps):
    plan = distinct.distinct_counts(bitmaps, "state")._jdf.queryExecution().executedPlan().toString()
    assert "lineitem" not in plan and "SinglePartition" not in plan


def test_bytes(bitmaps):
    """Numbers of one month are neighbours, so that each group has few bitmaps."""
    found = {r["kind"]: r for r in distinct.bitmap_bytes(bitmaps).collect()}
    groups = bitmaps.select(*distinct.GROUPS).distinct().count()
    for kind in ("orders", "customers"):
        assert found[kind]["bytes"] == 4096 * found[kind]["rows"]
        assert groups <= found[kind]["rows"] <= 1.1 * groups


def test_gaps_and_orphans(spark):
    tables = retail(
        spark,
        customers=[("c1", "Ann", "A", "X"), ("c2", "Bo", "A", None)],
        products=[("p1", "Pen", "Office", "B1", 1, 5), ("p2", "Cup", None, None, 1, 5)],
        orders=[("o1", "c1", "2024-01-31", None, "Delivered", 1), ("o2", "c2", "2024-02-01", None, None, 1), ("o3", None, "2024-02-01", None, None, 1)],
        items=[("o1", "p1", 1, 1), ("o1", "p1", 1, 1), ("o1", "p2", 1, 1), ("o2", "p1", 1, 1), ("o3", "p9", 1, 1), ("o9", "p1", 1, 1), (None, "p1", 1, 1)],
    )
    rows = stored(distinct.bitmap_rows(tables), "bitmaps")
    assert row_set(distinct.distinct_counts(rows)) == {(4, 2)}
    assert row_set(distinct.distinct_counts(rows, "category")) == {("Office", 3, 2), (None, 2, 1)}
    assert row_set(distinct.distinct_counts(rows, "state")) == {("X", 1, 1), (None, 3, 1)}
    assert row_set(distinct.distinct_counts(rows, chosen=F.lit(False))) == {(0, 0)}
    assert row_set(distinct.distinct_counts(stored(distinct.bitmap_rows(retail(spark)), "none"))) == {(0, 0)}


@pytest.mark.parametrize("pieces", [1, 3, 64])
def test_numbers_have_no_gaps(spark, pieces):
    keys = spark.range(5000).select(
        F.concat(F.lit("k"), "id").alias("k"), F.when(F.col("id") % 11 > 0, F.pow(F.col("id") % 7, F.lit(2)).cast("int")).alias("c")
    )
    rows = dense_numbers(keys.repartition(5), "k", "c", pieces).join(keys, "k").collect()
    assert sorted(r["number"] for r in rows) == list(range(1, 5001))
    # Clusters lie side by side, one without a name first.
    by_number = [r["c"] for r in sorted(rows, key=lambda r: r["number"])]
    assert by_number == sorted(by_number, key=lambda c: (c is not None, c))


def test_no_task_numbers_all(spark):
    keys = spark.range(10).withColumn("c", F.col("id") % 3)
    plan = dense_numbers(keys, "id", "c")._jdf.queryExecution().executedPlan().toString()
    # The only single partition orders one count for each cluster.
    single = plan.split("Exchange SinglePartition")
    assert len(single) == 2 and "HashAggregate" in single[1]


def test_rows_of_a_task_do_not_grow(spark, tables, bitmaps, monkeypatch):
    monkeypatch.setattr(distinct, "ROWS_AT_ONCE", 5000)
    rows = distinct.bitmap_rows(tables)
    plan = rows._jdf.queryExecution().executedPlan().toString()
    # Bitmaps are made where the rows of a stretch meet, in as many tasks as the number of rows asks for.
    assert len(re.findall(r"Exchange hashpartitioning\(stretch[^)]*\), REPARTITION_BY_NUM", plan)) == 2
    found = stored(rows, "bitmaps")
    for by in ("category", "state", "month"):
        assert row_set(distinct.distinct_counts(found, by)) == row_set(distinct.distinct_counts(bitmaps, by))


def test_a_large_cluster_is_numbered_in_more_pieces(spark, monkeypatch):
    monkeypatch.setattr(numbering, "KEYS_PER_PIECE", 100)
    keys = spark.range(3000).selectExpr("id", "0 AS c")
    numbered = dense_numbers(keys, "id", "c", 2)
    assert sorted(r["number"] for r in numbered.collect()) == list(range(1, 3001))
    assert "REPARTITION_BY_NUM" in numbered._jdf.queryExecution().executedPlan().toString()
