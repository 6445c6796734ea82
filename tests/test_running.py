"""Running totals by ranges."""

from __future__ import annotations

import random
from decimal import Decimal

import pytest
from tables import rows

from tillroll.operators.running import running_total
from tillroll.plans.registry import QUERIES

FOLDER = "/root/testdata/sf0.001"


def made(n, seed=1):
    rng = random.Random(seed)
    data = [(rng.choice("abc"), i, rng.choice([None, Decimal(rng.randrange(-500, 9999)) / 100])) for i in range(n)]
    rng.shuffle(data)
    return data


def plain(data, within):
    sums, out = {}, {}
    for group, place, value in sorted(data, key=lambda r: (r[1] is not None, r[1])):
        key = group if within else None
        if value is not None:
            sums[key] = sums.get(key, 0) + value
        out[(group, place)] = sums.get(key)
    return out


@pytest.mark.parametrize("parts", [1, 4, 50])
@pytest.mark.parametrize("within", [[], ["g"]])
@pytest.mark.parametrize("n", [0, 1, 500])
def test_totals(spark, parts, within, n):
    data = made(n)
    df = spark.createDataFrame(data, "g string, i int, v decimal(12,2)").repartition(5)
    found = running_total(df, ["i"], "v", "total", within=within, parts=parts)
    assert found.columns == ["g", "i", "v", "total"]
    assert {(r["g"], r["i"]): r["total"] for r in found.collect()} == plain(data, within)


def test_nulls_of_order_and_group(spark):
    data = [("a", None, Decimal(1)), (None, 3, Decimal(2)), (None, 1, None), ("a", 2, Decimal(4))]
    df = spark.createDataFrame(data, "g string, i int, v decimal(12,2)")
    found = {(r["g"], r["i"]): r["t"] for r in running_total(df, ["i"], "v", "t", within=["g"], parts=3).collect()}
    assert found == {("a", None): 1, ("a", 2): 5, (None, 1): None, (None, 3): 2}


@pytest.mark.parametrize("key", ["m19_running_daily", "m20_running_orders"])
def test_no_task_sees_all_rows(spark, key):
    plan = QUERIES[key](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan and "Window" in plan


def test_each_range_is_a_window_of_its_own(spark):
    df = spark.range(10_000).selectExpr("id", "1L AS one")
    found = running_total(df, ["id"], "one", "n", parts=16)
    assert all(r["n"] == r["id"] + 1 for r in rows(found) for r in [dict(zip(found.columns, r))])
