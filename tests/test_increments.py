"""Refreshing the marts by month gives what a full refresh gives, from the changed months alone."""

from __future__ import annotations

import glob
from collections import Counter

import pytest
from pyspark.sql import functions as F
from tables import store

from tillroll.plans import increments, marts
from tillroll.plans.measures import PURCHASED
from tillroll.sources.dated import MONTH, DatedStore, facts_of, in_months, replace_months, write_months
from tillroll.sources.partitions import NO_VALUE
from tillroll.sources.warehouse import WarehouseStore

FOLDER = "/root/testdata/sf0.001"
MARTS = (
    "v_sales_summary v_monthly_sales v_category_performance v_customer_segments v_seller_performance v_regional_sales"
    " v_payment_analysis"
).split()


def shown(spark):
    """The rows of every mart, as its view shows them."""
    found = {}
    for name in MARTS:
        df = spark.table(name)
        found[name] = Counter(tuple(str(v) for v in row) for row in df.select(sorted(df.columns)).collect())
    return found


def assert_as_refreshed_in_full(spark, model, found, tmp_path):
    marts.refresh(model, str(tmp_path / "full"))
    full = shown(spark)
    for name in MARTS:
        assert found[name] == full[name], name


def of_orders(model, ids, how):
    return {name: rows.join(ids.select("order_id"), "order_id", how) for name, rows in facts_of(model).items()}


def hand_model(spark, orders, items, payments):
    return store(
        spark,
        orders=[(o, c, day, None, "2024-01-01") for o, c, day in orders],
        items=items,
        payments=payments,
        reviews=[("A", 5), ("B", 2), ("B", 3)],
        customers=[("c1", "u1", "X"), ("c2", "u2", "X"), ("c3", "u1", "Y")],
        products=[("p1", "toys"), ("p2", None)],
        sellers=[("s1", "Ann"), ("s2", "Bo")],
    )


ORDERS = [("A", "c1", "2024-01-05"), ("B", "c2", "2024-01-31"), ("C", "c1", "2024-02-01"), ("D", "c9", "2024-03-09")]
ITEMS = [("A", "p1", "s1", 10), ("A", "p2", "s2", 5.5), ("B", "p1", "s1", 1), ("C", "p9", "s9", 7), ("D", "p1", "s1", 2)]
ITEMS += [("Z", "p1", "s1", 4)]  # no such order
PAYMENTS = [("A", "CARD", 1, 15.5), ("B", "CARD", 3, 1), ("C", "CASH", 1, 7), ("Z", "CASH", 1, 4)]


def undated(model):
    """Order D has no date."""
    known = F.when(F.col("order_id") != "D", F.col(PURCHASED))
    return increments.StoreModel(**{**vars(model), "orders": model.orders.withColumn(PURCHASED, known)})


def test_late_new_changed_and_deleted_orders(spark, tmp_path):
    before = undated(hand_model(spark, [ORDERS[0], ORDERS[2], ORDERS[3]], [i for i in ITEMS if i[0] != "B"], PAYMENTS[:1] + PAYMENTS[2:]))
    facts = DatedStore(before, str(tmp_path / "facts"))
    facts.write(facts_of(before))
    increments.refresh_months(facts, str(tmp_path / "marts"))
    assert_as_refreshed_in_full(spark, before, shown(spark), tmp_path)

    # B arrives late, the only order of February goes, A has a line more.
    after = undated(hand_model(spark, [ORDERS[0], ORDERS[1], ORDERS[3]], [i for i in ITEMS if i[0] != "C"] + [("A", "p1", "s2", 3)], PAYMENTS[:2] + PAYMENTS[3:]))
    ids = lambda *names: spark.createDataFrame([(n,) for n in names], "order_id string")
    facts.remove(ids("C", "A"), [202401, 202402])
    facts.append(of_orders(after, ids("A", "B"), "left_semi"))
    changed = ids("A", "B", "C")
    months = increments.changed_months(
        before.orders.join(changed, "order_id", "left_semi"), after.orders.join(changed, "order_id", "left_semi")
    )
    assert months == [202401, 202402]
    increments.refresh_months(facts, str(tmp_path / "marts"), months)
    found = shown(spark)
    assert {row[1] for row in found["v_monthly_sales"]} >= {"2024-01", "None"}
    assert "2024-02" not in str(found["v_monthly_sales"])
    assert_as_refreshed_in_full(spark, after, found, tmp_path)


def test_orders_without_a_date_are_a_month_of_their_own(spark, tmp_path):
    model = undated(hand_model(spark, ORDERS, ITEMS, PAYMENTS))
    facts = DatedStore(model, str(tmp_path / "facts"))
    facts.write(facts_of(model))
    assert glob.glob(str(tmp_path / f"facts/order_items/{MONTH}={NO_VALUE}/*.parquet"))
    increments.refresh_months(facts, str(tmp_path / "marts"))
    gone = model.orders.where("order_id = 'D'")
    months = increments.changed_months(gone)
    assert months == [None]
    facts.remove(gone, months)
    increments.refresh_months(facts, str(tmp_path / "marts"), months)
    left = {name: rows.where("order_id <> 'D'") for name, rows in facts_of(model).items()}
    assert_as_refreshed_in_full(spark, increments.StoreModel(**{**vars(model), **left}), shown(spark), tmp_path)


def test_an_empty_store(spark, tmp_path):
    model = store(spark)
    facts = DatedStore(model, str(tmp_path / "facts"))
    facts.write(facts_of(model))
    counts = {r["mart"]: r["row_count"] for r in increments.refresh_months(facts, str(tmp_path / "marts")).collect()}
    assert counts == dict.fromkeys(MARTS, 0)


def test_a_refresh_opens_the_changed_months_only(spark, tmp_path):
    """All facts of other months are made unreadable before the refresh."""
    model = WarehouseStore(spark, FOLDER)
    late = model.orders.where(f"{PURCHASED} >= '1997-03-01' AND {PURCHASED} < '1997-04-01' AND order_id % 2 = 0")
    facts = DatedStore(model, str(tmp_path / "facts"))
    facts.write(of_orders(model, late, "left_anti"))
    increments.refresh_months(facts, str(tmp_path / "marts"))
    facts.append(of_orders(model, late, "left_semi"))
    for path in glob.glob(str(tmp_path / f"facts/*/{MONTH}=*/*.parquet")):
        if f"{MONTH}=199703" not in path:
            with open(path, "wb") as file:
                file.write(b"not a table")
    months = increments.changed_months(late)
    assert months == [199703]
    plan = facts.months(months).order_items._jdf.queryExecution().executedPlan().toString()
    assert f"PartitionFilters: [isnotnull({MONTH}" in plan and "= 199703" in plan
    increments.refresh_months(facts, str(tmp_path / "marts"), months)
    assert_as_refreshed_in_full(spark, model, shown(spark), tmp_path)


def test_a_repeated_refresh_changes_nothing(spark, tmp_path):
    model = hand_model(spark, ORDERS, ITEMS, PAYMENTS)
    facts = DatedStore(model, str(tmp_path / "facts"))
    facts.write(facts_of(model))
    increments.refresh_months(facts, str(tmp_path / "marts"))
    once = shown(spark)
    for _ in range(2):
        increments.refresh_months(facts, str(tmp_path / "marts"), [202401, 202412])
    assert shown(spark) == once


def test_only_named_months_are_replaced(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = lambda *pairs: spark.createDataFrame(list(pairs), f"v int, {MONTH} int")
    write_months(rows((1, 202401), (2, 202402), (3, None)), path)
    with pytest.raises(ValueError, match="202403"):
        replace_months(rows((9, 202403)), str(tmp_path / "other"), [202401])
    kept = replace_months(rows((4, 202401)), path, [202401, 202402])
    assert [tuple(r) for r in kept.collect()] == [(4, 202401)]
    left = spark.read.schema(f"v int, {MONTH} int").parquet(path)
    assert sorted(map(str, left.collect())) == sorted(map(str, rows((3, None), (4, 202401)).collect()))
    assert [tuple(r) for r in left.where(in_months([None])).collect()] == [(3, None)]
