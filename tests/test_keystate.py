"""Key checks of batches give what checks of all rows give."""

from __future__ import annotations

import glob

from tables import row_set

from tillroll.operators import integrity, keystate
from tillroll.operators.keystate import BUCKET, KeyState

KEYS = {"customers": "customer_id string", "products": "product_id string", "orders": "order_id string, customer_id string"}
KEYS["order_items"] = "order_item_id string, order_id string, product_id string"


def made(spark, **rows):
    return {name: spark.createDataFrame(some, KEYS[name]) for name, some in rows.items()}


def assert_as_checked(spark, state, batches):
    whole = {
        name: spark.createDataFrame([row for batch in batches for row in batch.get(name, [])], kinds)
        for name, kinds in KEYS.items()
    }
    assert row_set(state.primary_keys()) == row_set(integrity.check_primary_keys(whole))
    assert row_set(state.foreign_keys()) == row_set(integrity.check_foreign_keys(whole))


def test_batch_by_batch(spark, tmp_path):
    state = KeyState(spark, str(tmp_path), buckets=5)
    batches = [
        {"customers": [("c1",), ("c2",)], "orders": [("o1", "c1"), ("o2", "c7"), ("o3", None)]},
        # A parent that comes late, a repeated key, lines before their products.
        {"customers": [("c7",), ("c1",)], "order_items": [("i1", "o1", "p1"), ("i2", "o9", "p1"), (None, "o1", None)]},
        {"products": [("p1",), ("p2",)], "orders": [("o1", "c8"), ("o1", "c8"), (None, "c2")]},
        {"order_items": [("i1", "o9", "p3")] * 50, "customers": [(None,), (None,)]},
        {"products": []},
    ]
    for i, batch in enumerate(batches):
        state.append(made(spark, **batch))
        assert_as_checked(spark, state, batches[: i + 1])


def test_nothing_yet(spark, tmp_path):
    state = KeyState(spark, str(tmp_path))
    assert_as_checked(spark, state, [])


def test_a_batch_opens_its_own_buckets_only(spark, tmp_path):
    state = KeyState(spark, str(tmp_path), buckets=64)
    first = {"customers": [(f"c{i}",) for i in range(500)], "orders": [(f"o{i}", f"c{i % 400}") for i in range(500)]}
    state.append(made(spark, **first))
    second = {"orders": [("o7", "c3"), ("new", "nobody")]}
    touched = spark.createDataFrame([("o7",), ("new",), ("c3",), ("nobody",)], "v string")
    touched = {r[0] for r in touched.selectExpr("pmod(xxhash64(v), 64)").collect()}
    spoiled = [f for f in glob.glob(f"{tmp_path}/*/values/{BUCKET}=*/*.parquet") if int(f.split(f"{BUCKET}=")[1].split("/")[0]) not in touched]
    assert len(spoiled) > 100
    for path in spoiled:
        with open(path, "wb") as file:
            file.write(b"not a table")
    state.append(made(spark, **second))
    assert_as_checked(spark, state, [first, second])


def test_a_batch_is_counted_in_one_shuffle(spark, tmp_path):
    rows = made(spark, orders=[("o1", "c1")], order_items=[("i1", "o1", "p1")])
    plan = KeyState(spark, str(tmp_path))._counts_of_batch("orders", rows)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_large_buckets_are_added_up_in_parts(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(keystate, "ROWS_AT_ONCE", 40)
    state = KeyState(spark, str(tmp_path), buckets=3)
    batches = [{"customers": [(f"c{i % 400}",) for i in range(500)] + [(None,)]} for _ in range(3)]
    for batch in batches:
        state.append(made(spark, **batch))
    assert_as_checked(spark, state, batches)
    assert not glob.glob(f"{tmp_path}/*/*-staged-*")
    files = glob.glob(f"{tmp_path}/customers/values/{BUCKET}=*/*.parquet")
    assert len(files) > 6 and max(spark.read.parquet(f).count() for f in files) < 134
