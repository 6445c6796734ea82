from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from tillroll.operators import quantiles
from tillroll.operators.quantiles import _hit, _Search, cut_offs, score


def exact(values, parts):
    ranked = sorted(v for v in values if v is not None)
    return [ranked[math.ceil(len(ranked) * i / parts) - 1] for i in range(1, parts)]


def values_of(kind, n):
    rng = random.Random(n)
    return {
        "spread": [rng.uniform(-1e6, 1e6) for _ in range(n)],
        "few": [float(rng.randint(1, 4)) for _ in range(n)],
        "hot": [7.0 if i % 3 == 0 else rng.uniform(0, 100) for i in range(n)],
        "same": [3.0] * n,
        "far": [rng.choice([rng.uniform(0, 1), rng.uniform(0, 1e-9), 1e300, -1e300]) for _ in range(n)],
        "wide": [rng.choice([-1.7e308, 1.7e308, 5e-324, 0.0]) for _ in range(n)],
    }[kind]


@pytest.mark.parametrize("n", [1, 3, 7, 1000, 60_000])
def test_cut_offs_are_exact(spark, n):
    kinds = ["spread", "few", "hot", "same", "far", "wide"]
    data = list(zip(*[values_of(k, n) for k in kinds]))
    df = spark.createDataFrame(data, ", ".join(f"{k} double" for k in kinds)).repartition(7)
    found = cut_offs(df, kinds, 5)
    for kind in kinds:
        assert found[kind] == exact(values_of(kind, n), 5)


def test_nulls_do_not_count(spark):
    df = spark.createDataFrame([(v,) for v in [1, None, 2, 3, None, 4, 5]], "v int")
    assert cut_offs(df, ["v"], 5) == {"v": [1, 2, 3, 4]}


def test_nan_does_not_count(spark):
    df = spark.createDataFrame([(v,) for v in [1.0, math.nan, 3.0, 2.0, math.nan]], "v double")
    assert cut_offs(df, ["v"], 5) == {"v": [1.0, 2.0, 2.0, 3.0]}
    assert cut_offs(df.where("isnan(v)"), ["v"], 5) == {"v": []}


def test_infinite_values_are_refused(spark):
    with pytest.raises(ValueError, match="infinite"):
        cut_offs(spark.createDataFrame([(1.0,), (math.inf,)], "v double"), ["v"], 2)


def test_a_missed_place_stops_the_job():
    """A cut-off is never left out: a range too low or too high is an error."""
    for buckets in ([], [Row(rows=3, low=0.0, high=1.0)]):
        with pytest.raises(RuntimeError, match="outside"):
            _Search("v", 10, 2, 9, 0.0, 5.0).enter(buckets)


def test_few_buckets_need_more_rounds_only(spark):
    values = values_of("spread", 2000)
    df = spark.createDataFrame([(v,) for v in values], "v double")
    assert cut_offs(df, ["v"], 7, buckets=3)["v"] == exact(values, 7)


def test_counts_by_bucket_are_all_that_is_gathered(spark):
    """Rows per task after the shuffle follow the buckets, not the values."""
    df = spark.range(200_000).select((F.col("id") * 0.37).alias("v"))
    search = _Search("v", 100_000, 0, 200_000, 0.0, 0.37 * 199_999)
    hits = df.select(_hit(0, search, 50).alias("hit")).where("hit IS NOT NULL")
    assert hits.groupBy("hit.bucket").count().count() == 50
    assert cut_offs(df, ["v"], 2)["v"] == [0.37 * 99_999]


def test_no_rows_give_no_cut_offs(spark):
    assert cut_offs(spark.createDataFrame([], "v int"), ["v"], 3) == {"v": []}


def test_score_counts_the_cut_offs_below(spark):
    df = spark.createDataFrame([(v,) for v in (1, 2, 3, 9)], "v int")
    assert [r[0] for r in df.select(score(F.col("v"), [2.0, 3.0])).collect()] == [1, 1, 2, 3]


def reads(monkeypatch):
    """How often the rows are read, the sketch included."""
    made = []
    for name in ("_sketched", "_narrowed"):
        inner = getattr(quantiles, name)
        monkeypatch.setattr(quantiles, name, lambda *args, inner=inner: made.append(1) or inner(*args))
    return made


@pytest.mark.parametrize("kind", ["spread", "few", "hot", "same"])
def test_a_sketch_and_one_count_are_enough(spark, monkeypatch, kind):
    values = values_of(kind, 20_000)
    df = spark.createDataFrame([(v,) for v in values], "v double").repartition(9)
    made = reads(monkeypatch)
    assert cut_offs(df, ["v"], 5, buckets=4000)["v"] == exact(values, 5)
    assert len(made) == (1 if kind == "same" else 2)


def test_a_bracket_that_misses_is_found_out(spark, monkeypatch):
    """Sketched values that lie far off cost further reads, and no exactness."""
    values = values_of("hot", 3000) + [math.nan, None]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    sketched = quantiles._sketched
    for shift in (-60.0, 45.0, 1000.0):
        move = lambda found: (*found[:3], [x + shift for x in found[3]])  # noqa: E731,B023
        wrong = lambda *args: {c: move(found) for c, found in sketched(*args).items()}  # noqa: E731,B023
        monkeypatch.setattr(quantiles, "_sketched", wrong)
        assert cut_offs(df, ["v"], 5)["v"] == exact(values[:3000], 5)
