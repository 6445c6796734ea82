from __future__ import annotations

import os
from dataclasses import fields, replace
from datetime import date

import pytest
from pyspark.sql import functions as F
from tables import row_set, rows, store

from tillroll import SalesFilter, StoreModel
from tillroll.plans import marts, measures
from tillroll.plans.measures import DELIVERED, ESTIMATED, PURCHASED
from tillroll.sources.catalog import import_views
from tillroll.sources.warehouse import WarehouseStore


@pytest.fixture(scope="module")
def shop(spark):
    return store(
        spark,
        # order, customer, purchased, delivered, estimated
        orders=[
            ("o1", "k1", "2024-01-01", "2024-01-05", "2024-01-05"),
            ("o2", "k2", "2024-01-31", "2024-02-12", "2024-02-10"),
            ("o3", "k3", "2024-03-02", None, "2024-03-20"),
            ("o4", "k4", "2025-02-01", "2025-02-01", "2025-02-09"),
        ],
        items=[
            ("o1", "p1", "s1", 10), ("o1", "p2", "s1", 20), ("o1", "p1", "s2", 30),
            ("o2", "p1", "s1", 40),
            ("o3", "p2", "s2", 5),
            ("o4", "p9", "s9", 100),
        ],
        payments=[
            ("o1", "card", 3, 50), ("o1", "voucher", 1, 10),
            ("o2", "card", 13, 40), ("o3", "boleto", 1, 5), ("o4", "card", 7, 100),
        ],
        reviews=[("o1", 5), ("o1", 2), ("o2", 1), ("o4", None)],
        # one person may appear under several customer ids
        customers=[("k1", "u1", "SP"), ("k2", "u1", "SP"), ("k3", "u2", "RJ"), ("k4", "u3", None)],
        products=[("p1", "toys"), ("p2", "books")],
        sellers=[("s1", "anna"), ("s2", "bert")],
    )


def test_core_kpis_weigh_reviews_by_lines(spark, shop):
    facts = measures.order_facts(shop, "review_score")
    # o1: three lines with mean score 3.5, o2: one line with 1, others unrated
    assert rows(measures.core_kpis(facts)) == [(205.0, 4, 51.25, (3 * 3.5 + 1) / 4)]


def test_on_time_counts_lines_and_missing_delivery_as_late(spark, shop):
    facts = measures.order_facts(shop, DELIVERED, ESTIMATED)
    assert rows(measures.on_time_percent(facts)) == [(4, 6, 4 / 6 * 100)]


def test_delivery_days(spark, shop):
    facts = measures.order_facts(shop, PURCHASED, DELIVERED)
    mean = (3 * 4 + 12 + 0) / 5
    assert rows(measures.avg_delivery_days(facts)) == [(mean,)]
    assert row_set(measures.delivery_histogram(facts)) == {(0, 4, mean), (10, 1, mean)}


def test_growth_needs_the_calendar_month_before(spark, shop):
    facts = measures.order_facts(shop, PURCHASED)
    # March has no February before it; February 2025 has no January
    assert row_set(measures.mom_growth(facts)) == {
        (2024, 1, 100.0, None, 0.0), (2024, 3, 5.0, None, 0.0), (2025, 2, 100.0, None, 0.0)
    }


def test_growth_across_december(spark):
    model = store(
        spark,
        orders=[("a", "k", "2023-12-09", None, "2024-01-01"), ("b", "k", "2024-01-09", None, "2024-01-01"),
                ("c", "k", "2024-02-09", None, "2024-01-01"), ("d", "k", "2024-03-09", None, "2024-01-01")],
        items=[("a", "p", "s", 50), ("b", "p", "s", 75), ("c", "p", "s", 0), ("d", "p", "s", 9)],
    )
    growth = measures.mom_growth(measures.order_facts(model, PURCHASED))
    assert row_set(growth.select("order_year", "order_month", "mom_growth_pct")) == {
        (2023, 12, 0.0), (2024, 1, 50.0), (2024, 2, -100.0), (2024, 3, 0.0)
    }


def test_running_total_starts_anew_each_year(spark, shop):
    facts = measures.order_facts(shop, PURCHASED)
    assert row_set(measures.ytd_revenue(facts)) == {
        (2024, 1, 100.0, 100.0), (2024, 3, 5.0, 105.0), (2025, 2, 100.0, 100.0)
    }


def test_repeat_rate_counts_people_not_ids(spark, shop):
    facts = measures.order_facts(shop, "customer_unique_id")
    assert rows(measures.repeat_rate(facts)) == [(3, 1, 1 / 3 * 100)]


def test_installment_groups(spark, shop):
    assert row_set(measures.installment_groups(shop.order_payments)) == {
        ("2–3", "card", 1), ("13+", "card", 1), ("7–12", "card", 1),
        ("1 (Full)", "voucher", 1), ("1 (Full)", "boleto", 1),
    }


def test_payment_share(spark, shop):
    shares = {t: (v, p) for t, v, p in rows(measures.payment_share(shop.order_payments))}
    assert shares["card"] == (190.0, 190 / 205 * 100)
    assert sum(p for _, p in shares.values()) == pytest.approx(100)


def test_calendar_labels(spark, shop):
    facts = measures.order_facts(shop, PURCHASED)
    assert row_set(measures.quarterly_revenue(facts)) == {("2024-Q1", 105.0), ("2025-Q1", 100.0)}
    assert rows(measures.revenue_by_weekday(facts)) == [
        (0, "Monday", 60.0), (2, "Wednesday", 40.0), (5, "Saturday", 105.0)
    ]
    assert (4, "2024-01", "Monday") in {r[1:] for r in rows(measures.calculated_columns(shop.orders))}


def test_matrix_leaves_empty_months_null(spark, shop):
    matrix = measures.year_month_matrix(measures.order_facts(shop, PURCHASED)).orderBy("order_year")
    assert matrix.columns == ["order_year"] + [f"m{m:02d}" for m in range(1, 13)]
    assert [r[:4] for r in rows(matrix)] == [(2024, 100.0, None, 5.0), (2025, None, 100.0, None)]


@pytest.mark.parametrize(
    ("year", "quarter", "expected"),
    [(2024, 1, (105.0, 3)), (2024, None, (105.0, 3)), (None, 1, (205.0, 4)), (None, None, (205.0, 4)),
     (2024, 4, (None, 0))],
)
def test_period_slicers(spark, shop, year, quarter, expected):
    facts = measures.order_facts(shop, PURCHASED)
    assert rows(measures.revenue_in_period(facts, year, quarter)) == [expected]


def test_second_payment_or_review_never_repeats_a_line(spark, shop):
    summary = marts.sales_summary(shop)
    assert summary.count() == 6
    o1 = summary.where("order_id = 'o1'").select(
        "payment_type", "payment_installments", "payment_value", "review_score", "delivery_days"
    )
    assert {(r[0], r[1], float(r[2]), r[3], r[4]) for r in rows(o1)} == {("card", 3, 60.0, 3.5, 4)}
    assert summary.selectExpr("cast(sum(price) as double)").first()[0] == 205.0


def test_facts_from_a_stored_summary_equal_facts_from_the_tables(spark, shop):
    summary = marts.sales_summary(shop)
    keys = ("customer_state", "customer_unique_id", "review_score")
    stored = marts.regional_sales(marts.summary_facts(summary, *keys))
    assert row_set(stored) == row_set(marts.regional_sales(measures.order_facts(shop, *keys)))
    by_part = marts.category_performance(marts.summary_facts(summary, "category", "review_score"))
    direct = marts.category_performance(measures.part_facts(shop, "category", "review_score"))
    assert row_set(by_part) == row_set(direct)


def test_category_orders_are_distinct(spark, shop):
    kpis = measures.core_kpis(measures.part_facts(shop, "category", "review_score"), "category")
    found = {r[0]: r[1:] for r in rows(kpis)}
    assert found["toys"] == (80.0, 2, 40.0, (2 * 3.5 + 1) / 3)
    assert found["books"] == (25.0, 2, 12.5, 3.5)
    assert found[None] == (100.0, 1, 100.0, None)


def test_sellers(spark, shop):
    facts = measures.part_facts(shop, "seller_id", "review_score", PURCHASED, DELIVERED)
    found = {r.seller_id: r for r in marts.seller_performance(facts, shop.sellers).collect()}
    assert found["s1"].seller_name == "anna" and found["s9"].seller_name is None
    assert found["s1"].total_orders == 2
    assert found["s1"].avg_delivery_days == (2 * 4 + 12) / 3
    assert found["s2"].avg_review_score == 3.5


def test_segments_cover_every_person_once(spark, shop):
    facts = measures.order_facts(shop, "customer_unique_id", PURCHASED)
    segments = {r.customer_unique_id: r for r in marts.customer_segments(facts).collect()}
    assert set(segments) == {"u1", "u2", "u3"}
    assert (segments["u1"].frequency, segments["u1"].monetary) == (2, 100.0)
    assert segments["u3"].recency_days == 0 and segments["u3"].r_score == 5
    assert segments["u2"].m_score < segments["u1"].m_score


def test_refresh_twice_gives_the_same_marts(spark, shop, tmp_path):
    first = row_set(marts.refresh(shop, str(tmp_path)))
    reader = spark.table("v_monthly_sales")
    expected = {("2024-01", 2), ("2024-03", 1), ("2025-02", 1)}
    assert first == row_set(marts.refresh(shop, str(tmp_path)))
    assert dict(first)["v_sales_summary"] == 6
    assert import_views(spark, ["v_sales_summary"])["v_sales_summary"].count() == 6
    # who opened the earlier refresh still reads it, and the view has moved on
    assert row_set(reader.select("month", "order_count")) == expected
    assert row_set(spark.table("v_monthly_sales").select("month", "order_count")) == expected
    assert reader.inputFiles() != spark.table("v_monthly_sales").inputFiles()


def test_refresh_keeps_the_last_ones_and_no_intermediates(spark, shop, tmp_path):
    shared = spark.conf.get("spark.checkpoint.dir")
    before = set(os.listdir(shared))
    for _ in range(4):
        marts.refresh(shop, str(tmp_path), keep=2)
    assert len([n for n in os.listdir(tmp_path) if n.startswith(marts.REFRESH)]) == 2
    assert set(os.listdir(shared)) == before
    assert spark.table("v_sales_summary").count() == 6


def test_a_failed_refresh_leaves_the_views(spark, shop, tmp_path):
    marts.refresh(shop, str(tmp_path))
    broken = replace(shop, order_payments=shop.order_payments.drop("payment_installments"))
    with pytest.raises(Exception, match="payment_installments"):
        marts.refresh(broken, str(tmp_path))
    assert spark.table("v_monthly_sales").count() == 3


def test_the_type_that_paid_most_in_all(spark):
    paid = [("o1", "card", 1, "100"), ("o1", "voucher", 1, "60"), ("o1", "voucher", 2, "60"), ("o2", "card", 3, "5")]
    df = spark.createDataFrame(paid, "order_id string, payment_type string, payment_installments int, amount string")
    df = df.withColumn("payment_value", df.amount.cast("decimal(10,2)"))
    found = {r.order_id: r for r in marts.payments_per_order(df).collect()}
    assert (found["o1"].payment_type, found["o1"].payment_installments, found["o1"].payment_value) == ("voucher", 2, 220)
    assert found["o2"].payment_type == "card"


def test_a_slice_is_the_model_of_what_is_left(spark, shop):
    chosen = SalesFilter(start=date(2024, 1, 1), end=date(2024, 12, 31))
    facts = measures.order_facts(measures.sliced(shop, chosen), PURCHASED)
    whole = measures.order_facts(shop, PURCHASED).where("year(order_purchase_timestamp) = 2024")
    assert row_set(facts) == row_set(whole)
    assert row_set(measures.order_facts(measures.sliced(shop, SalesFilter()))) == row_set(measures.order_facts(shop))
    (category,) = {r[0] for r in shop.products.select("category").limit(1).collect()}
    lines = measures.sliced(shop, SalesFilter(categories=(category,))).order_items
    kept = shop.order_items.join(shop.products, "product_id").where(F.col("category") == category)
    assert lines.count() == kept.count()


def test_the_store_slices_as_the_model_does(spark):
    store = WarehouseStore(spark, "/root/testdata/sf0.001")
    model = StoreModel(**{f.name: getattr(store, f.name) for f in fields(StoreModel)})
    chosen = SalesFilter(date(1997, 1, 1), date(1999, 12, 31), ("ECONOMY", "SMALL"), ("NATION_1", "NATION_4"))
    columns = ("customer_state", "review_score", PURCHASED, measures.DELIVERED)
    for one in (chosen, SalesFilter(states=("NATION_2",)), SalesFilter()):
        sliced = row_set(store.sliced(one).order_facts(*columns))
        joined = measures.order_facts(measures.sliced(model, one), *columns)
        assert sliced and sliced == row_set(joined.select("order_id", "price", "lines", *columns))
        payments = measures.sliced(model, one).order_payments
        assert sorted(rows(store.sliced(one).order_payments)) == sorted(rows(payments))
