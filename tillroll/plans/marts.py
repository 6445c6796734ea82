"""Reporting marts: the seven tables a report imports, and their refresh."""

from __future__ import annotations

import uuid
from datetime import UTC, datetime
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tillroll.functions import dates
from tillroll.functions.money import reported
from tillroll.functions.ratios import ratio_or_zero
from tillroll.model import StoreModel
from tillroll.operators import quantiles
from tillroll.plans import measures
from tillroll.plans.measures import DELIVERED, ESTIMATED, PURCHASED
from tillroll.session import remove_folder, scratch, stored, subfolders
from tillroll.sources.catalog import replace_view
from tillroll.sources.files import replace_table

RFM_PARTS = 5
REFRESH = "refresh-"
REFRESH_FORMAT = f"{REFRESH}%Y%m%dT%H%M%S.%f"


def sales_summary(model: StoreModel) -> DataFrame:
    """One row per order line, with its order, payment, review and delivery.

    Payments and reviews are brought to one row per order first, so a second
    payment or review never repeats a line. Everything at order grain is
    joined before the lines, and the narrow product and seller columns come
    first, so the finished rows never shuffle again. Customers come last on
    the order side: it then enters the line join through a shuffle of its own,
    which lets adaptive execution split a hot order.
    """
    orders = model.orders.join(payments_per_order(model.order_payments), "order_id", "left")
    if "review_score" not in orders.columns:
        reviews = measures.review_per_order(model.order_reviews)
        orders = orders.join(reviews, "order_id", "left")
    orders = orders.join(model.customers, "customer_id", "left")
    return (
        model.order_items.join(model.products, "product_id", "left")
        .join(model.sellers, "seller_id", "left")
        .join(orders, "order_id", "left")
        .select(
            "order_id",
            "customer_unique_id",
            "customer_state",
            "product_id",
            "category",
            "seller_id",
            "seller_name",
            PURCHASED,
            DELIVERED,
            ESTIMATED,
            measures.delivery_days().alias("delivery_days"),
            "price",
            "payment_type",
            "payment_installments",
            "payment_value",
            "review_score",
        )
    )


def payments_per_order(payments: DataFrame) -> DataFrame:
    """Total paid, most installments, and the type that paid the most in all.

    Of types that paid the same the last by name counts.
    """
    per_type = payments.groupBy("order_id", "payment_type").agg(
        F.sum("payment_value").alias("paid"), F.max("payment_installments").alias("installments")
    )
    return per_type.groupBy("order_id").agg(
        F.max(F.struct("paid", "payment_type"))["payment_type"].alias("payment_type"),
        F.max("installments").alias("payment_installments"),
        F.sum("paid").cast("decimal(18,2)").alias("payment_value"),
    )


def summary_facts(summary: DataFrame, *keys: str) -> DataFrame:
    """Order facts (or part facts) out of a stored summary, without a join."""
    return summary.groupBy("order_id", *keys).agg(
        F.sum("price").alias("price"), F.count(F.lit(1)).alias("lines")
    )


def monthly_sales(facts: DataFrame) -> DataFrame:
    return facts.groupBy(dates.year_month(F.col(PURCHASED)).alias("month")).agg(
        reported(F.sum("price")).alias("total_revenue"),
        F.count("order_id").alias("order_count"),
        ratio_or_zero(F.sum("price"), F.count("order_id")).alias("aov"),
    )


def category_performance(facts: DataFrame) -> DataFrame:
    """``facts`` per (category, order)."""
    return measures.core_kpis(facts, "category")


def regional_sales(facts: DataFrame) -> DataFrame:
    return facts.groupBy("customer_state").agg(
        reported(F.sum("price")).alias("total_revenue"),
        F.count("order_id").alias("total_orders"),
        F.count_distinct("customer_unique_id").alias("total_customers"),
        ratio_or_zero(F.sum("price"), F.count("order_id")).alias("aov"),
        measures.per_line_mean("review_score").alias("avg_review_score"),
    )


def seller_performance(facts: DataFrame, sellers: DataFrame) -> DataFrame:
    """``facts`` per (seller, order). Names are added to the finished rows."""
    per_seller = (
        facts.withColumn("delivery_days", measures.delivery_days())
        .groupBy("seller_id")
        .agg(
            reported(F.sum("price")).alias("total_revenue"),
            F.count("order_id").alias("total_orders"),
            measures.per_line_mean("review_score").alias("avg_review_score"),
            measures.per_line_mean("delivery_days").alias("avg_delivery_days"),
        )
    )
    return per_seller.join(sellers.select("seller_id", "seller_name"), "seller_id", "left")


def payment_analysis(payments: DataFrame) -> DataFrame:
    return payments.groupBy("payment_type", "payment_installments").agg(
        F.count_distinct("order_id").alias("order_count"),
        reported(F.sum("payment_value")).alias("total_value"),
        ratio_or_zero(F.sum("payment_value"), F.count("payment_value")).alias("avg_value"),
    )


def customer_segments(facts: DataFrame) -> DataFrame:
    """Recency, frequency and monetary scores from 1 to 5, and a segment.

    Recency counts from the day of the last sale in the data. Scores compare
    with the quintile cut-offs over all customers. The customer rows are read
    three times (last day, cut-offs, scores), so they are stored in between.
    """
    return segments_of(_customer_activity(facts))


def segments_of(activity: DataFrame) -> DataFrame:
    """Scores and segments of customers with their last_day, frequency and monetary."""
    per_customer = stored(activity, "customer-activity")
    newest = per_customer.agg(F.max("last_day")).scalar()
    customers = per_customer.select(
        "customer_unique_id",
        F.date_diff(newest, F.col("last_day")).alias("recency_days"),
        "frequency",
        "monetary",
    )
    cut = quantiles.cut_offs(customers, ["recency_days", "frequency", "monetary"], RFM_PARTS)
    scored = customers.withColumns(
        {
            "r_score": F.lit(RFM_PARTS + 1)
            - quantiles.score(F.col("recency_days"), cut["recency_days"]),
            "f_score": quantiles.score(F.col("frequency"), cut["frequency"]),
            "m_score": quantiles.score(F.col("monetary"), cut["monetary"]),
        }
    )
    return scored.withColumn("rfm_segment", segment_name())


def _customer_activity(facts: DataFrame) -> DataFrame:
    known = facts.where(F.col("customer_unique_id").isNotNull())
    return known.groupBy("customer_unique_id").agg(
        F.to_date(F.max(PURCHASED)).alias("last_day"),
        F.count("order_id").alias("frequency"),
        reported(F.sum("price")).alias("monetary"),
    )


def segment_name() -> Column:
    """Our own naming; the scores carry the information."""
    r, f, m = F.col("r_score"), F.col("f_score"), F.col("m_score")
    return (
        F.when((r >= 4) & (f >= 4) & (m >= 4), "Champions")
        .when((r >= 3) & (f >= 3), "Loyal")
        .when((r >= 4) & (f <= 2), "Recent")
        .when((r <= 2) & ((f >= 4) | (m >= 4)), "At Risk")
        .when(r <= 2, "Hibernating")
        .otherwise("Regular")
    )


def segment_counts(segments: DataFrame) -> DataFrame:
    return (
        segments.groupBy("rfm_segment")
        .agg(F.count(F.lit(1)).alias("customers"))
        .orderBy(F.desc("customers"), "rfm_segment")
    )


def refresh(model: StoreModel, folder: str, keep: int = 2) -> DataFrame:
    """Recompute all marts below ``folder``; returns their row counts.

    Every refresh writes a folder of its own. Once all marts are there, the
    session views of their names move to it, so a reader never meets a missing
    or half-written mart, and one that opened an earlier refresh keeps its
    files. The last ``keep`` refreshes stay, older ones are deleted. A refresh
    that fails leaves the views where they were.

    The summary is written first and the other marts start from it, so the
    joins run once per refresh. Its lines are summed per order once more and
    stored for the three marts at order grain, until the marts are written.
    """
    spark = model.order_items.sparkSession
    folder = folder.rstrip("/")
    target = f"{folder}/{datetime.now(UTC):{REFRESH_FORMAT}}-{uuid.uuid4().hex[:8]}"
    with scratch(spark):
        written = _write_marts(model, target)
    return publish(spark, folder, written, keep)


def publish(spark: SparkSession, folder: str, written: dict[str, DataFrame], keep: int) -> DataFrame:
    """Move the views to the written marts and delete old refreshes; the row counts of the marts."""
    views = {name: replace_view(df, name) for name, df in written.items()}
    refreshes = [name for name in subfolders(spark, folder) if name.startswith(REFRESH)]
    for old in refreshes[: -max(keep, 1)]:
        remove_folder(spark, f"{folder}/{old}")
    counts = [
        df.agg(F.count(F.lit(1)).alias("row_count")).select(F.lit(name).alias("mart"), "row_count")
        for name, df in views.items()
    ]
    return reduce(DataFrame.unionByName, counts)


def _write_marts(model: StoreModel, target: str) -> dict[str, DataFrame]:
    summary = replace_table(sales_summary(model), f"{target}/v_sales_summary")
    order_columns = ("customer_state", "customer_unique_id", "review_score", PURCHASED)
    seller = ("seller_id", "review_score", PURCHASED, DELIVERED)
    orders = stored(summary_facts(summary, *order_columns), "order-facts")
    marts = {
        "v_monthly_sales": monthly_sales(orders),
        "v_category_performance": category_performance(
            summary_facts(summary, "category", "review_score")
        ),
        "v_customer_segments": customer_segments(orders),
        "v_seller_performance": seller_performance(
            summary_facts(summary, *seller), model.sellers
        ),
        "v_regional_sales": regional_sales(orders),
        "v_payment_analysis": payment_analysis(model.order_payments),
    }
    return {"v_sales_summary": summary} | {
        name: replace_table(mart, f"{target}/{name}") for name, mart in marts.items()
    }
