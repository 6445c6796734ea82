"""Refreshing the marts by month: the cost follows the changed months, not the history.

The state of a refresh is the sales summary by month and, for each mart, mergeable rows by month: sums, line and order
counts, last days. An order lies in one month, so counts of orders add up over months; customers do not, so their rows
keep one line per customer, state and month, from which distinct customers and segments are made. A refresh reads the
facts of the changed months, writes these months of the state anew, and makes the marts from the state.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable
from datetime import UTC, datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillroll.functions.money import reported
from tillroll.functions.ratios import ratio_or_zero
from tillroll.model import StoreModel
from tillroll.plans import marts, measures
from tillroll.plans.measures import DELIVERED, PURCHASED
from tillroll.session import scratch, stored
from tillroll.sources.dated import MONTH, DatedStore, Months, month_of, read_months, replace_months, write_months
from tillroll.sources.files import replace_table

STATE = "state"
SUMMARY = "v_sales_summary"


def changed_months(*images: DataFrame) -> list[int | None]:
    """The months of changed orders, given as they were before and as they are after the change.

    A new order has an after image only and a deleted one a before image only; a late one counts in the month of
    its date. None stands for orders without a date. The list is as long as the calendar at most.
    """
    months: set[int | None] = set()
    for image in images:
        found = image.select(month_of(F.col(PURCHASED)).alias(MONTH)).distinct().collect()
        months.update(row[MONTH] for row in found)
    return sorted(months, key=lambda month: (month is None, month))


def _weighted(column: str) -> dict[str, Column]:
    """Sum and lines behind a mean per line."""
    known = F.when(F.col(column).isNotNull(), F.col("lines"))
    return {f"{column}_sum": F.sum(F.col(column) * F.col("lines")), f"{column}_lines": F.sum(known)}


def _mean(column: str) -> Column:
    return F.try_divide(F.sum(f"{column}_sum").cast("double"), F.sum(f"{column}_lines").cast("double"))


def _sums(facts: DataFrame, keys: tuple[str, ...], **more: Column) -> DataFrame:
    sums = {"price": F.sum("price"), "orders": F.count("order_id"), **more}
    return facts.groupBy(MONTH, *keys).agg(*[column.alias(name) for name, column in sums.items()])


def partial_rows(summary: DataFrame, payments: DataFrame) -> dict[str, DataFrame]:
    """The mergeable rows of some months, given those months of the stored summary and of the payments."""
    orders = stored(
        marts.summary_facts(summary, MONTH, "customer_state", "customer_unique_id", "review_score", PURCHASED),
        "order-facts",
    )
    categories = marts.summary_facts(summary, MONTH, "category", "review_score")
    sellers = marts.summary_facts(summary, MONTH, "seller_id", "review_score", PURCHASED, DELIVERED)
    sellers = sellers.withColumn("delivery_days", measures.delivery_days())
    paid = payments.groupBy(MONTH, "payment_type", "payment_installments").agg(
        F.count_distinct("order_id").alias("orders"),
        F.sum("payment_value").alias("paid"),
        F.count("payment_value").alias("payments"),
    )
    return {
        "months": _sums(orders, ()),
        "categories": _sums(categories, ("category",), **_weighted("review_score")),
        "sellers": _sums(sellers, ("seller_id",), **_weighted("review_score"), **_weighted("delivery_days")),
        "customers": _sums(
            orders,
            ("customer_unique_id", "customer_state"),
            last_purchase=F.max(PURCHASED),
            **_weighted("review_score"),
        ),
        "payments": paid,
    }


def _kpis(rows: DataFrame, *by: str, **more: Column) -> DataFrame:
    revenue, orders = F.sum("price"), F.sum("orders")
    columns = {"total_revenue": reported(revenue), "total_orders": orders, **more}
    return rows.groupBy(*by).agg(*[column.alias(name) for name, column in columns.items()])


def monthly_sales(rows: DataFrame) -> DataFrame:
    label = F.format_string("%04d-%02d", F.floor(F.col(MONTH) / 100), F.col(MONTH) % 100)
    return rows.select(
        F.when(F.col(MONTH).isNotNull(), label).alias("month"),
        reported("price").alias("total_revenue"),
        F.col("orders").alias("order_count"),
        ratio_or_zero(F.col("price"), F.col("orders")).alias("aov"),
    )


def category_performance(rows: DataFrame) -> DataFrame:
    aov = ratio_or_zero(F.sum("price"), F.sum("orders"))
    return _kpis(rows, "category", aov=aov, avg_review_score=_mean("review_score"))


def regional_sales(customers: DataFrame) -> DataFrame:
    """Two steps: a customer's months first, so that distinct customers are rows."""
    sums = ["price", "orders", "review_score_sum", "review_score_lines"]
    each = customers.groupBy("customer_state", "customer_unique_id").agg(*[F.sum(c).alias(c) for c in sums])
    return _kpis(
        each,
        "customer_state",
        total_customers=F.count("customer_unique_id"),
        aov=ratio_or_zero(F.sum("price"), F.sum("orders")),
        avg_review_score=_mean("review_score"),
    )


def seller_performance(rows: DataFrame, sellers: DataFrame) -> DataFrame:
    means = {"avg_review_score": _mean("review_score"), "avg_delivery_days": _mean("delivery_days")}
    return _kpis(rows, "seller_id", **means).join(sellers.select("seller_id", "seller_name"), "seller_id", "left")


def payment_analysis(rows: DataFrame) -> DataFrame:
    return rows.groupBy("payment_type", "payment_installments").agg(
        F.sum("orders").alias("order_count"),
        reported(F.sum("paid")).alias("total_value"),
        ratio_or_zero(F.sum("paid"), F.sum("payments")).alias("avg_value"),
    )


def customer_activity(customers: DataFrame) -> DataFrame:
    known = customers.where(F.col("customer_unique_id").isNotNull())
    return known.groupBy("customer_unique_id").agg(
        F.to_date(F.max("last_purchase")).alias("last_day"),
        F.sum("orders").alias("frequency"),
        reported(F.sum("price")).alias("monetary"),
    )


def refresh_months(store: DatedStore, folder: str, months: Months = None, keep: int = 2) -> DataFrame:
    """Bring the marts below folder up to date with the given months of the facts; returns their row counts.

    None refreshes every month, as the first refresh must. Views, old refreshes and failures are as in
    :func:`marts.refresh`, but for the sales summary: its months, like those of the state, are replaced
    in place. A refresh that failed half-way is mended by running it again with the same months.
    """
    folder = folder.rstrip("/")
    months = None if months is None else list(months)
    target = f"{folder}/{datetime.now(UTC):{marts.REFRESH_FORMAT}}-{uuid.uuid4().hex[:8]}"
    with scratch(store.spark):
        summary, rows = _refreshed_state(store.months(months), f"{folder}/{STATE}", months)
        made = marts_of(rows, store.model)
        written = {name: replace_table(mart, f"{target}/{name}") for name, mart in made.items()}
    return marts.publish(store.spark, folder, {SUMMARY: summary.drop(MONTH)} | written, keep)


def marts_of(rows: dict[str, DataFrame], model: StoreModel) -> dict[str, DataFrame]:
    """All marts but the summary, from the mergeable rows of all months."""
    return {
        "v_monthly_sales": monthly_sales(rows["months"]),
        "v_category_performance": category_performance(rows["categories"]),
        "v_customer_segments": marts.segments_of(customer_activity(rows["customers"])),
        "v_seller_performance": seller_performance(rows["sellers"], model.sellers),
        "v_regional_sales": regional_sales(rows["customers"]),
        "v_payment_analysis": payment_analysis(rows["payments"]),
    }


def _refreshed_state(
    changed: StoreModel, state: str, months: Iterable[int | None] | None
) -> tuple[DataFrame, dict[str, DataFrame]]:
    """The summary and the mergeable rows of all months, after those of the changed months were written."""
    spark = changed.orders.sparkSession
    write: Callable[[DataFrame, str], DataFrame] = (
        write_months if months is None else lambda rows, path: replace_months(rows, path, months)
    )
    summary = marts.sales_summary(changed).withColumn(MONTH, month_of(F.col(PURCHASED)))
    fresh = write(summary, f"{state}/{SUMMARY}")
    partials = partial_rows(fresh, changed.order_payments)
    rows = {name: write(partial, f"{state}/{name}") for name, partial in partials.items()}
    if months is None:
        return fresh, rows
    whole = lambda name, part: read_months(spark, f"{state}/{name}", part.schema)
    return whole(SUMMARY, fresh), {name: whole(name, part) for name, part in rows.items()}
