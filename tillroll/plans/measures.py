"""Report measures over order facts.

``order_facts`` holds one row per order: its attributes, ``price`` (sum over
its lines) and ``lines`` (their number). A measure defined per sales line is
the ``lines``-weighted measure per order, so the lines are reduced once, by
partial sums, before any join.

``part_facts`` is the same at the grain of one attribute of the lines (product
category, seller) and the order. Use it grouped by that attribute only: an
order has a row per part.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillroll.functions import bins, dates
from tillroll.functions.money import reported
from tillroll.functions.ratios import percent_or_zero, ratio, ratio_or_zero
from tillroll.model import StoreModel
from tillroll.operators import periods, running, shares, toplists
from tillroll.operators.filters import SalesFilter

PURCHASED = "order_purchase_timestamp"
DELIVERED = "order_delivered_customer_date"
ESTIMATED = "order_estimated_delivery_date"
ORDER_DATES = (PURCHASED, DELIVERED, ESTIMATED)


def order_facts(model: StoreModel, *columns: str) -> DataFrame:
    """Facts with the requested order, review or customer columns only.

    A table is joined only when one of its columns is asked for.
    """
    facts = model.order_items.groupBy("order_id").agg(
        F.sum("price").alias("price"), F.count(F.lit(1)).alias("lines")
    )
    return _with_order_columns(facts, model, columns)


def part_facts(model: StoreModel, part: str, *columns: str) -> DataFrame:
    """Facts per (part, order); ``part`` is "category" or a column of the lines.

    The lines are summed before the order columns are joined. Joining first
    would save a shuffle, but a hot order would then reach one task whole:
    adaptive execution splits a join side only where it is a plain shuffle.
    """
    lines = model.order_items
    if part == "category":
        lines = lines.join(model.products.select("product_id", part), "product_id", "left")
    facts = lines.groupBy(part, "order_id").agg(
        F.sum("price").alias("price"), F.count(F.lit(1)).alias("lines")
    )
    return _with_order_columns(facts, model, columns)


def sliced(model: StoreModel, chosen: SalesFilter) -> StoreModel:
    """What a report's slicers leave of a model, for any measure.

    Orders of the chosen days and customer states; of their lines those of the
    chosen categories; their payments and reviews. Conditions are semi-joins
    on the keys, before any sum.
    """
    orders, lines, products = model.orders, model.order_items, model.products
    payments, reviews = model.order_payments, model.order_reviews
    if chosen.has_dates:
        orders = orders.where(chosen.date_condition(F.col(PURCHASED)))
    if chosen.states:
        here = model.customers.where(F.col("customer_state").isin(*chosen.states))
        orders = orders.join(here.select("customer_id"), "customer_id", "left_semi")
    if chosen.narrows_orders:
        kept = orders.select("order_id")
        lines = lines.join(kept, "order_id", "left_semi")
        payments = payments.join(kept, "order_id", "left_semi")
        reviews = reviews.join(kept, "order_id", "left_semi")
    if chosen.categories:
        products = products.where(F.col("category").isin(*chosen.categories))
        lines = lines.join(products.select("product_id"), "product_id", "left_semi")
    return replace(
        model, orders=orders, order_items=lines, products=products, order_payments=payments, order_reviews=reviews
    )


def core_kpis(facts: DataFrame, *by: str) -> DataFrame:
    """Revenue, orders, order value and mean review, overall or per group."""
    return facts.groupBy(*by).agg(
        reported(F.sum("price")).alias("total_revenue"),
        F.count("order_id").alias("total_orders"),
        ratio_or_zero(F.sum("price"), F.count("order_id")).alias("aov"),
        per_line_mean("review_score").alias("avg_review_score"),
    )


def on_time_percent(facts: DataFrame, *by: str) -> DataFrame:
    """Lines delivered by the estimated date, of all lines.

    An order without a delivery date counts as not on time.
    """
    on_time = F.when(F.col(DELIVERED) <= F.col(ESTIMATED), F.col("lines")).otherwise(F.lit(0))
    return facts.groupBy(*by).agg(
        F.coalesce(F.sum(on_time), F.lit(0)).alias("on_time_lines"),
        F.coalesce(F.sum("lines"), F.lit(0)).alias("all_lines"),
        percent_or_zero(F.sum(on_time), F.sum("lines")).alias("on_time_delivery_pct"),
    )


def avg_delivery_days(facts: DataFrame, *by: str) -> DataFrame:
    dated = facts.withColumn("delivery_days", delivery_days())
    return dated.groupBy(*by).agg(per_line_mean("delivery_days").alias("avg_delivery_days"))


def mom_growth(facts: DataFrame) -> DataFrame:
    """Growth against the calendar month before; 0 without a base."""
    compared = periods.with_previous_calendar_month(_monthly(facts), "revenue", "previous")
    growth = F.coalesce(
        periods.growth_percent(F.col("revenue"), F.col("previous")), F.lit(0.0)
    )
    return compared.select(
        "order_year",
        "order_month",
        reported("revenue").alias("revenue"),
        reported("previous").alias("previous_month_revenue"),
        growth.alias("mom_growth_pct"),
    )


def ytd_revenue(facts: DataFrame) -> DataFrame:
    return periods.running_in_year(_monthly(facts), "revenue", "to_date").select(
        "order_year",
        "order_month",
        reported("revenue").alias("revenue"),
        reported("to_date").alias("ytd_revenue"),
    )


def running_daily(facts: DataFrame) -> DataFrame:
    """Revenue of each day with the totals up to it, of its year and of all years. Undated sales are left out."""
    day = F.to_date(PURCHASED)
    days = facts.where(F.col(PURCHASED).isNotNull()).groupBy(day.alias("day")).agg(F.sum("price").alias("revenue"))
    return _running(days.withColumn("order_year", F.year("day")), ["day"], "revenue").drop("order_year")


def running_orders(facts: DataFrame) -> DataFrame:
    """Revenue of each order with the totals up to it; orders of one moment go by their id."""
    orders = facts.where(F.col(PURCHASED).isNotNull()).select(
        "order_id", PURCHASED, F.col("price").alias("revenue"), F.year(PURCHASED).alias("order_year")
    )
    return _running(orders, [PURCHASED, "order_id"], "revenue").drop("order_year")


def _running(rows: DataFrame, order_by: list[str], value: str) -> DataFrame:
    in_year = running.running_total(rows, order_by, value, "year_to_date", within=["order_year"])
    ever = running.running_total(in_year, order_by, value, "to_date")
    return ever.withColumns({c: reported(c) for c in (value, "year_to_date", "to_date")})


def repeat_rate(facts: DataFrame) -> DataFrame:
    """Customers with two or more orders, of all customers with any."""
    per_customer = facts.groupBy("customer_unique_id").agg(F.count("order_id").alias("orders"))
    repeaters = F.count_if(F.col("orders") > 1)
    customers = F.count("customer_unique_id")
    return per_customer.where(F.col("customer_unique_id").isNotNull()).agg(
        customers.alias("total_customers"),
        repeaters.alias("repeat_customers"),
        percent_or_zero(repeaters, customers).alias("repeat_customer_rate_pct"),
    )


def calculated_columns(orders: DataFrame) -> DataFrame:
    return orders.select(
        "order_id",
        delivery_days().alias("delivery_days"),
        dates.year_month(F.col(PURCHASED)).alias("order_month"),
        dates.day_name(F.col(PURCHASED)).alias("day_of_week"),
    )


def installment_groups(payments: DataFrame) -> DataFrame:
    """Orders per installment group and payment type."""
    group = bins.installment_group(F.col("payment_installments"))
    return payments.groupBy(group.alias("installment_group"), "payment_type").agg(
        F.count_distinct("order_id").alias("order_count")
    )


def quarterly_revenue(facts: DataFrame) -> DataFrame:
    return facts.groupBy(dates.year_quarter(F.col(PURCHASED)).alias("year_quarter")).agg(
        reported(F.sum("price")).alias("total_revenue")
    )


def year_month_matrix(facts: DataFrame) -> DataFrame:
    monthly = _monthly(facts)
    return shares.month_matrix(monthly, "order_year", "order_month", "revenue")


def revenue_by_weekday(facts: DataFrame) -> DataFrame:
    """Monday to Sunday."""
    purchased = F.col(PURCHASED)
    return (
        facts.groupBy(
            dates.weekday_position(purchased).alias("weekday"),
            dates.day_name(purchased).alias("day_of_week"),
        )
        .agg(reported(F.sum("price")).alias("total_revenue"))
        .orderBy("weekday")
    )


def top_by_revenue(kpis: DataFrame, group: str, n: int = 10) -> DataFrame:
    return toplists.top_n(kpis, "total_revenue", n, group)


def payment_share(payments: DataFrame) -> DataFrame:
    by_type = payments.groupBy("payment_type").agg(F.sum("payment_value").alias("paid"))
    return shares.share_of_total(by_type, "paid", "pct_of_total").select(
        "payment_type", reported("paid").alias("payment_value"), "pct_of_total"
    )


def delivery_histogram(facts: DataFrame, width: int = 5) -> DataFrame:
    """Lines per ``width``-day bin of delivery time, with the overall mean."""
    dated = facts.withColumn("delivery_days", delivery_days()).where("delivery_days IS NOT NULL")
    binned = dated.groupBy(bins.bin_start(F.col("delivery_days"), width).alias("bin_start")).agg(
        F.sum("lines").alias("line_count"),
        F.sum(F.col("delivery_days") * F.col("lines")).alias("_days"),
    )
    return shares.ratio_of_totals(binned, "_days", "line_count", "mean_delivery_days").drop("_days")


def revenue_in_period(facts: DataFrame, year: int | None = None, quarter: int | None = None) -> DataFrame:
    chosen = facts.where(dates.in_year_quarter(F.col(PURCHASED), year, quarter))
    return chosen.agg(
        reported(F.sum("price")).alias("total_revenue"),
        F.count("order_id").alias("total_orders"),
    )


def delivery_days() -> Column:
    return dates.days_between(F.col(PURCHASED), F.col(DELIVERED))


def per_line_mean(column: str) -> Column:
    """Mean over lines of a value that all lines of a fact row share; skips NULLs."""
    weight = F.when(F.col(column).isNotNull(), F.col("lines"))
    return ratio(F.sum(F.col(column) * F.col("lines")), F.sum(weight))


def review_per_order(reviews: DataFrame) -> DataFrame:
    """One score per order, the mean of its reviews."""
    return reviews.groupBy("order_id").agg(
        ratio(F.sum("review_score"), F.count("review_score")).alias("review_score")
    )


def _with_order_columns(
    facts: DataFrame, model: StoreModel, columns: tuple[str, ...]
) -> DataFrame:
    """Join the tables that hold one of the requested columns, by order_id.

    Orders that carry their review score spare the join with the reviews.
    """
    from_customers = [c for c in columns if c in ("customer_unique_id", "customer_state")]
    of_orders = {*ORDER_DATES, "review_score"} & set(model.orders.columns)
    from_orders = [c for c in columns if c in of_orders]
    if from_customers or from_orders:
        keys = ["customer_id"] if from_customers else []
        orders = model.orders.select("order_id", *keys, *from_orders)
        if from_customers:
            customers = model.customers.select("customer_id", *from_customers)
            orders = orders.join(customers, "customer_id", "left").drop("customer_id")
        facts = facts.join(orders, "order_id", "left")
    if "review_score" in columns and "review_score" not in from_orders:
        facts = facts.join(review_per_order(model.order_reviews), "order_id", "left")
    return facts


def _monthly(facts: DataFrame) -> DataFrame:
    purchased = F.col(PURCHASED)
    return facts.groupBy(
        F.year(purchased).alias("order_year"), F.month(purchased).alias("order_month")
    ).agg(F.sum("price").alias("revenue"))
