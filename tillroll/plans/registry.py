"""Every query by name, bound to the star-schema test data."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable
from datetime import date
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillroll.functions.dates import on_days
from tillroll.functions.money import reported
from tillroll.operators import integrity
from tillroll.operators.filters import SalesFilter
from tillroll.operators.keystate import KeyState
from tillroll import schemas
from tillroll.plans import dashboard, distinct, increments, marts, measures, pages, preparation, relations, sales
from tillroll.plans.measures import DELIVERED, ESTIMATED, PURCHASED
from tillroll.model import RetailTables, StoreModel
from tillroll.session import apply_runtime_settings, run_folder, shared_folder, subfolders
from tillroll.sources import catalog, colocated, files
from tillroll.sources.dated import DatedStore, DatedTables, facts_of
from tillroll.sources.lookup import write_clustered
from tillroll.sources.warehouse import PreparedTables, WarehouseStore, WarehouseTables

Query = Callable[[SparkSession, str], DataFrame]

# Parameters of the registered runs. The library defaults are the published ones.
LOW_STOCK = 10
LOADED_COLUMNS = (
    "order_item_id order_id product_id quantity unit_price customer_id order_date payment_method"
    " order_status total_amount order_year order_month customer_name city state product_name"
    " category brand cost_price stock_quantity profit"
).split()
HIGH_VALUE = 2_000_000
CUSTOMER = 1
SLICE_YEAR, SLICE_QUARTER = 1997, 2
TWO_YEARS = SalesFilter(start=date(1997, 1, 1), end=date(1998, 12, 31))
QUARTER = SalesFilter(start=date(1997, 4, 1), end=date(1997, 6, 30))
SLICE = SalesFilter(
    start=date(1997, 1, 1),
    end=date(1998, 12, 31),
    categories=("ECONOMY", "SMALL", "LARGE"),
    states=("NATION_1", "NATION_4", "NATION_9"),
)
UNSOLD = SalesFilter(start=date(1997, 4, 1), end=date(1997, 5, 15))
NARROW = SalesFilter(
    start=date(1997, 1, 1),
    end=date(1998, 12, 31),
    categories=("ECONOMY", "SMALL", "LARGE"),
    states=("ASIA", "EUROPE"),
)


def _sales(plan: Callable[..., DataFrame], **params) -> Query:
    return lambda spark, folder: plan(_retail(spark, folder), **params)


def _dashboard(plan: Callable[..., DataFrame], *args, **params) -> Query:
    return lambda spark, folder: plan(_prepared(spark, folder), *args, **params)


def _measure(
    measure: Callable[..., DataFrame],
    *columns: str,
    by: tuple[str, ...] = (),
    chosen: SalesFilter = SalesFilter(),
    **params,
) -> Query:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        facts = _store(spark, folder).sliced(chosen).order_facts(*columns)
        return measure(facts, *by, **params)

    return run


def _retail(spark: SparkSession, folder: str) -> WarehouseTables:
    return WarehouseTables(apply_runtime_settings(spark), folder)


def _prepared(spark: SparkSession, folder: str) -> PreparedTables:
    return PreparedTables(apply_runtime_settings(spark), folder)


def _store(spark: SparkSession, folder: str) -> WarehouseStore:
    return WarehouseStore(apply_runtime_settings(spark), folder)


def _doubles(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: reported(c) for c in columns})


def _clean_customers(spark: SparkSession, folder: str) -> DataFrame:
    return preparation.clean_customers(_retail(spark, folder).uncleaned_customers)


def _clean_orders(spark: SparkSession, folder: str) -> DataFrame:
    orders = preparation.clean_orders(_retail(spark, folder).uncleaned_orders)
    return _doubles(orders, "total_amount")


def _item_profit(spark: SparkSession, folder: str) -> DataFrame:
    t = _retail(spark, folder)
    items = preparation.with_profit(t.order_items, t.products)
    return _doubles(items, "unit_price", "cost_price", "profit")


def _order_totals(spark: SparkSession, folder: str) -> DataFrame:
    t = _retail(spark, folder)
    totals = preparation.order_totals(t.orders, t.order_items)
    return _doubles(totals.select("order_id", "total_amount"), "total_amount")


def _sales_master(spark: SparkSession, folder: str) -> DataFrame:
    return _line_report(preparation.sales_master(_prepared(spark, folder)))


def _filtered_sales(spark: SparkSession, folder: str) -> DataFrame:
    return _line_report(dashboard.filtered_sales(_prepared(spark, folder), NARROW))


def _line_report(lines: DataFrame) -> DataFrame:
    return _doubles(lines, "unit_price", "cost_price", "profit", "total_amount")


def _csv_roundtrip(spark: SparkSession, folder: str) -> DataFrame:
    """Export the daily sales as CSV and read them back under a declared schema."""
    report = dashboard.daily_sales(_prepared(spark, folder))
    path = run_folder(spark, "daily-sales-csv")
    files.export_csv(report, path)
    return files.read_csv(spark, path, report.schema)


def _table_replace(spark: SparkSession, folder: str) -> DataFrame:
    """Replace a stored table by the older orders, append the newer, read all."""
    orders = preparation.clean_orders(_retail(spark, folder).uncleaned_orders)
    older = on_days(F.col("order_date"), date(1900, 1, 1), date(1997, 12, 31))
    path = run_folder(spark, "orders-table")
    files.replace_table(orders, path)
    files.replace_table(orders.where(older), path)
    files.append_rows(orders.where(~older), path)
    return _doubles(spark.read.schema(orders.schema).parquet(path), "total_amount")


def _customer_orders(spark: SparkSession, folder: str) -> DataFrame:
    found = sales.customer_orders(_retail(spark, folder), CUSTOMER)
    return _doubles(found, "total_amount")


def _customer_acquisition(spark: SparkSession, folder: str) -> DataFrame:
    return dashboard.customer_acquisition(_retail(spark, folder).registered_customers)


def _part_kpis(spark: SparkSession, folder: str) -> DataFrame:
    facts = measures.part_facts(_store(spark, folder), "category", "review_score")
    return measures.core_kpis(facts, "category")


_state_kpis = _measure(
    measures.core_kpis, "customer_state", "review_score", by=("customer_state",)
)


def _products_unsold(spark: SparkSession, folder: str) -> DataFrame:
    return sales.products_never_sold(_retail(spark, folder), UNSOLD)


def _csv_load(spark: SparkSession, folder: str) -> DataFrame:
    """The load job end to end: CSV extracts in, cleaned tables out, read back as lines."""
    t = _retail(spark, folder)
    extracts = run_folder(spark, "csv-extracts")
    raw = {
        "customers": t.uncleaned_customers,
        "products": t.products,
        "orders": t.uncleaned_orders,
        "order_items": t.order_items,
    }
    for name, rows in raw.items():
        wanted = [c for c in schemas.TABLES[name].names]
        gaps = {c: F.lit(None).cast("string") for c in wanted if c not in rows.columns}
        files.export_csv(rows.withColumns(gaps).select(*wanted), f"{extracts}/{name}.csv")
    tables = run_folder(spark, "loaded-tables")
    preparation.prepare_folder(spark, extracts, tables)
    lines = preparation.sales_master(files.read_tables(spark, tables))
    numbers = {c: F.col(c).cast("long") for c in ("order_item_id", "order_id", "product_id", "customer_id")}
    return _line_report(lines.withColumns(numbers).select(*LOADED_COLUMNS))


def _stock_export(spark: SparkSession, folder: str) -> DataFrame:
    """The low-stock report with all product columns, exported as CSV and read back."""
    report = dashboard.low_stock_products(_retail(spark, folder), LOW_STOCK)
    path = run_folder(spark, "low-stock-csv")
    files.export_csv(report, path)
    return _doubles(files.read_csv(spark, path, report.schema), "cost_price")


def _catalog_tables(spark: SparkSession, folder: str) -> DataFrame:
    """Typed catalog tables created twice, filled by inserts, read through an imported view."""
    t = _retail(spark, folder)
    database = f"shop_{uuid.uuid4().hex[:12]}"
    spark.sql(f"CREATE DATABASE {database} LOCATION '{run_folder(spark, database)}'")
    for _ in range(2):  # the second call finds the tables there
        catalog.create_tables(spark, database)
    for name, rows in (("products", t.products), ("orders", t.uncleaned_orders)):
        columns = {
            f.name: (F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType)
            for f in schemas.TABLES[name]
        }
        catalog.insert_rows(rows.select(*[c.alias(n) for n, c in columns.items()]), f"{database}.{name}")
    tables = catalog.catalog_tables(spark, database)
    catalog.replace_view(tables.orders, "catalog_orders")
    catalog.replace_view(tables.products, "catalog_products")
    views = catalog.import_views(spark, ["catalog_orders", "catalog_products"])
    counted = [
        views["catalog_orders"].agg(
            F.lit("orders").alias("table_name"),
            F.count(F.lit(1)).alias("row_count"),
            reported(F.sum("total_amount")).alias("amount"),
        ),
        views["catalog_products"].agg(
            F.lit("products").alias("table_name"),
            F.count(F.lit(1)).alias("row_count"),
            reported(F.sum("cost_price")).alias("amount"),
        ),
    ]
    return counted[0].unionByName(counted[1])


def _translated_categories(spark: SparkSession, folder: str) -> DataFrame:
    """Revenue per English category; some names have no translation."""
    model = _store(spark, folder)
    products = model.products.withColumnRenamed("category", "product_category_name")
    names = products.select("product_category_name").distinct()
    translation = names.where("product_category_name <> 'SMALL'").withColumn(
        "product_category_name_english", F.initcap(F.lower("product_category_name"))
    )
    per_product = model.order_items.groupBy("product_id").agg(F.sum("price").alias("price"))
    named = relations.with_english_category(products, translation)
    return (
        per_product.join(named, "product_id", "left")
        .groupBy("category")
        .agg(reported(F.sum("price")).alias("total_revenue"))
    )


def _located_customers(spark: SparkSession, folder: str) -> DataFrame:
    """Customers with the mean of the points measured for their postcode prefix."""
    t = _retail(spark, folder)
    customers = t.scan("customer").selectExpr(
        "c_custkey AS customer_id", "c_nationkey AS customer_zip_code_prefix"
    )
    points = t.scan("supplier").selectExpr(
        "CAST(s_suppkey % 25 AS INT) AS geolocation_zip_code_prefix",
        "CAST(s_suppkey AS DOUBLE) AS geolocation_lat",
        "CAST(s_suppkey % 7 AS DOUBLE) AS geolocation_lng",
    )
    return relations.with_location(customers, points, "customer_zip_code_prefix")


def _calculated_columns(spark: SparkSession, folder: str) -> DataFrame:
    return measures.calculated_columns(_store(spark, folder).orders)


def _payments(plan: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, folder: plan(_store(spark, folder).order_payments)


def _sales_summary(spark: SparkSession, folder: str) -> DataFrame:
    return _doubles(marts.sales_summary(_store(spark, folder)), "price", "payment_value")


def _seller_performance(spark: SparkSession, folder: str) -> DataFrame:
    model = _store(spark, folder)
    facts = measures.part_facts(model, "seller_id", "review_score", PURCHASED, DELIVERED)
    return marts.seller_performance(facts, model.sellers)


def _segment_counts(spark: SparkSession, folder: str) -> DataFrame:
    facts = _store(spark, folder).order_facts("customer_unique_id", PURCHASED)
    return marts.segment_counts(marts.customer_segments(facts))


def _refresh_marts(spark: SparkSession, folder: str) -> DataFrame:
    return marts.refresh(_store(spark, folder), run_folder(spark, "marts"))


def _stored_copy(spark: SparkSession, folder: str, purpose: str, last: str, write: Callable[[str], None]) -> str:
    """The path of a stored copy of the tables of ``folder``, made by the first query of the application that reads it.

    ``last`` is the part of the copy that ``write`` makes last; without it the copy is made again.
    """
    name = hashlib.sha256(f"{spark.sparkContext.applicationId} {folder}".encode()).hexdigest()[:16]
    path = f"{shared_folder(spark).rstrip('/')}/{purpose}-{name}"
    if last not in subfolders(spark, path):
        write(path)
    return path


def _dated(spark: SparkSession, folder: str) -> DatedTables:
    """Orders and lines stored by month."""
    tables = _prepared(spark, folder)
    path = _stored_copy(spark, folder, "dated", "calendar", lambda path: DatedTables(tables, path).store())
    return DatedTables(tables, path)


def _dated_page(plan: Callable[..., DataFrame], chosen: SalesFilter) -> Query:
    return lambda spark, folder: plan(_dated(spark, folder).within(chosen), chosen)


def _dated_sales(spark: SparkSession, folder: str) -> DataFrame:
    return _line_report(dashboard.filtered_sales(_dated(spark, folder).within(NARROW), NARROW))


def _dated_slice(spark: SparkSession, folder: str) -> DataFrame:
    """The year and quarter slice of the report, over lines stored by month."""
    tables = _dated(spark, folder).within(QUARTER)
    orders = tables.orders.select("order_id", F.col("order_date").alias(PURCHASED))
    lines = tables.order_items.join(orders, "order_id").groupBy("order_id", PURCHASED)
    facts = lines.agg(F.sum("unit_price").alias("price"), F.count(F.lit(1)).alias("lines"))
    return measures.revenue_in_period(facts, year=SLICE_YEAR, quarter=SLICE_QUARTER)


def _bitmaps(spark: SparkSession, folder: str) -> DataFrame:
    """The stored bitmaps of distinct orders and customers."""
    tables = _retail(spark, folder)

    def write(path: str) -> None:
        files.replace_table(distinct.bitmap_rows(tables), f"{path}/bitmaps")

    path = _stored_copy(spark, folder, "distinct", "bitmaps", write)
    return spark.read.parquet(f"{path}/bitmaps")


def _distinct(*by: str, chosen: str | None = None) -> Query:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        wanted = None if chosen is None else F.expr(chosen)
        return distinct.distinct_counts(_bitmaps(spark, folder), *by, chosen=wanted)

    return run


UNION = "category IN ('ECONOMY', 'SMALL') AND state <> 'ASIA' AND month BETWEEN '1996-11' AND '1998-02'"


# So that both parts of a bucketed copy hold orders.
BUCKETS, HOT_LINES = 8, 8


def _bucketed(spark: SparkSession, folder: str, facts: dict[str, DataFrame], model: str) -> str:
    """A database of facts bucketed by order, made by the first query that reads it."""
    database = f"{model}_{hashlib.sha256(folder.encode()).hexdigest()[:16]}"
    last = list(facts)[-1]
    if not spark.catalog.tableExists(f"{database}.{last}{colocated.HOT}"):
        colocated.write_facts(facts, database, BUCKETS, HOT_LINES)
    return database


def _retail_parts(spark: SparkSession, folder: str) -> list[RetailTables]:
    tables = _prepared(spark, folder)
    facts = {"orders": tables.orders, "order_items": tables.order_items}
    return colocated.retail_parts(tables, _bucketed(spark, folder, facts, "bucketed_retail"))


def _store_parts(spark: SparkSession, folder: str) -> list[StoreModel]:
    store = _store(spark, folder)
    model = StoreModel(**facts_of(store), customers=store.customers, products=store.products, sellers=store.sellers)
    return colocated.store_parts(model, _bucketed(spark, folder, facts_of(store), "bucketed_store"))


def _master_of_parts(spark: SparkSession, folder: str) -> DataFrame:
    parts = [preparation.sales_master(part) for part in _retail_parts(spark, folder)]
    return _line_report(reduce(DataFrame.unionByName, parts))


def _kpis_of_parts(spark: SparkSession, folder: str) -> DataFrame:
    return dashboard.home_kpis_of_parts(_retail_parts(spark, folder), NARROW)


def _summary_of_parts(spark: SparkSession, folder: str) -> DataFrame:
    parts = [marts.sales_summary(part) for part in _store_parts(spark, folder)]
    return _doubles(reduce(DataFrame.unionByName, parts), "price", "payment_value")


def _csv_rejects(spark: SparkSession, folder: str) -> DataFrame:
    """The lines as a CSV extract in which some amounts are no numbers: what is loaded and what is rejected."""
    lines = _retail(spark, folder).order_items
    number = F.col("order_item_id") % 1000
    broken = lines.select(
        "order_item_id",
        "order_id",
        "product_id",
        F.when(number == 1, "many").otherwise(F.col("quantity").cast("string")).alias("quantity"),
        F.when(number == 2, "n/a").otherwise(F.col("unit_price").cast("string")).alias("unit_price"),
    )
    extract = run_folder(spark, "broken-lines")
    files.export_csv(broken, extract)
    rejects = run_folder(spark, "rejects")
    loaded = files.load_csv(spark, extract, schemas.ORDER_ITEMS, rejects)
    reasons = spark.read.parquet(rejects).groupBy(F.col("reason").alias("outcome"))
    count = F.count(F.lit(1)).alias("line_count")
    loaded = loaded.agg(F.lit("loaded").alias("outcome"), count, F.sum("quantity").alias("units"))
    return loaded.unionByName(reasons.agg(count, F.lit(None).cast("long").alias("units")))


# What changes between the two refreshes of k06: a third of a month arrives late, a fifth of another is deleted.
LATE = "year(order_purchase_timestamp) = 1998 AND month(order_purchase_timestamp) = 3 AND order_id % 3 = 0"
DELETED = "year(order_purchase_timestamp) = 1999 AND month(order_purchase_timestamp) = 5 AND order_id % 5 = 0"
# The revenue and order columns of each mart.
MART_SUMS = {
    "v_sales_summary": ("price", None),
    "v_monthly_sales": ("total_revenue", "order_count"),
    "v_category_performance": ("total_revenue", "total_orders"),
    "v_customer_segments": ("monetary", "frequency"),
    "v_seller_performance": ("total_revenue", "total_orders"),
    "v_regional_sales": ("total_revenue", "total_orders"),
    "v_payment_analysis": ("total_value", "order_count"),
}


def _key_state(spark: SparkSession, folder: str) -> KeyState:
    """The keys of the tables after a second batch; some customers never come, some products come twice."""
    tables = _retail(spark, folder).named()
    lines, products = tables["order_items"], tables["products"]

    def write(path: str) -> None:
        state = KeyState(spark, f"{path}/keys", KEY_BUCKETS)
        known = tables["customers"].where("customer_id % 10 <> 0")
        state.append(tables | {"customers": known, "order_items": lines.where("order_item_id % 10 <> 3")})
        state.append({"products": products.where("product_id % 100 = 7"), "order_items": lines.where("order_item_id % 10 = 3")})
        files.replace_table(spark.range(1), f"{path}/done")

    path = _stored_copy(spark, folder, "keys", "done", write)
    return KeyState(spark, f"{path}/keys", KEY_BUCKETS)


KEY_BUCKETS = 16


def _clustered_orders(spark: SparkSession, folder: str) -> DataFrame:
    """The orders of one customer, out of a copy that is clustered by customer."""
    tables = _retail(spark, folder)

    def write(path: str) -> None:
        write_clustered(tables.orders, f"{path}/orders", "customer_id", "order_id", LOOKUP_FILES)

    path = _stored_copy(spark, folder, "lookup", "orders", write)
    orders = spark.read.schema(tables.orders.schema).parquet(f"{path}/orders")
    found = sales.customer_orders(RetailTables(None, None, orders, None), CUSTOMER)
    return _doubles(found, "total_amount")


LOOKUP_FILES = 16


def _refresh_months(spark: SparkSession, folder: str) -> DataFrame:
    """All marts without the late orders, then the months brought up to date that late and deleted orders changed."""
    model = _store(spark, folder)
    late, deleted = model.orders.where(LATE), model.orders.where(DELETED)
    store = DatedStore(model, run_folder(spark, "dated-facts"))
    facts = facts_of(model)
    store.write({name: rows.join(late.select("order_id"), "order_id", "left_anti") for name, rows in facts.items()})
    target = run_folder(spark, "dated-marts")
    increments.refresh_months(store, target)
    store.append({name: rows.join(late.select("order_id"), "order_id", "left_semi") for name, rows in facts.items()})
    store.remove(deleted, increments.changed_months(deleted))
    increments.refresh_months(store, target, increments.changed_months(late, deleted))
    sums = []
    for mart, (revenue, orders) in MART_SUMS.items():
        amount = reported(F.sum(F.col(revenue).cast("decimal(18,2)")))
        number = F.sum(orders) if orders else F.count_distinct("order_id")
        rows = spark.table(mart).agg(F.count(F.lit(1)).alias("row_count"), amount.alias("revenue"), number.alias("orders"))
        sums.append(rows.select(F.lit(mart).alias("mart"), "*"))
    return reduce(DataFrame.unionByName, sums)


def _primary_keys(spark: SparkSession, folder: str) -> DataFrame:
    return integrity.check_primary_keys(_retail(spark, folder).named())


def _foreign_keys(spark: SparkSession, folder: str) -> DataFrame:
    return integrity.check_foreign_keys(_retail(spark, folder).named())


SALES: dict[str, Query] = {
    "q01_total_revenue": _sales(sales.total_revenue),
    "q02_monthly_revenue": _sales(sales.monthly_revenue),
    "q03_yearly_revenue": _sales(sales.yearly_revenue),
    "q04_top_days": _sales(sales.top_days),
    "q05_average_order_value": _sales(sales.average_order_value),
    "q06_top_customers": _sales(sales.top_customers),
    "q07_top_products": _sales(sales.top_products),
    "q08_top_categories": _sales(sales.top_categories),
    "q09_revenue_by_city": _sales(sales.revenue_by_city),
    "q10_revenue_by_state": _sales(sales.revenue_by_state),
    "q11_revenue_by_brand": _sales(sales.revenue_by_brand),
    "q12_repeat_customer_pct": _sales(sales.repeat_customer_percentage),
    "q13_cancelled_orders": _sales(sales.cancelled_orders),
    "q14_pending_orders": _sales(sales.pending_orders),
    "q15_payment_methods": _sales(sales.payment_methods),
    "q16_profit_margin": _sales(sales.profit_margin),
    "q17_low_stock": _sales(sales.low_stock, threshold=LOW_STOCK),
    "q18_monthly_growth": _sales(sales.monthly_growth),
    "q19_customer_rank_by_state": _sales(sales.customer_rank_by_state),
    "q20_biggest_order_customer": _sales(sales.biggest_order_customer),
    "q21_products_never_sold": _sales(sales.products_never_sold),
    "q21_products_unsold_in_period": _products_unsold,
    "q22_orders_above_city_avg": _sales(sales.orders_above_city_average),
    "q23_high_value_customers": _sales(sales.high_value_customers, above=HIGH_VALUE),
    "q24_customer_orders": _customer_orders,
    "q24_customer_orders_clustered": _clustered_orders,
    "q25_row_counts": _sales(sales.row_counts),
}

PREPARATION: dict[str, Query] = {
    "p01_clean_customers": _clean_customers,
    "p02_clean_orders": _clean_orders,
    "p03_item_profit": _item_profit,
    "p04_order_totals": _order_totals,
    "p05_sales_master": _sales_master,
    "p06_csv_roundtrip": _csv_roundtrip,
    "p07_table_replace": _table_replace,
    "p08_csv_load": _csv_load,
    "p05_sales_master_bucketed": _master_of_parts,
    "p09_low_stock_export": _stock_export,
    "p10_csv_rejects": _csv_rejects,
}

DASHBOARD: dict[str, Query] = {
    "d01_filtered_sales": _filtered_sales,
    "d02_filter_options": _dashboard(dashboard.filter_options, TWO_YEARS),
    "d03_home_kpis": _dashboard(dashboard.home_kpis, NARROW),
    "d04_revenue_by_category": _dashboard(dashboard.revenue_by_category, TWO_YEARS),
    "d05_order_status_counts": _dashboard(dashboard.order_status_counts, NARROW),
    "d06_daily_sales": _dashboard(dashboard.daily_sales, NARROW),
    "d07_monthly_sales": _dashboard(dashboard.monthly_sales),
    "d08_revenue_by_payment": _dashboard(dashboard.revenue_by_payment_method),
    "d09_top_product_names": _dashboard(dashboard.top_product_names),
    "d10_top_brands": _dashboard(dashboard.top_brands, NARROW),
    "d11_items_by_category": _dashboard(dashboard.items_by_category, TWO_YEARS),
    "d12_customer_acquisition": _customer_acquisition,
    "d13_top_customer_names": _dashboard(dashboard.top_customer_names),
    "d14_top_states": _dashboard(dashboard.top_states, TWO_YEARS),
    "d15_profit_margin": _dashboard(dashboard.profit_margin, NARROW),
    "d16_profit_by_category": _dashboard(dashboard.profit_by_category),
    "d17_daily_profit": _dashboard(dashboard.daily_profit, TWO_YEARS),
    "d02_filter_options_all": _dashboard(dashboard.filter_options),
    "d03_home_kpis_all": _dashboard(dashboard.home_kpis),
    "d04_revenue_by_category_all": _dashboard(dashboard.revenue_by_category),
    "d05_order_status_counts_all": _dashboard(dashboard.order_status_counts),
    "d10_top_brands_all": _dashboard(dashboard.top_brands),
    "d11_items_by_category_all": _dashboard(dashboard.items_by_category),
    "d14_top_states_all": _dashboard(dashboard.top_states),
    "d15_profit_margin_all": _dashboard(dashboard.profit_margin),
    "d17_daily_profit_all": _dashboard(dashboard.daily_profit),
    "d18_low_stock_report": _dashboard(dashboard.low_stock_report, threshold=LOW_STOCK),
    "d18_low_stock_count": _dashboard(dashboard.low_stock_count, threshold=LOW_STOCK),
    "d01_filtered_sales_dated": _dated_sales,
    "d03_home_kpis_bucketed": _kpis_of_parts,
    "d19_page": _dashboard(pages.page, NARROW),
    "d19_page_all": _dashboard(pages.page),
    "b01_distinct_by_category": _distinct("category"),
    "b02_distinct_by_state": _distinct("state"),
    "b03_distinct_by_month": _distinct("month"),
    "b04_distinct_of_a_union": _distinct(chosen=UNION),
    "d06_daily_sales_dated": _dated_page(dashboard.daily_sales, NARROW),
    "d18_lowest_stock": _dashboard(dashboard.lowest_stock, threshold=LOW_STOCK),
}

MEASURES: dict[str, Query] = {
    "m01_core_kpis": _measure(measures.core_kpis, "review_score"),
    "m02_on_time_pct": _measure(measures.on_time_percent, DELIVERED, ESTIMATED),
    "m03_avg_delivery_days": _measure(measures.avg_delivery_days, PURCHASED, DELIVERED),
    "m04_mom_growth": _measure(measures.mom_growth, PURCHASED),
    "m05_ytd_revenue": _measure(measures.ytd_revenue, PURCHASED),
    "m06_repeat_rate": _measure(measures.repeat_rate, "customer_unique_id"),
    "m07_calc_columns": _calculated_columns,
    "m08_installment_groups": _payments(measures.installment_groups),
    "m09_quarterly_revenue": _measure(measures.quarterly_revenue, PURCHASED),
    "m10_year_month_matrix": _measure(measures.year_month_matrix, PURCHASED),
    "m11_revenue_by_weekday": _measure(measures.revenue_by_weekday, PURCHASED),
    "m12_state_details": _state_kpis,
    "m12_top_states": lambda spark, folder: measures.top_by_revenue(
        _state_kpis(spark, folder), "customer_state"
    ),
    "m13_category_details": _part_kpis,
    "m13_top_categories": lambda spark, folder: measures.top_by_revenue(
        _part_kpis(spark, folder), "category"
    ),
    "m14_payment_share": _payments(measures.payment_share),
    "m15_delivery_histogram": _measure(measures.delivery_histogram, PURCHASED, DELIVERED),
    "m16_year_quarter_slice": _measure(
        measures.revenue_in_period, PURCHASED, chosen=QUARTER, year=SLICE_YEAR, quarter=SLICE_QUARTER
    ),
    "m16_year_quarter_slice_dated": _dated_slice,
    "m01_core_kpis_sliced": _measure(measures.core_kpis, "review_score", chosen=SLICE),
    "m04_mom_growth_sliced": _measure(measures.mom_growth, PURCHASED, chosen=SLICE),
    "m12_state_details_sliced": _measure(
        measures.core_kpis, "customer_state", "review_score", by=("customer_state",), chosen=SLICE
    ),
    "m19_running_daily": _measure(measures.running_daily, PURCHASED),
    "m20_running_orders": _measure(measures.running_orders, PURCHASED),
    "m17_translated_categories": _translated_categories,
    "m18_located_customers": _located_customers,
}

MARTS: dict[str, Query] = {
    "v_sales_summary": _sales_summary,
    "k07_sales_summary_bucketed": _summary_of_parts,
    "v_monthly_sales": _measure(marts.monthly_sales, PURCHASED),
    "v_category_performance": _part_kpis,
    "v_customer_segments": _measure(marts.customer_segments, "customer_unique_id", PURCHASED),
    "v_customer_segment_counts": _segment_counts,
    "v_seller_performance": _seller_performance,
    "v_regional_sales": _measure(
        marts.regional_sales, "customer_state", "customer_unique_id", "review_score"
    ),
    "v_payment_analysis": _payments(marts.payment_analysis),
    "k04_refresh_marts": _refresh_marts,
    "k05_catalog_tables": _catalog_tables,
    "k06_refresh_months": _refresh_months,
}

CHECKS: dict[str, Query] = {
    "c01_pk_violations": _primary_keys,
    "c02_fk_violations": _foreign_keys,
    "c03_appended_primary_keys": lambda spark, folder: _key_state(spark, folder).primary_keys(),
    "c04_appended_foreign_keys": lambda spark, folder: _key_state(spark, folder).foreign_keys(),
}

QUERIES: dict[str, Query] = SALES | PREPARATION | DASHBOARD | MEASURES | MARTS | CHECKS
