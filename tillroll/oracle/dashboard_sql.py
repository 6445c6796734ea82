from tillroll.oracle.preparation_sql import LINE_COLUMNS


def _revenue_by(column: str, source: str, top: int | None = None) -> str:
    limit = f"ORDER BY revenue DESC, {column} LIMIT {top}" if top else ""
    return f"""
SELECT {column}, CAST(SUM(amount) AS DOUBLE) AS revenue
FROM {source} WHERE {column} IS NOT NULL GROUP BY {column} {limit}
"""


BODIES = {
    "d01_filtered_sales": f"SELECT {LINE_COLUMNS} FROM narrow",
    "d02_filter_options": """
SELECT DISTINCT 'category' AS option_kind, category AS option_value FROM two_years
UNION ALL SELECT DISTINCT 'state', state FROM two_years
UNION ALL SELECT 'first_day', CAST(CAST(MIN(order_date) AS DATE) AS VARCHAR) FROM master
UNION ALL SELECT 'last_day', CAST(CAST(MAX(order_date) AS DATE) AS VARCHAR) FROM master
""",
    "d03_home_kpis": """
SELECT CAST(COALESCE(SUM(amount), 0) AS DOUBLE) AS total_revenue,
       CAST(COALESCE(SUM(profit), 0) AS DOUBLE) AS total_profit,
       COUNT(DISTINCT order_id) AS total_orders, COUNT(DISTINCT customer_id) AS total_customers
FROM narrow
""",
    "d04_revenue_by_category": _revenue_by("category", "two_years"),
    "d05_order_status_counts": """
SELECT order_status, COUNT(DISTINCT order_id) AS "count" FROM narrow GROUP BY order_status
""",
    "d06_daily_sales": """
SELECT CAST(order_date AS DATE) AS "Date", CAST(SUM(amount) AS DOUBLE) AS "Revenue"
FROM narrow GROUP BY 1
""",
    "d07_monthly_sales": """
SELECT order_year, order_month, CAST(SUM(amount) AS DOUBLE) AS revenue,
       CAST(order_year AS VARCHAR) || '-' || CAST(order_month AS VARCHAR) AS month_year
FROM master GROUP BY order_year, order_month
""",
    "d08_revenue_by_payment": _revenue_by("payment_method", "master"),
    "d09_top_product_names": _revenue_by("product_name", "master", 10),
    "d10_top_brands": _revenue_by("brand", "narrow", 10),
    "d11_items_by_category": """
SELECT category, CAST(SUM(quantity) AS BIGINT) AS quantity FROM two_years GROUP BY category
""",
    "d12_customer_acquisition": """
SELECT strftime(registration_date, '%Y-%m') AS registration_date, COUNT(*) AS new_customers
FROM registered WHERE registration_date IS NOT NULL GROUP BY 1
""",
    "d13_top_customer_names": _revenue_by("customer_name", "master", 10),
    "d14_top_states": _revenue_by("state", "two_years", 10),
    "d15_profit_margin": """
SELECT CAST(COALESCE(SUM(amount), 0) AS DOUBLE) AS total_revenue,
       CAST(COALESCE(SUM(profit), 0) AS DOUBLE) AS total_profit,
       CASE WHEN SUM(amount) > 0 THEN CAST(SUM(profit) AS DOUBLE) / CAST(SUM(amount) AS DOUBLE) * 100
            ELSE 0 END AS margin_percentage
FROM narrow
""",
    "d16_profit_by_category": """
SELECT category, CAST(SUM(profit) AS DOUBLE) AS profit FROM master GROUP BY category
""",
    "d17_daily_profit": """
SELECT CAST(order_date AS DATE) AS "Date", CAST(SUM(profit) AS DOUBLE) AS "Profit"
FROM two_years GROUP BY 1
""",
    "d18_low_stock_report": """
SELECT product_name, category, brand, stock_quantity FROM products WHERE stock_quantity < 10
""",
    "d18_low_stock_count": """
SELECT COUNT(*) AS low_stock_products FROM products WHERE stock_quantity < 10
""",
    "d18_lowest_stock": """
SELECT product_name, stock_quantity FROM products WHERE stock_quantity < 10
ORDER BY stock_quantity, product_id LIMIT 20
""",
}

# The same pages without a filter.
for _key in (
    "d02_filter_options",
    "d03_home_kpis",
    "d04_revenue_by_category",
    "d05_order_status_counts",
    "d10_top_brands",
    "d11_items_by_category",
    "d14_top_states",
    "d15_profit_margin",
    "d17_daily_profit",
):
    BODIES[f"{_key}_all"] = BODIES[_key].replace("narrow", "master").replace("two_years", "master")

for _key in ("d01_filtered_sales", "d06_daily_sales"):
    BODIES[f"{_key}_dated"] = BODIES[_key]
BODIES["d03_home_kpis_bucketed"] = BODIES["d03_home_kpis"]

# Section of the page, its statement, label, measures.
_SECTIONS = (
    ("home_kpis", "d03_home_kpis", "NULL", ("total_revenue", "total_profit", "total_orders", "total_customers")),
    ("revenue_by_category", "d04_revenue_by_category", "category", ("revenue",)),
    ("order_status_counts", "d05_order_status_counts", "order_status", ("count",)),
    ("daily_sales", "d06_daily_sales", '"Date"', ("Revenue",)),
    ("monthly_sales", "d07_monthly_sales", "month_year", ("revenue",)),
    ("revenue_by_payment_method", "d08_revenue_by_payment", "payment_method", ("revenue",)),
    ("top_product_names", "d09_top_product_names", "product_name", ("revenue",)),
    ("top_brands", "d10_top_brands", "brand", ("revenue",)),
    ("items_by_category", "d11_items_by_category", "category", ("quantity",)),
    ("top_states", "d14_top_states", "state", ("revenue",)),
    ("profit_margin", "d15_profit_margin", "NULL", ("total_revenue", "total_profit", "margin_percentage")),
    ("profit_by_category", "d16_profit_by_category", "category", ("profit",)),
)


def _page(source: str) -> str:
    parts = []
    for section, key, label, measures in _SECTIONS:
        body = BODIES[key]
        for other in ("narrow", "two_years", "master"):
            body = body.replace(f"FROM {other}", f"FROM {source}")
        parts += [
            f"SELECT '{section}' AS section, CAST({label} AS VARCHAR) AS label, '{measure}' AS measure, "
            f'CAST("{measure}" AS DOUBLE) AS amount FROM ({body})'
            for measure in measures
        ]
    return "\nUNION ALL ".join(parts)


BODIES["d19_page"] = _page("narrow")
BODIES["d19_page_all"] = _page("master")


def _distinct(columns: str = "", where: str = "TRUE") -> str:
    return f"""
SELECT {columns + ',' if columns else ''} COUNT(DISTINCT order_id) AS distinct_orders,
       COUNT(DISTINCT customer_id) AS distinct_customers
FROM (SELECT *, strftime(order_date, '%Y-%m') AS month FROM master) WHERE {where}
{'GROUP BY ' + columns if columns else ''}
"""


BODIES["b01_distinct_by_category"] = _distinct("category")
BODIES["b02_distinct_by_state"] = _distinct("state")
BODIES["b03_distinct_by_month"] = _distinct("month")
BODIES["b04_distinct_of_a_union"] = _distinct(
    where="category IN ('ECONOMY', 'SMALL') AND state <> 'ASIA' AND month BETWEEN '1996-11' AND '1998-02'"
)
