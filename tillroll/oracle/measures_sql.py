def kpis(column: str, top: int | None = None, source: str = "summary") -> str:
    limit = f"ORDER BY total_revenue DESC, {column} LIMIT {top}" if top else ""
    return f"""
SELECT {column}, CAST(SUM(price) AS DOUBLE) AS total_revenue,
       COUNT(DISTINCT order_id) AS total_orders,
       CAST(SUM(price) AS DOUBLE) / COUNT(DISTINCT order_id) AS aov,
       AVG(review_score) AS avg_review_score
FROM {source} GROUP BY {column} {limit}
"""


_MATRIX = ",\n       ".join(
    f"CAST(SUM(revenue) FILTER (order_month = {m}) AS DOUBLE) AS m{m:02d}" for m in range(1, 13)
)

BODIES = {
    "m01_core_kpis": """
SELECT CAST(SUM(price) AS DOUBLE) AS total_revenue, COUNT(DISTINCT order_id) AS total_orders,
       CAST(SUM(price) AS DOUBLE) / COUNT(DISTINCT order_id) AS aov,
       AVG(review_score) AS avg_review_score
FROM summary
""",
    "m01_core_kpis_sliced": """
SELECT CAST(SUM(price) AS DOUBLE) AS total_revenue, COUNT(DISTINCT order_id) AS total_orders,
       CAST(SUM(price) AS DOUBLE) / COUNT(DISTINCT order_id) AS aov,
       AVG(review_score) AS avg_review_score
FROM sliced
""",
    "m04_mom_growth_sliced": """
, months AS (
  SELECT date_trunc('month', order_purchase_timestamp) AS month, SUM(price) AS revenue
  FROM sliced GROUP BY 1
)
SELECT CAST(year(a.month) AS INTEGER) AS order_year, CAST(month(a.month) AS INTEGER) AS order_month,
       CAST(a.revenue AS DOUBLE) AS revenue, CAST(b.revenue AS DOUBLE) AS previous_month_revenue,
       COALESCE(CAST(a.revenue - b.revenue AS DOUBLE) / NULLIF(CAST(b.revenue AS DOUBLE), 0) * 100,
                0) AS mom_growth_pct
FROM months a LEFT JOIN months b ON b.month + INTERVAL 1 MONTH = a.month
""",
    "m12_state_details_sliced": kpis("customer_state", source="sliced"),
    "m17_translated_categories": """
SELECT CASE WHEN category = 'SMALL' THEN category
            ELSE upper(category[1]) || lower(category[2:]) END AS category,
       CAST(SUM(price) AS DOUBLE) AS total_revenue
FROM summary GROUP BY 1
""",
    "m18_located_customers": """
SELECT c_custkey AS customer_id, c_nationkey AS customer_zip_code_prefix, latitude, longitude
FROM customer LEFT JOIN (
  SELECT s_suppkey % 25 AS prefix, AVG(CAST(s_suppkey AS DOUBLE)) AS latitude,
         AVG(CAST(s_suppkey % 7 AS DOUBLE)) AS longitude
  FROM supplier GROUP BY 1
) ON prefix = c_nationkey
""",
    "m02_on_time_pct": """
SELECT COUNT(*) FILTER (order_delivered_customer_date <= order_estimated_delivery_date)
         AS on_time_lines,
       COUNT(*) AS all_lines,
       CAST(COUNT(*) FILTER (order_delivered_customer_date <= order_estimated_delivery_date)
            AS DOUBLE) / COUNT(*) * 100 AS on_time_delivery_pct
FROM summary
""",
    "m03_avg_delivery_days": "SELECT AVG(delivery_days) AS avg_delivery_days FROM delivered",
    "m04_mom_growth": """
SELECT a.order_year, a.order_month, CAST(a.revenue AS DOUBLE) AS revenue,
       CAST(b.revenue AS DOUBLE) AS previous_month_revenue,
       COALESCE(CAST(a.revenue - b.revenue AS DOUBLE) / NULLIF(CAST(b.revenue AS DOUBLE), 0) * 100,
                0) AS mom_growth_pct
FROM monthly a LEFT JOIN monthly b
  ON make_date(a.order_year, a.order_month, 1) - INTERVAL 1 MONTH
     = make_date(b.order_year, b.order_month, 1)
""",
    "m05_ytd_revenue": """
SELECT order_year, order_month, CAST(revenue AS DOUBLE) AS revenue,
       CAST((SELECT SUM(b.revenue) FROM monthly b
             WHERE b.order_year = a.order_year AND b.order_month <= a.order_month) AS DOUBLE)
         AS ytd_revenue
FROM monthly a
""",
    "m06_repeat_rate": """
SELECT COUNT(*) AS total_customers, COUNT(*) FILTER (orders > 1) AS repeat_customers,
       CAST(COUNT(*) FILTER (orders > 1) AS DOUBLE) / COUNT(*) * 100 AS repeat_customer_rate_pct
FROM (SELECT customer_unique_id, COUNT(DISTINCT order_id) AS orders
      FROM summary GROUP BY customer_unique_id)
""",
    "m07_calc_columns": """
SELECT o_orderkey AS order_id,
       CASE WHEN last_arrival >= o_orderdate
            THEN CAST(date_diff('day', CAST(o_orderdate AS DATE), CAST(last_arrival AS DATE))
                      AS INTEGER) END AS delivery_days,
       strftime(o_orderdate, '%Y-%m') AS order_month, dayname(o_orderdate) AS day_of_week
FROM orders LEFT JOIN arrivals ON arrivals.order_id = o_orderkey
""",
    "m08_installment_groups": """
SELECT CASE WHEN payment_installments = 1 THEN '1 (Full)'
            WHEN payment_installments <= 3 THEN '2–3'
            WHEN payment_installments <= 6 THEN '4–6'
            WHEN payment_installments <= 12 THEN '7–12'
            ELSE '13+' END AS installment_group,
       payment_type, COUNT(DISTINCT order_id) AS order_count
FROM payments GROUP BY 1, 2
""",
    "m09_quarterly_revenue": """
SELECT CAST(year(order_purchase_timestamp) AS VARCHAR) || '-Q'
         || CAST(quarter(order_purchase_timestamp) AS VARCHAR) AS year_quarter,
       CAST(SUM(price) AS DOUBLE) AS total_revenue
FROM summary GROUP BY 1
""",
    "m10_year_month_matrix": f"""
SELECT order_year,
       {_MATRIX}
FROM monthly GROUP BY order_year
""",
    "m11_revenue_by_weekday": """
SELECT CAST((dayofweek(order_purchase_timestamp) + 6) % 7 AS INTEGER) AS weekday,
       dayname(order_purchase_timestamp) AS day_of_week,
       CAST(SUM(price) AS DOUBLE) AS total_revenue
FROM summary GROUP BY 1, 2
""",
    "m12_state_details": kpis("customer_state"),
    "m12_top_states": kpis("customer_state", 10),
    "m13_category_details": kpis("category"),
    "m13_top_categories": kpis("category", 10),
    "m14_payment_share": """
SELECT payment_type, CAST(SUM(payment_value) AS DOUBLE) AS payment_value,
       CAST(SUM(payment_value) AS DOUBLE)
         / CAST((SELECT SUM(payment_value) FROM payments) AS DOUBLE) * 100 AS pct_of_total
FROM payments GROUP BY payment_type
""",
    "m15_delivery_histogram": """
SELECT CAST(FLOOR(delivery_days / 5.0) * 5 AS INTEGER) AS bin_start,
       COUNT(*) AS line_count,
       (SELECT AVG(delivery_days) FROM delivered) AS mean_delivery_days
FROM delivered WHERE delivery_days IS NOT NULL GROUP BY 1
""",
    "m16_year_quarter_slice": """
SELECT CAST(SUM(price) AS DOUBLE) AS total_revenue, COUNT(DISTINCT order_id) AS total_orders
FROM summary
WHERE year(order_purchase_timestamp) = 1997 AND quarter(order_purchase_timestamp) = 2
""",
    "m19_running_daily": """
, days AS (
  SELECT CAST(order_purchase_timestamp AS DATE) AS day, SUM(price) AS revenue FROM summary
  WHERE order_purchase_timestamp IS NOT NULL GROUP BY 1
)
SELECT day, CAST(revenue AS DOUBLE) AS revenue,
       CAST(SUM(revenue) OVER (PARTITION BY year(day) ORDER BY day) AS DOUBLE) AS year_to_date,
       CAST(SUM(revenue) OVER (ORDER BY day) AS DOUBLE) AS to_date
FROM days
""",
    "m20_running_orders": """
, sold AS (
  SELECT order_id, order_purchase_timestamp, SUM(price) AS revenue FROM summary
  WHERE order_purchase_timestamp IS NOT NULL GROUP BY 1, 2
)
SELECT order_id, order_purchase_timestamp, CAST(revenue AS DOUBLE) AS revenue,
       CAST(SUM(revenue) OVER (PARTITION BY year(order_purchase_timestamp)
            ORDER BY order_purchase_timestamp, order_id) AS DOUBLE) AS year_to_date,
       CAST(SUM(revenue) OVER (ORDER BY order_purchase_timestamp, order_id) AS DOUBLE) AS to_date
FROM sold
""",
}
# The same rows out of a stored copy.
BODIES["m16_year_quarter_slice_dated"] = BODIES["m16_year_quarter_slice"]
