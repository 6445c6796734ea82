from tillroll.oracle.measures_sql import kpis

BODIES = {
    "v_sales_summary": """
SELECT order_id, customer_unique_id, customer_state, product_id, category, seller_id, seller_name,
       order_purchase_timestamp, order_delivered_customer_date, order_estimated_delivery_date,
       delivery_days, CAST(price AS DOUBLE) AS price, payment_type, payment_installments,
       CAST(payment_value AS DOUBLE) AS payment_value, review_score
FROM delivered
""",
    "v_monthly_sales": """
SELECT strftime(order_purchase_timestamp, '%Y-%m') AS month,
       CAST(SUM(price) AS DOUBLE) AS total_revenue, COUNT(DISTINCT order_id) AS order_count,
       CAST(SUM(price) AS DOUBLE) / COUNT(DISTINCT order_id) AS aov
FROM summary GROUP BY 1
""",
    "v_category_performance": kpis("category"),
    "v_customer_segments": """
SELECT customer_unique_id, recency_days, frequency, monetary, r_score, f_score, m_score,
       rfm_segment
FROM segments
""",
    "v_customer_segment_counts": """
SELECT rfm_segment, COUNT(*) AS customers FROM segments GROUP BY rfm_segment
""",
    "v_seller_performance": """
SELECT seller_id, seller_name, CAST(SUM(price) AS DOUBLE) AS total_revenue,
       COUNT(DISTINCT order_id) AS total_orders, AVG(review_score) AS avg_review_score,
       AVG(delivery_days) AS avg_delivery_days
FROM delivered GROUP BY seller_id, seller_name
""",
    "v_regional_sales": """
SELECT customer_state, CAST(SUM(price) AS DOUBLE) AS total_revenue,
       COUNT(DISTINCT order_id) AS total_orders,
       COUNT(DISTINCT customer_unique_id) AS total_customers,
       CAST(SUM(price) AS DOUBLE) / COUNT(DISTINCT order_id) AS aov,
       AVG(review_score) AS avg_review_score
FROM summary GROUP BY customer_state
""",
    "v_payment_analysis": """
SELECT payment_type, payment_installments, COUNT(DISTINCT order_id) AS order_count,
       CAST(SUM(payment_value) AS DOUBLE) AS total_value,
       CAST(SUM(payment_value) AS DOUBLE) / COUNT(payment_value) AS avg_value
FROM payments GROUP BY payment_type, payment_installments
""",
    "k05_catalog_tables": """
SELECT 'orders' AS table_name, COUNT(*) AS row_count,
       CAST(SUM(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS amount FROM orders
UNION ALL
SELECT 'products', COUNT(*), CAST(SUM(CAST(p_retailprice AS DECIMAL(18,2))) AS DOUBLE) FROM part
""",
    "k04_refresh_marts": """
SELECT 'v_sales_summary' AS mart, COUNT(*) AS row_count FROM summary
UNION ALL SELECT 'v_monthly_sales',
  COUNT(DISTINCT strftime(order_purchase_timestamp, '%Y-%m')) FROM summary
UNION ALL SELECT 'v_category_performance', COUNT(DISTINCT category) FROM summary
UNION ALL SELECT 'v_customer_segments', COUNT(*) FROM segments
UNION ALL SELECT 'v_seller_performance', COUNT(DISTINCT seller_id) FROM summary
UNION ALL SELECT 'v_regional_sales', COUNT(DISTINCT customer_state) FROM summary
UNION ALL SELECT 'v_payment_analysis', COUNT(*) FROM
  (SELECT DISTINCT payment_type, payment_installments FROM payments)
""",
    "k06_refresh_months": """
, deleted AS (
  SELECT o_orderkey AS order_id FROM orders
  WHERE year(o_orderdate) = 1999 AND month(o_orderdate) = 5 AND o_orderkey % 5 = 0
), kept AS (
  SELECT * FROM summary WHERE order_id NOT IN (SELECT order_id FROM deleted)
), kept_payments AS (
  SELECT * FROM payments WHERE order_id NOT IN (SELECT order_id FROM deleted)
), by_payment AS (
  SELECT payment_type, payment_installments, COUNT(DISTINCT order_id) AS orders, SUM(payment_value) AS paid
  FROM kept_payments GROUP BY ALL
)
SELECT 'v_sales_summary' AS mart, COUNT(*) AS row_count, CAST(SUM(price) AS DOUBLE) AS revenue,
       COUNT(DISTINCT order_id) AS orders FROM kept
UNION ALL SELECT 'v_monthly_sales', COUNT(DISTINCT strftime(order_purchase_timestamp, '%Y-%m')),
  CAST(SUM(price) AS DOUBLE), COUNT(DISTINCT order_id) FROM kept
UNION ALL SELECT 'v_category_performance', COUNT(DISTINCT category), CAST(SUM(price) AS DOUBLE),
  COUNT(DISTINCT (category, order_id)) FROM kept
UNION ALL SELECT 'v_customer_segments', COUNT(DISTINCT customer_unique_id), CAST(SUM(price) AS DOUBLE),
  COUNT(DISTINCT order_id) FROM kept
UNION ALL SELECT 'v_seller_performance', COUNT(DISTINCT seller_id), CAST(SUM(price) AS DOUBLE),
  COUNT(DISTINCT (seller_id, order_id)) FROM kept
UNION ALL SELECT 'v_regional_sales', COUNT(DISTINCT customer_state), CAST(SUM(price) AS DOUBLE),
  COUNT(DISTINCT order_id) FROM kept
UNION ALL SELECT 'v_payment_analysis', COUNT(*), CAST(SUM(paid) AS DOUBLE), CAST(SUM(orders) AS BIGINT)
  FROM by_payment
""",
}
BODIES["k07_sales_summary_bucketed"] = BODIES["v_sales_summary"]
