"""The table bindings as common table expressions."""

RETAIL = """
WITH customers AS (
  SELECT c_custkey AS customer_id, c_name AS customer_name, n_name AS city, r_name AS state
  FROM customer
  LEFT JOIN nation ON c_nationkey = n_nationkey
  LEFT JOIN region ON n_regionkey = r_regionkey
), products AS (
  SELECT p_partkey AS product_id, p_name AS product_name, p_type AS category, p_brand AS brand,
         CAST(p_retailprice AS DECIMAL(18,2)) AS cost_price, p_size AS stock_quantity
  FROM part
), raw_orders AS (
  SELECT o_orderkey AS order_id, o_custkey AS customer_id, o_orderdate AS order_date,
         NULLIF(o_orderpriority, '4-NOT SPECIFIED') AS payment_method,
         CASE WHEN o_orderstatus = 'F' THEN 'Delivered'
              WHEN o_orderstatus = 'P' THEN 'Pending'
              WHEN o_orderkey % 2 = 0 THEN 'Shipped'
              ELSE 'Cancelled' END AS order_status,
         CAST(o_totalprice AS DECIMAL(18,2)) AS total_amount
  FROM orders
), sales_orders AS (
  SELECT *, CAST(year(order_date) AS INTEGER) AS order_year,
         CAST(month(order_date) AS INTEGER) AS order_month
  FROM raw_orders
), order_items AS (
  SELECT l_orderkey * 10 + l_linenumber AS order_item_id, l_orderkey AS order_id,
         l_partkey AS product_id, CAST(l_quantity AS INTEGER) AS quantity,
         CAST(l_extendedprice AS DECIMAL(18,2)) AS unit_price
  FROM lineitem
), registered AS (
  SELECT c.*, f.registration_date
  FROM customers c
  LEFT JOIN (SELECT customer_id, CAST(MIN(order_date) AS DATE) AS registration_date
             FROM raw_orders GROUP BY customer_id) f USING (customer_id)
), master AS (
  SELECT i.*, o.customer_id, o.order_date,
         COALESCE(o.payment_method, 'Unknown') AS payment_method, o.order_status, o.total_amount,
         o.order_year, o.order_month, p.product_name, p.category, p.brand, p.cost_price,
         p.stock_quantity, c.customer_name, c.city, c.state,
         i.unit_price * i.quantity AS amount,
         (i.unit_price - p.cost_price) * i.quantity AS profit
  FROM order_items i
  LEFT JOIN sales_orders o ON i.order_id = o.order_id
  LEFT JOIN products p ON i.product_id = p.product_id
  LEFT JOIN customers c ON o.customer_id = c.customer_id
), two_years AS (
  SELECT * FROM master
  WHERE CAST(order_date AS DATE) BETWEEN DATE '1997-01-01' AND DATE '1998-12-31'
), narrow AS (
  SELECT * FROM two_years
  WHERE category IN ('ECONOMY', 'SMALL', 'LARGE') AND state IN ('ASIA', 'EUROPE')
)
"""

STORE = """
WITH arrivals AS (
  SELECT l_orderkey AS order_id, MAX(l_shipdate) AS last_arrival,
         (MAX(LEAST(l_linenumber, 5)) + MIN(LEAST(l_linenumber, 5))) / 2.0 AS review_score
  FROM lineitem GROUP BY l_orderkey
), paid AS (
  SELECT o_orderkey AS order_id, o_orderpriority AS main_type, o_orderkey % 3 = 0 AS several,
         CAST(o_orderkey % 24 + 1 AS INTEGER) AS installments,
         CAST(o_totalprice AS DECIMAL(18,2)) AS amount,
         CAST(CAST(o_totalprice AS DECIMAL(18,2)) * 0.3 AS DECIMAL(18,2)) AS voucher
  FROM orders
), payments AS (
  SELECT order_id, main_type AS payment_type, installments AS payment_installments,
         CAST(CASE WHEN several THEN amount - 2 * voucher ELSE amount END AS DECIMAL(18,2))
           AS payment_value
  FROM paid
  UNION ALL SELECT order_id, 'VOUCHER', 1, voucher FROM paid WHERE several
  UNION ALL SELECT order_id, 'VOUCHER', 1, voucher FROM paid WHERE several
), settled AS (
  SELECT order_id, amount,
         CASE WHEN several AND 2 * voucher >= amount - 2 * voucher THEN 'VOUCHER' ELSE main_type END
           AS payment_type,
         installments AS payment_installments
  FROM paid
), summary AS (
  SELECT l_orderkey AS order_id, c_custkey AS customer_unique_id, n_name AS customer_state,
         l_partkey AS product_id, p_type AS category, l_suppkey AS seller_id, s_name AS seller_name,
         o_orderdate AS order_purchase_timestamp,
         CASE WHEN last_arrival >= o_orderdate THEN last_arrival END
           AS order_delivered_customer_date,
         o_orderdate + INTERVAL 60 DAY AS order_estimated_delivery_date,
         CAST(l_extendedprice AS DECIMAL(18,2)) AS price,
         settled.payment_type, settled.payment_installments, settled.amount AS payment_value,
         CAST(review_score AS DOUBLE) AS review_score
  FROM lineitem
  LEFT JOIN orders ON l_orderkey = o_orderkey
  LEFT JOIN arrivals ON arrivals.order_id = l_orderkey
  LEFT JOIN settled ON settled.order_id = l_orderkey
  LEFT JOIN customer ON o_custkey = c_custkey
  LEFT JOIN nation ON c_nationkey = n_nationkey
  LEFT JOIN part ON l_partkey = p_partkey
  LEFT JOIN supplier ON l_suppkey = s_suppkey
), delivered AS (
  SELECT *, CAST(date_diff('day', CAST(order_purchase_timestamp AS DATE),
                           CAST(order_delivered_customer_date AS DATE)) AS INTEGER) AS delivery_days
  FROM summary
), sliced AS (
  SELECT * FROM summary
  WHERE CAST(order_purchase_timestamp AS DATE) BETWEEN DATE '1997-01-01' AND DATE '1998-12-31'
    AND category IN ('ECONOMY', 'SMALL', 'LARGE')
    AND customer_state IN ('NATION_1', 'NATION_4', 'NATION_9')
), monthly AS (
  SELECT CAST(year(order_purchase_timestamp) AS INTEGER) AS order_year,
         CAST(month(order_purchase_timestamp) AS INTEGER) AS order_month,
         SUM(price) AS revenue
  FROM summary GROUP BY 1, 2
), rfm AS (
  SELECT customer_unique_id,
         CAST(date_diff('day', CAST(MAX(order_purchase_timestamp) AS DATE),
              (SELECT CAST(MAX(order_purchase_timestamp) AS DATE) FROM summary)) AS INTEGER)
           AS recency_days,
         COUNT(DISTINCT order_id) AS frequency,
         CAST(SUM(price) AS DOUBLE) AS monetary
  FROM summary GROUP BY customer_unique_id
), cuts AS (
  SELECT quantile_disc(recency_days, [0.2, 0.4, 0.6, 0.8]) AS r,
         quantile_disc(frequency, [0.2, 0.4, 0.6, 0.8]) AS f,
         quantile_disc(monetary, [0.2, 0.4, 0.6, 0.8]) AS m
  FROM rfm
), scored AS (
  SELECT rfm.*,
         CAST(5 - (recency_days > r[1])::INT - (recency_days > r[2])::INT
                - (recency_days > r[3])::INT - (recency_days > r[4])::INT AS INTEGER) AS r_score,
         CAST(1 + (frequency > f[1])::INT + (frequency > f[2])::INT
                + (frequency > f[3])::INT + (frequency > f[4])::INT AS INTEGER) AS f_score,
         CAST(1 + (monetary > m[1])::INT + (monetary > m[2])::INT
                + (monetary > m[3])::INT + (monetary > m[4])::INT AS INTEGER) AS m_score
  FROM rfm, cuts
), segments AS (
  SELECT *,
         CASE WHEN r_score >= 4 AND f_score >= 4 AND m_score >= 4 THEN 'Champions'
              WHEN r_score >= 3 AND f_score >= 3 THEN 'Loyal'
              WHEN r_score >= 4 AND f_score <= 2 THEN 'Recent'
              WHEN r_score <= 2 AND (f_score >= 4 OR m_score >= 4) THEN 'At Risk'
              WHEN r_score <= 2 THEN 'Hibernating'
              ELSE 'Regular' END AS rfm_segment
  FROM scored
)
"""
