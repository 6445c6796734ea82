_PREPARED_ORDERS = """
SELECT order_id, customer_id, order_date, COALESCE(payment_method, 'Unknown') AS payment_method,
       order_status, CAST(total_amount AS DOUBLE) AS total_amount, order_year, order_month
FROM sales_orders
"""

LINE_COLUMNS = """
order_item_id, order_id, product_id, quantity, CAST(unit_price AS DOUBLE) AS unit_price,
customer_id, order_date, payment_method, order_status,
CAST(total_amount AS DOUBLE) AS total_amount, order_year, order_month, customer_name, city, state,
product_name, category, brand, CAST(cost_price AS DOUBLE) AS cost_price, stock_quantity,
CAST(profit AS DOUBLE) AS profit
"""

BODIES = {
    "p01_clean_customers": """
SELECT customer_id, customer_name, city, state, registration_date,
       CASE WHEN customer_id % 20 = 0 THEN 'no_email@example.com'
            ELSE customer_name || '@x' END AS email
FROM registered
""",
    "p02_clean_orders": _PREPARED_ORDERS,
    "p03_item_profit": """
SELECT i.order_item_id, i.order_id, i.product_id, i.quantity,
       CAST(i.unit_price AS DOUBLE) AS unit_price, CAST(p.cost_price AS DOUBLE) AS cost_price,
       CAST((i.unit_price - p.cost_price) * i.quantity AS DOUBLE) AS profit
FROM order_items i LEFT JOIN products p ON i.product_id = p.product_id
""",
    "p04_order_totals": """
SELECT o.order_id,
       CAST(COALESCE(ROUND(SUM(i.quantity * i.unit_price), 2), 0) AS DOUBLE) AS total_amount
FROM raw_orders o LEFT JOIN order_items i ON i.order_id = o.order_id
GROUP BY o.order_id
""",
    "p05_sales_master": f"SELECT {LINE_COLUMNS} FROM master",
    "p06_csv_roundtrip": """
SELECT CAST(order_date AS DATE) AS "Date", CAST(SUM(amount) AS DOUBLE) AS "Revenue"
FROM master GROUP BY 1
""",
    "p07_table_replace": _PREPARED_ORDERS,
    # The extracts have no place of a customer but the one they are bound to.
    "p08_csv_load": f"SELECT {LINE_COLUMNS} FROM master",
    "p09_low_stock_export": """
SELECT product_id, product_name, category, brand, CAST(cost_price AS DOUBLE) AS cost_price,
       stock_quantity
FROM products WHERE stock_quantity < 10
""",
    "p10_csv_rejects": """
SELECT CASE order_item_id % 1000 WHEN 1 THEN 'quantity is no int'
            WHEN 2 THEN 'unit_price is no decimal(10,2)' ELSE 'loaded' END AS outcome,
       COUNT(*) AS line_count,
       CAST(SUM(CASE WHEN order_item_id % 1000 IN (1, 2) THEN NULL ELSE quantity END) AS BIGINT) AS units
FROM order_items GROUP BY 1
""",
}
BODIES["p05_sales_master_bucketed"] = BODIES["p05_sales_master"]
