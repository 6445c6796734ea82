def _primary(table: str, source: str, key: str) -> str:
    return f"""
SELECT '{table}' AS table_name,
       COUNT(*) FILTER ({key} IS NOT NULL AND n > 1) AS duplicate_keys,
       CAST(COALESCE(SUM(n - 1) FILTER ({key} IS NOT NULL), 0) AS BIGINT) AS surplus_rows,
       CAST(COALESCE(SUM(n) FILTER ({key} IS NULL), 0) AS BIGINT) AS null_keys
FROM (SELECT {key}, COUNT(*) AS n FROM {source} GROUP BY {key})
"""


def _foreign(child: str, source: str, key: str, parent: str, parent_source: str) -> str:
    return f"""
SELECT '{child}' AS child_table, '{key}' AS child_column, '{parent}' AS parent_table,
       COUNT(DISTINCT c.{key}) AS orphan_keys, COUNT(*) AS orphan_rows
FROM {source} c
WHERE c.{key} IS NOT NULL AND NOT EXISTS (SELECT 1 FROM {parent_source} p WHERE p.{key} = c.{key})
"""


BODIES = {
    "c01_pk_violations": "UNION ALL".join(
        [
            _primary("customers", "customers", "customer_id"),
            _primary("products", "products", "product_id"),
            _primary("orders", "sales_orders", "order_id"),
            _primary("order_items", "order_items", "order_item_id"),
        ]
    ),
    "c02_fk_violations": "UNION ALL".join(
        [
            _foreign("orders", "sales_orders", "customer_id", "customers", "customers"),
            _foreign("order_items", "order_items", "order_id", "orders", "sales_orders"),
            _foreign("order_items", "order_items", "product_id", "products", "products"),
        ]
    ),
}

# The tables after the second batch of the key state.
_KNOWN = "(SELECT * FROM customers WHERE customer_id % 10 <> 0)"
_TWICE = "(SELECT product_id FROM products UNION ALL SELECT product_id FROM products WHERE product_id % 100 = 7)"

BODIES |= {
    "c03_appended_primary_keys": "UNION ALL".join(
        [
            _primary("customers", _KNOWN, "customer_id"),
            _primary("products", _TWICE, "product_id"),
            _primary("orders", "sales_orders", "order_id"),
            _primary("order_items", "order_items", "order_item_id"),
        ]
    ),
    "c04_appended_foreign_keys": "UNION ALL".join(
        [
            _foreign("orders", "sales_orders", "customer_id", "customers", _KNOWN),
            _foreign("order_items", "order_items", "order_id", "orders", "sales_orders"),
            _foreign("order_items", "order_items", "product_id", "products", _TWICE),
        ]
    ),
}
