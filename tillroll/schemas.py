"""Declared schemas of the retail tables. Nothing is inferred."""

from __future__ import annotations

from pyspark.sql import types as T

PRICE = T.DecimalType(10, 2)


def _struct(*columns: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in columns])


CUSTOMERS = _struct(
    ("customer_id", T.StringType()),
    ("customer_name", T.StringType()),
    ("gender", T.StringType()),
    ("email", T.StringType()),
    ("phone", T.StringType()),
    ("city", T.StringType()),
    ("state", T.StringType()),
    ("country", T.StringType()),
    ("registration_date", T.DateType()),
)

PRODUCTS = _struct(
    ("product_id", T.StringType()),
    ("product_name", T.StringType()),
    ("category", T.StringType()),
    ("brand", T.StringType()),
    ("price", PRICE),
    ("cost_price", PRICE),
    ("stock_quantity", T.IntegerType()),
)

ORDERS = _struct(
    ("order_id", T.StringType()),
    ("customer_id", T.StringType()),
    ("order_date", T.TimestampNTZType()),
    ("payment_method", T.StringType()),
    ("shipping_method", T.StringType()),
    ("order_status", T.StringType()),
    ("total_amount", PRICE),
)

ORDER_ITEMS = _struct(
    ("order_item_id", T.StringType()),
    ("order_id", T.StringType()),
    ("product_id", T.StringType()),
    ("quantity", T.IntegerType()),
    ("unit_price", PRICE),
)

TABLES = {
    "customers": CUSTOMERS,
    "products": PRODUCTS,
    "orders": ORDERS,
    "order_items": ORDER_ITEMS,
}

# The text widths of the published table definitions.
TEXT_WIDTHS = {
    "customers": {
        "customer_id": 50, "customer_name": 100, "gender": 20, "email": 100,
        "phone": 50, "city": 100, "state": 100, "country": 50,
    },
    "products": {"product_id": 50, "product_name": 255, "category": 100, "brand": 100},
    "orders": {
        "order_id": 50, "customer_id": 50, "payment_method": 50,
        "shipping_method": 50, "order_status": 50,
    },
    "order_items": {"order_item_id": 50, "order_id": 50, "product_id": 50},
}

PRIMARY_KEYS = {
    "customers": "customer_id",
    "products": "product_id",
    "orders": "order_id",
    "order_items": "order_item_id",
}

# (child table, child column, parent table); the parent column is its primary key.
FOREIGN_KEYS = (
    ("orders", "customer_id", "customers"),
    ("order_items", "order_id", "orders"),
    ("order_items", "product_id", "products"),
)


def table_columns_ddl(table: str) -> str:
    """Column list for ``CREATE TABLE``, with the declared text widths."""
    widths = TEXT_WIDTHS[table]
    return ", ".join(
        f"{field.name} VARCHAR({widths[field.name]})"
        if field.name in widths
        else f"{field.name} {field.dataType.simpleString()}"
        for field in TABLES[table]
    )
