"""The two table sets the analyses read."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame


@dataclass(frozen=True)
class RetailTables:
    """Core retail model: who ordered what, and at which price."""

    customers: DataFrame
    products: DataFrame
    orders: DataFrame
    order_items: DataFrame

    @property
    def customer_names(self) -> DataFrame:
        return self.customers.select("customer_id", "customer_name")

    def named(self) -> dict[str, DataFrame]:
        return {
            "customers": self.customers,
            "products": self.products,
            "orders": self.orders,
            "order_items": self.order_items,
        }


@dataclass(frozen=True)
class StoreModel:
    """Marketplace model behind the reporting marts.

    ``orders`` carries order_id, customer_id, order_purchase_timestamp,
    order_delivered_customer_date and order_estimated_delivery_date.
    ``order_payments`` and ``order_reviews`` may hold several rows per order.
    """

    orders: DataFrame
    order_items: DataFrame
    order_payments: DataFrame
    order_reviews: DataFrame
    customers: DataFrame
    products: DataFrame
    sellers: DataFrame
