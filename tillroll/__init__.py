"""Retail sales analytics expressed as Spark DataFrame jobs."""

from tillroll.model import RetailTables, StoreModel
from tillroll.operators.filters import SalesFilter

__all__ = ["RetailTables", "SalesFilter", "StoreModel"]
