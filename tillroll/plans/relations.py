"""Lookups that complete the marketplace model before the marts are built."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def with_english_category(products: DataFrame, translation: DataFrame) -> DataFrame:
    """Add ``category``: the English name, or the original without a translation."""
    names = translation.select("product_category_name", "product_category_name_english")
    category = F.coalesce("product_category_name_english", "product_category_name")
    return (
        products.join(names, "product_category_name", "left")
        .withColumn("category", category)
        .drop("product_category_name_english")
    )


def with_location(df: DataFrame, geolocation: DataFrame, zip_column: str) -> DataFrame:
    """Add the mean coordinates of the postcode prefix.

    A prefix has many measured points, so they become one row per prefix
    before the join and no customer or seller is repeated.
    """
    places = geolocation.groupBy(F.col("geolocation_zip_code_prefix").alias(zip_column)).agg(
        F.avg("geolocation_lat").alias("latitude"), F.avg("geolocation_lng").alias("longitude")
    )
    return df.join(places, zip_column, "left")
