from __future__ import annotations

from tables import row_set

from tillroll.plans import relations


def test_category_falls_back_to_the_original_name(spark):
    products = spark.createDataFrame(
        [("p1", "brinquedos"), ("p2", "novo"), ("p3", None)],
        "product_id string, product_category_name string",
    )
    names = spark.createDataFrame(
        [("brinquedos", "toys")],
        "product_category_name string, product_category_name_english string",
    )
    found = relations.with_english_category(products, names).select("product_id", "category")
    assert row_set(found) == {("p1", "toys"), ("p2", "novo"), ("p3", None)}


def test_many_points_per_postcode_repeat_no_customer(spark):
    customers = spark.createDataFrame(
        [("c1", "010"), ("c2", "010"), ("c3", "999")],
        "customer_id string, customer_zip_code_prefix string",
    )
    points = spark.createDataFrame(
        [("010", 1.0, 10.0), ("010", 3.0, 30.0)],
        "geolocation_zip_code_prefix string, geolocation_lat double, geolocation_lng double",
    )
    found = relations.with_location(customers, points, "customer_zip_code_prefix")
    assert row_set(found.select("customer_id", "latitude", "longitude")) == {
        ("c1", 2.0, 20.0), ("c2", 2.0, 20.0), ("c3", None, None)
    }
