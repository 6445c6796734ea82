from __future__ import annotations

import os

import pytest
from folders import MIDDLE, SMALL

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session", autouse=True)
def importable(spark):
    """Python workers find the package wherever the tests were started."""
    spark.sparkContext.environment["PYTHONPATH"] = ROOT


@pytest.fixture(scope="session")
def small(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet").cache()


@pytest.fixture(scope="session")
def middle(spark):
    return spark.read.parquet(f"{MIDDLE}/documents.parquet").cache()


@pytest.fixture
def docs(spark):
    """Make documents of (doc_id, text) rows, with more columns whose names the operators use themselves."""
    from pyspark.sql import functions as F

    def make(rows, plain=False):
        df = spark.createDataFrame(rows, "doc_id long, text string")
        if plain:
            return df
        clashing = ["fp", "digest", "kept", "own", "start", "ids", "row", "word", "part", "spans", "held_out", "component_id", "n", "label"]
        return df.withColumns({name: F.lit("x") for name in clashing})

    return make
