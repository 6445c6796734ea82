"""Catalog tables and views."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tillroll import schemas
from tillroll.model import RetailTables


def create_tables(spark: SparkSession, database: str = "default") -> None:
    """Create the four typed tables unless they exist."""
    for name in schemas.TABLES:
        spark.sql(
            f"CREATE TABLE IF NOT EXISTS {database}.{name} "
            f"({schemas.table_columns_ddl(name)}) USING parquet"
        )


def insert_rows(df: DataFrame, table: str) -> None:
    """Append to a catalog table, matching columns by name."""
    columns = df.sparkSession.table(table).columns
    df.select(*columns).write.insertInto(table, overwrite=False)


def catalog_tables(spark: SparkSession, database: str = "default") -> RetailTables:
    return RetailTables(**{name: spark.table(f"{database}.{name}") for name in schemas.TABLES})


def register_tables(tables: RetailTables) -> None:
    """Make the four tables visible to ``spark.sql`` under their own names."""
    for name, df in tables.named().items():
        df.createOrReplaceTempView(name)


def replace_view(df: DataFrame, name: str) -> DataFrame:
    """(Re)create a session view and return it as a table."""
    df.createOrReplaceTempView(name)
    return df.sparkSession.table(name)


def import_views(spark: SparkSession, names: list[str]) -> dict[str, DataFrame]:
    return {name: spark.table(name) for name in names}
