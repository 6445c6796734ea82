"""Tables in one folder for each value of an integer column, of which single folders are replaced."""

from __future__ import annotations

import uuid
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillroll.session import move_folder, remove_folder, subfolders

# What Spark calls the folder of rows without a value.
NO_VALUE = "__HIVE_DEFAULT_PARTITION__"
Values = Iterable[int | None] | None


def among(column: str, values: Values) -> Column:
    """Rows with one of the values, of which None is that of rows without one; all rows for None."""
    if values is None:
        return F.lit(True)
    values = set(values)
    known = sorted(value for value in values if value is not None)
    chosen = F.col(column).isin(*known) if known else F.lit(False)
    return chosen | F.col(column).isNull() if None in values else chosen


def read_partitions(spark: SparkSession, path: str, schema: T.StructType, column: str, values: Values = None) -> DataFrame:
    """The rows of some values, with the value as the last column."""
    columns = T.StructType([f for f in schema if f.name != column] + [T.StructField(column, T.IntegerType())])
    return spark.read.schema(columns).parquet(path).where(among(column, values))


def write_partitions(rows: DataFrame, path: str, column: str) -> DataFrame:
    """Write a table anew. Large folders get several files, small ones one."""
    _writer(rows, column).mode("overwrite").parquet(path)
    return read_partitions(rows.sparkSession, path, rows.schema, column)


def append_partitions(rows: DataFrame, path: str, column: str) -> None:
    _writer(rows, column).mode("append").parquet(path)


def replace_partitions(
    rows: DataFrame, path: str, column: str, values: Iterable[int | None], arranged: bool = False
) -> DataFrame:
    """Make rows the whole content of the given values' folders and leave all others as they are.

    rows must have these values, and may be made from the table itself: they are staged beside it first, and their
    folders then take the place of the old ones. A folder that is left without a row goes. Writing the same folders
    again after a failure gives the same table. arranged rows lie by the column already and are not shuffled for it.
    """
    spark, wanted = rows.sparkSession, set(values)
    staged = f"{path.rstrip('/')}-staged-{uuid.uuid4().hex}"
    (rows.write.partitionBy(column) if arranged else _writer(rows, column)).parquet(staged)
    found = partition_values(spark, staged, column)
    if found - wanted:
        raise ValueError(f"rows of a {column} that is not to be replaced: {sorted(map(str, found - wanted))}")
    for value in wanted:
        folder = f"{column}={NO_VALUE if value is None else value}"
        remove_folder(spark, f"{path}/{folder}")
        if value in found:
            move_folder(spark, f"{staged}/{folder}", f"{path}/{folder}")
    remove_folder(spark, staged)
    return read_partitions(spark, path, rows.schema, column, wanted)


def partition_values(spark: SparkSession, path: str, column: str) -> set[int | None]:
    """The values that have a folder, and so a row."""
    return {_value_of(name, column) for name in subfolders(spark, path) if name.startswith(f"{column}=")}


def _value_of(folder: str, column: str) -> int | None:
    value = folder.removeprefix(f"{column}=")
    return None if value == NO_VALUE else int(value)


def _writer(rows: DataFrame, column: str):
    return rows.hint("rebalance", column).write.partitionBy(column)
