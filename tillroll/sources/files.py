"""CSV and parquet tables: read, replace, append, export."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillroll import schemas
from tillroll.model import RetailTables
from tillroll.session import stored


# A quote inside a quoted value is doubled, as other CSV writers do it.
QUOTING = {"quote": '"', "escape": '"'}


def read_csv(
    spark: SparkSession, path: str, schema: T.StructType, line_breaks: bool = False
) -> DataFrame:
    """CSV with a header row and a declared schema.

    A value that does not fit its declared type stops the job instead of
    turning into NULL, and the header must name the declared columns. Ask for
    ``line_breaks`` only if quoted values contain any: a file then cannot be
    split between tasks.
    """
    return (
        spark.read.schema(schema)
        .options(header=True, enforceSchema=False, mode="FAILFAST", multiLine=line_breaks)
        .options(**QUOTING)
        .csv(path)
    )


def load_csv(
    spark: SparkSession, path: str, schema: T.StructType, rejects: str, most_rejects: int | None = None
) -> DataFrame:
    """The good rows of CSV files; the others go to a table of rejects.

    A line that has a value which does not fit its declared type, or too few or too many values, is written to
    ``rejects`` as (file, line, reason) and left out. The files are read once; good rows and rejects together are
    all lines. With more than ``most_rejects`` of them the load stops after the rejects were written. A line that a
    quote keeps open is read as far as the next line break.
    """
    columns = T.StructType([*schema, T.StructField(_RAW, T.StringType())])
    rows = (
        spark.read.schema(columns)
        .options(header=True, enforceSchema=False, mode="PERMISSIVE", columnNameOfCorruptRecord=_RAW)
        .options(**QUOTING)
        .csv(path)
    )
    parsed = stored(rows.withColumn(_FILE, F.col("_metadata.file_path")), "parsed-csv")
    bad = parsed.where(F.col(_RAW).isNotNull())
    bad = bad.select(F.col(_FILE).alias("file"), F.col(_RAW).alias("line"), _reason(schema).alias("reason"))
    found = replace_table(bad, rejects).count()
    if most_rejects is not None and found > most_rejects:
        raise ValueError(f"{found} lines of {path} were rejected, more than {most_rejects}; they are in {rejects}")
    return parsed.where(F.col(_RAW).isNull()).drop(_RAW, _FILE)


# Columns of a load that no table has.
_RAW, _FILE = "_raw_line", "_file"


def _reason(schema: T.StructType) -> Column:
    """The first column whose text does not fit its type; if all do, the number of values is wrong."""
    texts = ", ".join(f"`{field.name}` STRING" for field in schema)
    values = F.from_csv(F.col(_RAW), texts, {"mode": "PERMISSIVE", **QUOTING})
    unfit = [
        F.when(
            (F.trim(values[field.name]) != "") & values[field.name].try_cast(field.dataType).isNull(),
            f"{field.name} is no {field.dataType.simpleString()}",
        )
        for field in schema
    ]
    return F.coalesce(*unfit, F.lit("wrong number of values"))


def read_csv_tables(spark: SparkSession, folder: str) -> RetailTables:
    """The four tables from ``<folder>/<table>.csv`` files or folders."""
    return RetailTables(
        **{
            name: read_csv(spark, f"{folder.rstrip('/')}/{name}.csv", schema)
            for name, schema in schemas.TABLES.items()
        }
    )


def read_tables(spark: SparkSession, folder: str) -> RetailTables:
    """The four tables as written by :func:`replace_table`."""
    return RetailTables(
        **{name: spark.read.parquet(f"{folder.rstrip('/')}/{name}") for name in schemas.TABLES}
    )


def replace_table(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> DataFrame:
    """Write a table anew, dropping what was there, and return it as stored."""
    writer = df.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def append_rows(df: DataFrame, path: str) -> None:
    """Bulk append: one distributed write instead of row-by-row inserts."""
    df.write.mode("append").parquet(path)


def export_csv(df: DataFrame, path: str) -> None:
    """A report as a folder of CSV parts, each with a header row."""
    df.write.mode("overwrite").options(header=True, **QUOTING).csv(path)
