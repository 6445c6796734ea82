"""Tables held by a relational database, read in parallel over JDBC.

The matching driver jar (SQLite, MySQL or PostgreSQL) has to be on the
session's classpath.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class SplitColumn:
    """A numeric, date or timestamp column that cuts the table into ranges."""

    name: str
    lower: str
    upper: str
    partitions: int


# JDBC driver class per URL scheme.
DRIVERS = {
    "sqlite": "org.sqlite.JDBC",
    "mysql": "com.mysql.cj.jdbc.Driver",
    "postgresql": "org.postgresql.Driver",
}


def jdbc_options(
    url: str,
    table: str,
    split: SplitColumn | None = None,
    user: str | None = None,
    password: str | None = None,
    fetch_rows: int = 10_000,
) -> dict[str, str]:
    scheme = url.removeprefix("jdbc:").split(":", 1)[0]
    if not url.startswith("jdbc:") or scheme not in DRIVERS:
        raise ValueError(f"expected a jdbc URL for one of {sorted(DRIVERS)}")
    options = {
        "url": url,
        "driver": DRIVERS[scheme],
        "dbtable": table,
        "fetchsize": str(fetch_rows),
    }
    if user is not None:
        options["user"] = user
    if password is not None:
        options["password"] = password
    if split is not None:
        options |= {
            "partitionColumn": split.name,
            "lowerBound": split.lower,
            "upperBound": split.upper,
            "numPartitions": str(split.partitions),
        }
    return options


def read_database(spark: SparkSession, **settings) -> DataFrame:
    """Filters and column selection are pushed into the database by Spark.

    Without ``split`` the whole table comes through one connection, so give
    one for anything larger than a lookup table.
    """
    return spark.read.format("jdbc").options(**jdbc_options(**settings)).load()


def replace_database_table(df: DataFrame, connections: int = 8, **settings) -> None:
    """Replace a database table, with at most ``connections`` writers."""
    options = jdbc_options(**settings) | {"numPartitions": str(connections)}
    df.write.format("jdbc").options(**options).mode("overwrite").save()
