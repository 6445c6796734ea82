"""Key checks of appended rows against a stored state of the keys.

For each table the state holds how many of its rows have a key value, and how many rows of other tables refer to the
value, in hash buckets. A batch is counted by value first, so that a hot value is one row; it reads and writes the
buckets of its values only. Violations are kept as one row per table and bucket, of which a batch renews its own,
and a check adds these up: no key is read for it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillroll.schemas import FOREIGN_KEYS, PRIMARY_KEYS
from tillroll.session import remove_folder, run_folder
from tillroll.sources.partitions import partition_values, read_partitions, replace_partitions, write_partitions

BUCKET = "bucket"
BUCKETS = 1024
ROWS_AT_ONCE = 250_000


def references_to(table: str) -> list[tuple[str, str]]:
    """(child table, child column) of the foreign keys that point to a table."""
    return [(child, column) for child, column, parent in FOREIGN_KEYS if parent == table]


class KeyState:
    """The state below a folder; values are compared as strings. The number of buckets must not change."""

    def __init__(self, spark: SparkSession, folder: str, buckets: int = BUCKETS):
        self.spark, self.folder, self.buckets = spark, folder.rstrip("/"), buckets

    def append(self, batch: dict[str, DataFrame]) -> None:
        """Count the rows of a batch in: new rows of some of the tables, whose parents may come before or after."""
        for table in PRIMARY_KEYS:
            counts = self._counts_of_batch(table, batch)
            if counts is None:
                continue
            touched, after = self._counted_in(self._path(f"{table}/values"), counts)
            violations = after.groupBy(BUCKET).agg(*_violations(table))
            replace_partitions(violations, self._path(f"{table}/violations"), BUCKET, touched)

    def _counted_in(self, path: str, counts: DataFrame) -> tuple[set[int], DataFrame]:
        """The buckets that a batch touches, and their rows with it. The first batch is the state; later ones are added up with it."""
        held = partition_values(self.spark, path, BUCKET)
        if not held:
            first = write_partitions(counts, path, BUCKET)
            return partition_values(self.spark, path, BUCKET), first
        batch = run_folder(self.spark, "key-counts")
        added = write_partitions(counts, batch, BUCKET)
        touched = partition_values(self.spark, batch, BUCKET)
        before = read_partitions(self.spark, path, counts.schema, BUCKET, touched)
        both = added.unionByName(before)
        # A value has one row on each side, so whole buckets, or parts of large ones, can meet in a task and stay there.
        tasks = -(-max(both.count(), 1) // ROWS_AT_ONCE)
        part = F.pmod(F.xxhash64("value", F.lit(0)), F.lit(-(-tasks // max(len(touched), 1)))).cast("int")
        met = both.withColumn("part", part).repartition(tasks, BUCKET, "part")
        sums = [F.sum(c).alias(c) for c in counts.columns if c not in ("value", BUCKET)]
        after = met.groupBy(BUCKET, "part", "value").agg(*sums).select(counts.columns)
        after = replace_partitions(after, path, BUCKET, touched, arranged=True)
        remove_folder(self.spark, batch)
        return touched, after

    def primary_keys(self) -> DataFrame:
        """The rows of :func:`integrity.check_primary_keys` for all rows counted so far."""
        columns = ["duplicate_keys", "surplus_rows", "null_keys"]
        parts = [self._totals(table, columns).select(F.lit(table).alias("table_name"), *columns) for table in PRIMARY_KEYS]
        return reduce(DataFrame.unionByName, parts)

    def foreign_keys(self) -> DataFrame:
        """The rows of :func:`integrity.check_foreign_keys` for all rows counted so far."""
        parts = []
        for child, column, parent in FOREIGN_KEYS:
            names = {f"{child}_{column}_orphan_{what}": f"orphan_{what}" for what in ("keys", "rows")}
            labels = {"child_table": child, "child_column": column, "parent_table": parent}
            parts.append(
                self._totals(parent, list(names)).select(
                    *[F.lit(value).alias(name) for name, value in labels.items()],
                    *[F.col(name).alias(label) for name, label in names.items()],
                )
            )
        return reduce(DataFrame.unionByName, parts)

    def _counts_of_batch(self, table: str, batch: dict[str, DataFrame]) -> DataFrame | None:
        """(value, rows, one column of references for each child, bucket) of what a batch adds to a table's values."""
        uses = {"rows": (table, PRIMARY_KEYS[table])}
        uses |= {f"{child}_{column}": (child, column) for child, column in references_to(table)}
        parts = []
        for name, (source, column) in uses.items():
            if source in batch:
                value = F.col(column).cast("string").alias("value")
                parts.append(batch[source].select(value, *[F.lit(int(u == name)).cast("long").alias(u) for u in uses]))
        if not parts:
            return None
        rows = reduce(DataFrame.unionByName, parts).groupBy("value").agg(*[F.sum(u).alias(u) for u in uses])
        return rows.withColumn(BUCKET, self._bucket())

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64("value"), F.lit(self.buckets)).cast("int")

    def _totals(self, table: str, columns: list[str]) -> DataFrame:
        schema = T.StructType([T.StructField(c, T.LongType()) for c in columns])
        rows = self._read(f"{table}/violations", schema, None)
        return rows.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in columns])

    def _read(self, name: str, schema: T.StructType, buckets: list[int] | None) -> DataFrame:
        try:
            return read_partitions(self.spark, self._path(name), schema, BUCKET, buckets)
        except Exception as missing:
            # The first batch that has values for a table finds no state.
            if "PATH_NOT_FOUND" not in str(missing):
                raise
            return self.spark.createDataFrame([], T.StructType([*[f for f in schema if f.name != BUCKET], T.StructField(BUCKET, T.IntegerType())]))

    def _path(self, name: str) -> str:
        return f"{self.folder}/{name}"


def _violations(table: str) -> list[Column]:
    known = F.col("value").isNotNull()
    repeated = known & (F.col("rows") > 1)
    total = lambda column: F.coalesce(F.sum(column), F.lit(0))
    columns = [
        F.count_if(repeated).alias("duplicate_keys"),
        total(F.when(repeated, F.col("rows") - 1)).alias("surplus_rows"),
        total(F.when(~known, F.col("rows"))).alias("null_keys"),
    ]
    for child, column in references_to(table):
        name = f"{child}_{column}"
        orphan = known & (F.col("rows") == 0) & (F.col(name) > 0)
        columns.append(F.count_if(orphan).alias(f"{name}_orphan_keys"))
        columns.append(total(F.when(orphan, F.col(name))).alias(f"{name}_orphan_rows"))
    return columns
