"""Tables for point lookups: rows of one key lie together, and files tell whether they have a key."""

from __future__ import annotations

from pyspark.sql import DataFrame

FILES = 64


def write_clustered(rows: DataFrame, path: str, key: str, tie: str, files: int = FILES, keys_per_file: int = 100_000) -> DataFrame:
    """Write a table in ranges of key, and of tie where one key fills several files, with Bloom filters of the key.

    A lookup by key opens the footers; of the row groups it reads those whose range holds the key and whose Bloom filter
    does not deny it, and of these the pages of the range. keys_per_file sizes the filters: about ten bits a key.
    """
    writer = rows.repartitionByRange(files, key, tie).sortWithinPartitions(key, tie).write.mode("overwrite")
    writer = writer.option(f"parquet.bloom.filter.enabled#{key}", "true")
    writer.option(f"parquet.bloom.filter.expected.ndv#{key}", str(keys_per_file)).parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)
