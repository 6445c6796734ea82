"""What the text operators share: words, and Arrow batches of one column.

A word is a run of bytes without space, tab, line feed, vertical tab, form feed or carriage return.
All of these are ASCII, so UTF-8 text can be split as bytes, and ``bytes.lower`` lowers A-Z only.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

WORD = r"[^\x20\x09-\x0D]+"
# Work arrays of one step cover about so many words, however long the batch is.
WORDS_AT_ONCE = 400_000
BYTES_AT_ONCE = 4 << 20


def as_text(column: str) -> Column:
    """The column as a string; a column of nulls only becomes a column of null strings."""
    return F.col(f"`{column}`").cast("string")


def identified(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(doc_id, text): what most operators read, so that other columns cannot clash with theirs."""
    return docs.select(F.col(f"`{doc_id}`").alias("doc_id"), as_text(text).alias("text"))


def kind_of(df: DataFrame, column: str) -> str:
    return df.schema[column].dataType.simpleString()


def raw_texts(column: pa.Array) -> list[bytes]:
    """The UTF-8 bytes of each value, empty for null."""
    return [value or b"" for value in column.cast(pa.large_binary()).to_pylist()]


def slices(sizes: list[int], at_once: int) -> Iterator[slice]:
    """Neighbouring items whose sizes add up to at_once, or one item that is larger."""
    start, total = 0, 0
    for i, size in enumerate(sizes):
        if i > start and total + size > at_once:
            yield slice(start, i)
            start, total = i, 0
        total += size
    if start < len(sizes):
        yield slice(start, len(sizes))


def code_points(raw: bytes) -> int:
    return len(raw) - int(np.count_nonzero((np.frombuffer(raw, np.uint8) & 0xC0) == 0x80))


def map_batches(
    df: DataFrame, step: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str | StructType
) -> DataFrame:
    """Apply step to df in Arrow batches of about BYTES_AT_ONCE, or of one row where that is longer."""

    def run(batches):
        for batch in batches:
            rows = max(1, batch.num_rows * BYTES_AT_ONCE // max(1, batch.nbytes))
            for start in range(0, batch.num_rows, rows):
                yield step(batch.slice(start, rows))

    return df.mapInArrow(run, schema)


def spread(spark: SparkSession, rows: int, rows_per_task: int) -> int:
    """How many tasks to deal rows to; grows with the rows."""
    return max(spark.sparkContext.defaultParallelism, math.ceil(rows / rows_per_task))
