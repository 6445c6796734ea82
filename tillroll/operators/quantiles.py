"""Exact cut-off values that split a column into equal parts, without a global sort."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

BUCKETS = 1000
SKETCH = 1024  # size of a sketch; its ranks are off by about 0.2 %
MARGIN = 0.01  # share of the values on each side of a sketched cut-off


@dataclass
class _Search:
    """The wanted place among the values of a column, and the range that should hold it."""

    column: str
    place: int
    below: int  # values under the range, as counted
    rows: int  # values in the range
    low: float
    high: float
    least: float = -math.inf  # of the whole column
    most: float = math.inf

    def proved(self, below: int, upto: int) -> bool:
        """Whether the range holds the place, given the values below it and up to its end.

        If it does not, the search goes on with all that lies on the other side of it.
        """
        if below >= self.place:
            self.low, self.high = self.least, math.nextafter(self.low, -math.inf)
        elif upto < self.place:
            self.low, self.high = math.nextafter(self.high, math.inf), self.most
        else:
            self.below, self.rows = below, upto - below
            return True
        return False

    def enter(self, buckets: list[Row]) -> None:
        """Go on with the one of the ordered buckets that holds the place."""
        for bucket in buckets:
            if self.below + bucket["rows"] >= self.place:
                self.rows, self.low, self.high = bucket["rows"], bucket["low"], bucket["high"]
                return
            self.below += bucket["rows"]
        raise RuntimeError(f"a cut-off of {self.column} lies outside its range")


def cut_offs(
    df: DataFrame, columns: Sequence[str], parts: int, buckets: int = BUCKETS, margin: float = MARGIN
) -> dict[str, list[float]]:
    """The ``parts - 1`` inner cut-offs of each column, none for an empty column.

    The i-th cut-off is the smallest value with at least i / parts of the
    values at or below it. NULL and NaN do not count; infinite values are
    refused. A first read makes a quantile sketch of each column, whose
    values at a small margin around a wanted place bracket the cut-off. A
    second read counts what lies below each bracket and, per bucket of equal
    width, what lies in it: that proves the bracket and mostly leaves a single
    value. Only where it does not are there further reads, of the bucket that holds the
    place or, if a sketch was further off than the margin, of the
    values beside the bracket. Only ``buckets`` counts per cut-off reach the
    driver, and no task sorts anything. ``df`` is read at least twice, so pass a
    stored table.
    """
    searches = {c: [] for c in columns}
    for column, (rows, low, high, around) in _sketched(df, columns, parts, margin).items():
        if rows and not (math.isfinite(low) and math.isfinite(high)):
            raise ValueError(f"{column} has infinite values")
        for part in range(1, parts if rows else 1):
            bracket = around[2 * part - 2 : 2 * part]
            searches[column].append(_Search(column, -(-rows * part // parts), 0, 0, *bracket, low, high))
    pending = [s for found in searches.values() for s in found if s.least < s.most]
    while pending:
        pending = _narrowed(df, pending, buckets)
    return {c: [s.low for s in found] for c, found in searches.items()}


def score(value: Column, cuts: Sequence[float]) -> Column:
    """1 plus the number of cut-offs below the value."""
    return sum((F.when(value > cut, 1).otherwise(0) for cut in cuts), F.lit(1))


def _value(column: str) -> Column:
    value = F.col(column).cast("double")
    return F.when(~F.isnan(value), value)


def _sketched(
    df: DataFrame, columns: Sequence[str], parts: int, margin: float
) -> dict[str, tuple[int, float, float, list[float]]]:
    """Rows, least, most and the sketched values below and above each inner cut-off, in one read."""
    ranks = [min(1.0, max(0.0, i / parts + side)) for i in range(1, parts) for side in (-margin, margin)]
    found = df.agg(
        *[
            F.struct(
                _extent(_value(c)).alias("extent"),
                F.kll_sketch_agg_double(_value(c), SKETCH).alias("sketch"),
            ).alias(c)
            for c in columns
        ]
    )
    around = {
        c: F.when(
            F.col(f"{c}.extent.rows") > 0,
            F.kll_sketch_get_quantile_double(F.col(c)["sketch"], F.array(*[F.lit(rank) for rank in ranks])),
        )
        for c in columns
    }
    row = found.select(*[F.struct(f"{c}.extent.*", around[c].alias("around")).alias(c) for c in columns])
    return {c: tuple(found) for c, found in row.first().asDict().items()}


def _narrowed(df: DataFrame, searches: list[_Search], buckets: int) -> list[_Search]:
    """Move each search on by one read; those that are not done yet.

    Every row is counted for each search as below its range or up to its end, and once more in the bucket of each
    range that holds it.
    """
    hits = F.array_compact(F.array(*[_hit(i, s, buckets) for i, s in enumerate(searches)]))
    columns = list(dict.fromkeys(s.column for s in searches))
    # A row in no range stays, and one in several ranges is told from its repeats by its number.
    rows = df.select(*columns, F.posexplode_outer(hits).alias("nth", "hit"))
    once = F.coalesce("nth", F.lit(0)) == 0
    counted = (
        rows.groupBy("hit.search", "hit.bucket")
        .agg(
            _extent(F.col("hit.value")).alias("extent"),
            F.array(*[F.count_if(once & (_value(s.column) < s.low)) for s in searches]).alias("below"),
            F.array(*[F.count_if(once & (_value(s.column) <= s.high)) for s in searches]).alias("upto"),
        )
        .select("search", "bucket", "extent.*", "below", "upto")
        .orderBy("search", "bucket")
        .collect()
    )
    pending = []
    for i, search in enumerate(searches):
        below, upto = (sum(row[side][i] for row in counted) for side in ("below", "upto"))
        if search.proved(below, upto):
            search.enter([row for row in counted if row["search"] == i])
            if search.low == search.high:
                continue
        pending.append(search)
    return pending


def _extent(value: Column) -> Column:
    return F.struct(F.count(value).alias("rows"), F.min(value).alias("low"), F.max(value).alias("high"))


def _hit(number: int, search: _Search, buckets: int) -> Column:
    """The search, bucket and value of a row in the range of a search."""
    value = _value(search.column)
    # The width of the whole range may be beyond a double; that of its half is not.
    scale = 1.0 if math.isfinite(search.high - search.low) else 0.5
    # A range of a single value has one bucket.
    offset = F.try_divide(value * scale - search.low * scale, F.lit(search.high * scale - search.low * scale))
    bucket = F.least(F.floor(offset * buckets), F.lit(buckets - 1))
    inside = value.between(search.low, search.high)
    return F.when(
        inside,
        F.struct(F.lit(number).alias("search"), bucket.alias("bucket"), value.alias("value")),
    )
