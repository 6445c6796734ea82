"""Many groupings of the same additive sums, each made from the smallest one that is fine enough."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillroll.session import stored


def cuboids(finest: DataFrame, groupings: Mapping[str, Sequence[str]], sums: Sequence[str]) -> dict[str, DataFrame]:
    """The sums of each grouping; its columns must be among those of ``finest``, or none for the total.

    Groupings are made from many columns to few. Each starts from the one with the fewest rows among those that hold
    its columns, or from ``finest``, which should be a stored table. A grouping that others can start from is stored
    too, so no row is read for two groupings that could share a smaller parent. A total over no rows is one row.
    """
    made: list[tuple[float, set[str], DataFrame]] = [(float("inf"), set(finest.columns) - set(sums), finest)]
    found = {}
    for name, columns in sorted(groupings.items(), key=lambda item: -len(item[1])):
        _, _, parent = min((c for c in made if set(columns) <= c[1]), key=lambda c: c[0])
        rows = parent.groupBy(*columns).agg(*[F.sum(value).alias(value) for value in sums])
        if any(set(other) < set(columns) for other in groupings.values()):
            rows = stored(rows, name)
            made.append((rows.count(), set(columns), rows))
        found[name] = rows
    return found
