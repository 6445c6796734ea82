"""Calendar labels and range conditions on raw timestamp columns."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F


def year_month(ts: Column) -> Column:
    """2024-06"""
    return F.date_format(ts, "yyyy-MM")


def plain_month_label(year: Column, month: Column) -> Column:
    """2024-6: the month is not padded."""
    return F.concat_ws("-", year.cast("string"), month.cast("string"))


def year_quarter(ts: Column) -> Column:
    """2024-Q2"""
    return F.concat(F.year(ts).cast("string"), F.lit("-Q"), F.quarter(ts).cast("string"))


def day_name(ts: Column) -> Column:
    return F.date_format(ts, "EEEE")


def weekday_position(ts: Column) -> Column:
    """0 for Monday up to 6 for Sunday."""
    return F.weekday(ts)


def month_number(year: Column, month: Column) -> Column:
    """Months on one unbroken integer axis, so a gap shows as a difference above 1."""
    return year * F.lit(12) + month


def days_between(start: Column, end: Column) -> Column:
    return F.date_diff(F.to_date(end), F.to_date(start))


def on_days(ts: Column, start: date, end: date) -> Column:
    """True when the date part lies in [start, end].

    Written as a half-open range on the raw column so that it reaches the scan.
    """
    return (ts >= _midnight(start)) & (ts < _midnight(end + timedelta(days=1)))


def in_year_quarter(ts: Column, year: int | None = None, quarter: int | None = None) -> Column:
    """Year and quarter slicers; a chosen year becomes a pushable range."""
    if year is None:
        return F.lit(True) if quarter is None else F.quarter(ts) == quarter
    first_month = 1 if quarter is None else 3 * (quarter - 1) + 1
    months = 12 if quarter is None else 3
    begin = date(year, first_month, 1)
    following = first_month + months
    finish = date(year + 1, 1, 1) if following > 12 else date(year, following, 1)
    return (ts >= _midnight(begin)) & (ts < _midnight(finish))


def _midnight(day: date) -> Column:
    return F.lit(f"{day.isoformat()} 00:00:00").cast("timestamp_ntz")
