"""Days, look-backs and date filters."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window, functions as F

from newslab.constants import LOOKBACK_DAYS, LOOKBACK_MONTHS

DateLike = dt.date | str | Column | None


def day(col: Column) -> Column:
    """A timestamp as its calendar day; the session time zone must be UTC."""
    return F.to_date(col)


def parse_day(text: Column) -> Column:
    return F.to_date(text, "yyyy-MM-dd")


def format_day(col: Column) -> Column:
    return F.date_format(col, "yyyy-MM-dd")


def as_date(value: DateLike) -> Column:
    """A day given as text, date or column; the current day when not given."""
    if value is None:
        return F.current_date()
    if isinstance(value, Column):
        return value
    return F.lit(value).cast("date")


def resolve_window(
    window: str | None = None,
    since: DateLike = None,
    until: DateLike = None,
    as_of: DateLike = None,
) -> tuple[Column | None, Column | None]:
    """Bounds of a search. A look-back code replaces ``since``; ``until`` defaults to
    ``as_of`` when a code is given."""
    low = None if since is None else as_date(since)
    high = None if until is None else as_date(until)
    if window:
        if window.lower() not in LOOKBACK_DAYS:
            raise ValueError(f"look-back {window!r} is none of {', '.join(LOOKBACK_DAYS)}")
        low = F.date_sub(as_date(as_of), LOOKBACK_DAYS[window.lower()])
        high = as_date(as_of) if high is None else high
    return low, high


def within(df: DataFrame, date_from: DateLike = None, date_to: DateLike = None,
           column: str = "date") -> DataFrame:
    """Inclusive bounds, each only if given."""
    if date_from is not None:
        df = df.filter(day(F.col(column)) >= as_date(date_from))
    if date_to is not None:
        df = df.filter(day(F.col(column)) <= as_date(date_to))
    return df


def lookback_start(last_day: Column, code: str) -> Column | None:
    """First day of a calendar look-back that ends on the last day of the data."""
    if code not in LOOKBACK_MONTHS:
        raise ValueError(f"look-back {code!r} is none of {', '.join(LOOKBACK_MONTHS)}")
    months = LOOKBACK_MONTHS[code]
    return None if months is None else F.add_months(last_day, -months)


def from_last_day(daily: DataFrame, code: str) -> DataFrame:
    """Keep the last months of each ticker's daily rows."""
    last = F.max("date").over(Window.partitionBy("ticker"))
    start = lookback_start(F.col("_last"), code)
    if start is None:
        return daily
    return daily.withColumn("_last", last).filter(F.col("date") >= start).drop("_last")
