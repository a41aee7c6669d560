"""Instants, look-back windows and the date bounds that prune partitions."""

from __future__ import annotations

from datetime import datetime, timedelta, timezone

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Instant = str | datetime | Column | None


def instant(value: Instant = None) -> Column:
    """A timestamp column from text, a datetime (naive means UTC), a column, or the current time."""
    if value is None:
        return F.current_timestamp()
    if isinstance(value, Column):
        return value
    if isinstance(value, datetime):
        if value.tzinfo is not None:
            value = value.astimezone(timezone.utc).replace(tzinfo=None)
        value = value.isoformat(sep=" ")
    return F.lit(value).cast("timestamp")


def before(as_of: Instant, **amount: float) -> Column:
    """``as_of`` minus a duration given as timedelta keywords (days, hours, minutes).

    Every part is foldable, so Spark turns it into one literal and pushes it to the scan.
    """
    return instant(as_of) - F.lit(timedelta(**amount))


def in_range(
    df: DataFrame,
    start: Instant = None,
    end: Instant = None,
    column: str = "timestamp",
) -> DataFrame:
    """Rows with ``start <= column <= end``; a bound that is None is absent.

    When the table carries its ``log_date`` partition column the matching date bounds are added,
    because Spark derives no partition filter from a timestamp filter.
    """
    dated = column == "timestamp" and "log_date" in df.columns
    if start is not None:
        df = df.filter(F.col(column) >= instant(start))
        if dated:
            df = df.filter(F.col("log_date") >= F.to_date(instant(start)))
    if end is not None:
        df = df.filter(F.col(column) <= instant(end))
        if dated:
            df = df.filter(F.col("log_date") <= F.to_date(instant(end)))
    return df


def with_log_date(df: DataFrame) -> DataFrame:
    return df.withColumn("log_date", F.to_date("timestamp"))
