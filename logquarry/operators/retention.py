"""Which logs retention keeps and drops."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logquarry.functions.timerange import Instant, before, in_range


def cutoff(days: float = 30, as_of: Instant = None):
    if days <= 0:
        raise ValueError("days must be positive")
    return before(as_of, days=days)


def kept_logs(df: DataFrame, days: float = 30, as_of: Instant = None) -> DataFrame:
    """Logs not older than ``days`` (a log exactly at the cutoff stays)."""
    return in_range(df, cutoff(days, as_of))
