"""Counts that several detectors share: one aggregation of the logs instead of one scan each."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logquarry.functions.timerange import Instant
from logquarry.operators.detectors.base import Detector

# (from, until), both inclusive; None is no bound. ``ALL`` includes logs without a time.
Interval = tuple[Column | None, Column | None] | None
ALL: Interval = None
CELL = ("hour", "source", "count", "errors")


class CellDetector(Detector):
    """A detector that needs counts per hour and source within one interval of time only.

    Subclasses say which interval and turn its cells (hour, source, count, errors) into anomalies; a cell
    may come in several rows, which add up. ``history`` names the logs to look at instead of the given ones.
    """

    history = None

    def interval(self, as_of: Instant = None) -> Interval:
        return ALL

    def detect_cells(self, cells: DataFrame, as_of: Instant = None) -> DataFrame:
        raise NotImplementedError

    def detect(self, logs: DataFrame, as_of: Instant = None) -> DataFrame:
        given = self.history() if self.history else logs
        return self.detect_cells(cells_in(count_cells(given, [self.interval(as_of)]), 0), as_of)


def _inside(interval: Interval, dated: bool = False) -> Column:
    """Whether a log lies in the interval; with ``dated`` also in its days, which prunes partitions."""
    if interval is None:
        return F.lit(True)
    since, until = interval
    inside = F.col("timestamp").isNotNull()
    if since is not None:
        inside = inside & (F.col("timestamp") >= since)
        if dated:
            inside = inside & (F.col("log_date") >= F.to_date(since))
    if until is not None:
        inside = inside & (F.col("timestamp") <= until)
        if dated:
            inside = inside & (F.col("log_date") <= F.to_date(until))
    return inside


def count_cells(logs: DataFrame, intervals: list[Interval]) -> DataFrame:
    """(hour, source, inside, count, errors): ``inside`` says which of the intervals hold the logs of a row.

    Counts are mergeable, so partial aggregation leaves one row per cell and task before the shuffle,
    whatever the number of logs of a source. Logs in none of the intervals are left out where they are read.
    """
    inside = [_inside(interval) for interval in intervals]
    wanted = reduce(Column.__or__, [_inside(interval, "log_date" in logs.columns) for interval in intervals])
    return (
        logs.filter(wanted)
        .groupBy(
            F.date_trunc("hour", "timestamp").alias("hour"),
            "source",
            F.array(*[F.coalesce(x, F.lit(False)) for x in inside]).alias("inside"),
        )
        .agg(F.count(F.lit(1)).alias("count"), F.count_if(F.lower("level") == "error").alias("errors"))
    )


def cells_in(counted: DataFrame, i: int) -> DataFrame:
    """(hour, source, count, errors) of interval ``i``."""
    return counted.filter(F.col("inside")[i]).select(*CELL)
