"""Counts and summaries over logs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from logquarry.functions.timerange import Instant, before, in_range, instant
from logquarry.schema import LEVELS

# Look-back bounds of the statistics, and how many sources they list.
MIN_HOURS, MAX_HOURS = 1, 8760
TOP_SOURCES = 100
BUSIEST_SOURCES = 5


def count_by(df: DataFrame, column: str, since: Instant = None, until: Instant = None) -> DataFrame:
    """Rows per value of ``column`` from ``since`` to ``until``, both inclusive."""
    return in_range(df, since, until).groupBy(column).agg(F.count(F.lit(1)).alias("count"))


def count_by_level(df: DataFrame, since: Instant = None) -> DataFrame:
    return count_by(df, "level", since)


def count_by_source(df: DataFrame, since: Instant = None) -> DataFrame:
    return count_by(df, "source", since)


def total_count(df: DataFrame, since: Instant = None, until: Instant = None) -> DataFrame:
    return in_range(df, since, until).agg(F.count(F.lit(1)).alias("count"))


def error_count(df: DataFrame, since: Instant, level: str = "error", until: Instant = None) -> DataFrame:
    return total_count(df.filter(F.col("level") == level), since, until)


def errors_per_minute(df: DataFrame, window_minutes: float, as_of: Instant = None) -> DataFrame:
    """Error count of the minutes before ``as_of`` and its rate."""
    counted = error_count(df, before(as_of, minutes=window_minutes), until=instant(as_of))
    return counted.select(
        F.col("count").alias("error_count"),
        (F.col("count") / F.lit(float(window_minutes))).alias("errors_per_minute"),
    )


def top_sources(df: DataFrame, n: int = TOP_SOURCES, since: Instant = None) -> DataFrame:
    """Sources with the most logs; equal counts are ordered by name."""
    return count_by_source(df, since).orderBy(F.desc("count"), "source").limit(n)


def log_stats(df: DataFrame, hours: float = 24, as_of: Instant = None, sources: int = TOP_SOURCES) -> DataFrame:
    """Total, count per level and the busiest ``sources`` of the last ``hours``, as rows
    (section, name, count).

    The logs are read and shuffled once, on (level, source); the three sections are rolled up
    from those counts, and Spark reuses the one exchange for all of them.
    """
    if not MIN_HOURS <= hours <= MAX_HOURS:
        raise ValueError(f"hours must be from {MIN_HOURS} to {MAX_HOURS}")
    cells = (
        in_range(df, before(as_of, hours=hours), instant(as_of))
        .groupBy("level", "source")
        .agg(F.count(F.lit(1)).alias("count"))
    )
    total = cells.agg(F.coalesce(F.sum("count"), F.lit(0)).alias("count")).select(
        F.lit("total").alias("section"), F.lit("all").alias("name"), "count"
    )
    per_level = (
        cells.groupBy("level")
        .agg(F.sum("count").alias("count"))
        .select(F.lit("level").alias("section"), F.col("level").alias("name"), "count")
    )
    per_source = (
        cells.groupBy("source")
        .agg(F.sum("count").alias("count"))
        .orderBy(F.desc("count"), "source")
        .limit(sources)
        .select(F.lit("source").alias("section"), F.col("source").alias("name"), "count")
    )
    return reduce(DataFrame.unionByName, [total, per_level, per_source])


def stats_record(stats: DataFrame) -> DataFrame:
    """``log_stats`` rows as one record (total, byLevel, bySource): at most a hundred-odd entries."""

    def section(name: str):
        entry = F.when(F.col("section") == name, F.struct("name", "count"))
        return F.map_from_entries(F.sort_array(F.collect_list(entry)))

    return stats.agg(
        F.max(F.when(F.col("section") == "total", F.col("count"))).alias("total"),
        section("level").alias("byLevel"),
        section("source").alias("bySource"),
    )


def hourly_counts(df: DataFrame) -> DataFrame:
    """Logs per clock hour; hours without logs are absent, unparsable timestamps are skipped."""
    return (
        df.filter(F.col("timestamp").isNotNull())
        .groupBy(F.date_trunc("hour", "timestamp").alias("hour"))
        .agg(F.count(F.lit(1)).alias("count"))
    )


def volume_stats(df: DataFrame, hours: float = 24.0, as_of: Instant = None) -> DataFrame:
    """Mean, sample deviation, maximum and minimum of the hourly counts; zeros without logs."""
    return _volume(hourly_counts(in_range(df, before(as_of, hours=hours), instant(as_of))))


def _volume(counts: DataFrame) -> DataFrame:
    return counts.agg(
        F.coalesce(F.avg("count"), F.lit(0.0)).alias("mean"),
        F.coalesce(F.stddev_samp("count"), F.lit(0.0)).alias("std"),
        F.coalesce(F.max("count"), F.lit(0)).alias("max"),
        F.coalesce(F.min("count"), F.lit(0)).alias("min"),
    )


def rolled_cells(cells: DataFrame, logs: DataFrame, since: Instant, until: Instant = None) -> DataFrame:
    """(start, keys..., count) per hour from ``since`` to ``until``, both inclusive, out of an hourly rollup.

    Hours that lie inside as a whole are read from ``cells`` (start, keys..., count). Only the logs of the
    hour at either end are read.
    """
    since, until = instant(since), instant(until)
    floor = F.date_trunc("hour", since)
    first = F.when(floor == since, since).otherwise(floor + F.expr("INTERVAL 1 HOUR"))
    last = F.date_trunc("hour", until)
    whole = cells.filter((F.col("start") >= first) & (F.col("start") < last))
    at_ends = in_range(logs, since, until).filter((F.col("timestamp") < first) | (F.col("timestamp") >= last))
    keys = [c for c in cells.columns if c not in ("start", "count")]
    ends = at_ends.groupBy(F.date_trunc("hour", "timestamp").alias("start"), *keys).agg(F.count(F.lit(1)).alias("count"))
    return whole.select("start", *keys, "count").unionByName(ends)


def count_by_rolled(
    cells: DataFrame, logs: DataFrame, column: str, since: Instant, until: Instant = None
) -> DataFrame:
    """``count_by`` out of an hourly rollup."""
    return rolled_cells(cells, logs, since, until).groupBy(column).agg(F.sum("count").alias("count"))


def volume_stats_rolled(cells: DataFrame, logs: DataFrame, hours: float = 24.0, as_of: Instant = None) -> DataFrame:
    """``volume_stats`` out of an hourly rollup."""
    found = rolled_cells(cells, logs, before(as_of, hours=hours), instant(as_of))
    return _volume(found.groupBy("start").agg(F.sum("count").alias("count")))


def level_cards(df: DataFrame, since: Instant = None) -> DataFrame:
    """Counts of the four levels in fixed order, zero when absent; one row per level."""
    counts = [F.count_if(F.col("level") == level).alias(level) for level in LEVELS]
    entries = F.array(
        *[
            F.struct(F.lit(i).alias("position"), F.lit(level).alias("level"), F.col(level).alias("count"))
            for i, level in enumerate(LEVELS)
        ]
    )
    return in_range(df, since).agg(*counts).select(F.inline(entries))


def error_rate_pct(df: DataFrame, since: Instant = None) -> DataFrame:
    """Share of error logs in percent, rounded half up; 0 without logs."""
    counts = in_range(df, since).agg(
        F.count(F.lit(1)).alias("total"), F.count_if(F.col("level") == "error").alias("errors")
    )
    share = F.floor(F.col("errors") / F.col("total") * 100 + 0.5)
    return counts.select("total", "errors", F.when(F.col("total") > 0, share).otherwise(0).alias("error_rate_pct"))


def scaled_series(series: DataFrame, value: str = "count") -> DataFrame:
    """Add the share of the largest value and the bar height in percent (at least 12).

    ``series`` is what one chart shows (levels, or the busiest sources): a handful of rows, so
    the window over all of them is bounded by construction.
    """
    top = F.greatest(F.max(value).over(Window.partitionBy()), F.lit(1))
    share = F.col(value) / top
    return series.select(
        "*", share.alias("scaled"), F.greatest(share * 100, F.lit(12.0)).alias("bar_height")
    )
