"""Rule detectors: error burst, volume spike, dominant source, error-rate threshold."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logquarry.functions.timerange import Instant, before, instant
from logquarry.operators import alerts as alert_ops
from logquarry.operators.detectors.base import system_anomaly
from logquarry.operators.detectors.cells import CellDetector, Interval
from logquarry.operators.stats import errors_per_minute

# Defaults of the rules.
ERRORS_PER_MINUTE = 10.0
WINDOW_MINUTES = 5
SPIKE_DEVIATIONS = 3.0
SPIKE_MIN_LOGS = 10
BASELINE_HOURS = 24.0
MIN_SOURCE_LOGS = 10
DOMINANT_SHARE = 0.8
DEDUP_HOURS = 1.0


def error_burst(
    logs: DataFrame,
    threshold: float = ERRORS_PER_MINUTE,
    window_minutes: float = WINDOW_MINUTES,
    as_of: Instant = None,
) -> DataFrame:
    """One row when the errors per minute of the last minutes exceed the threshold."""
    return ErrorBurst(threshold, window_minutes).detect(logs, as_of)


def _burst(cells: DataFrame, threshold: float, window_minutes: float) -> DataFrame:
    burst = (
        cells.agg(
            F.coalesce(F.sum("errors"), F.lit(0)).alias("error_count"),
            F.coalesce(F.sum("count"), F.lit(0)).alias("total_count"),
        )
        .select(
            "error_count",
            "total_count",
            (F.col("error_count") / F.lit(float(window_minutes))).alias("errors_per_minute"),
            F.lit(float(threshold)).alias("threshold"),
            F.lit(window_minutes).alias("window_minutes"),
        )
        .filter((F.col("total_count") > 0) & (F.col("errors_per_minute") > threshold))
    )
    message = F.format_string(
        f"High error rate detected: %.2f errors/minute (%d errors in {window_minutes} minutes)",
        "errors_per_minute",
        "error_count",
    )
    return system_anomaly(burst, "error_burst", "high", message, burst.columns)


def volume_spike(
    logs: DataFrame,
    std_threshold: float = SPIKE_DEVIATIONS,
    baseline_hours: float | None = None,
    as_of: Instant = None,
) -> DataFrame:
    """One row when the current hour's volume is far above the mean of all hours.

    The current hour belongs to the baseline. ``baseline_hours`` limits the logs looked at; by
    default all given logs up to ``as_of`` count.
    """
    return VolumeSpike(std_threshold, baseline_hours).detect(logs, as_of)


def _spike(cells: DataFrame, std_threshold: float, as_of: Instant) -> DataFrame:
    this_hour = F.col("hour") == F.date_trunc("hour", instant(as_of))
    spike = (
        cells.groupBy("hour")
        .agg(F.sum("count").alias("count"))
        .agg(
            F.sum("count").alias("logs"),
            F.count(F.lit(1)).alias("hours"),
            F.coalesce(F.max(F.when(this_hour, F.col("count"))), F.lit(0)).alias("current_count"),
            F.avg("count").alias("mean_count"),
            F.stddev_samp("count").alias("std_count"),
        )
        .filter((F.col("logs") >= SPIKE_MIN_LOGS) & (F.col("hours") >= 2) & (F.col("std_count") > 0))
        .select(
            "current_count",
            "mean_count",
            "std_count",
            ((F.col("current_count") - F.col("mean_count")) / F.col("std_count")).alias("z_score"),
            F.lit(float(std_threshold)).alias("threshold"),
        )
        .filter(F.col("z_score") > std_threshold)
    )
    message = F.format_string(
        "Log volume spike detected: %d logs this hour (%.2f standard deviations above mean)",
        "current_count",
        "z_score",
    )
    return system_anomaly(spike, "volume_spike", "medium", message, spike.columns)


def source_anomaly(logs: DataFrame, min_logs: int = MIN_SOURCE_LOGS) -> DataFrame:
    """The source that accounts for more than 80 % of the logs.

    At most one source can exceed that share, so it is the largest one: total and largest come
    from one more partial aggregation, with no window over all sources.
    """
    return SourceAnomaly(min_logs).detect(logs)


def _dominant(cells: DataFrame, min_logs: int) -> DataFrame:
    largest = F.max(F.struct("count", "source"))
    dominant = (
        cells.groupBy("source")
        .agg(F.sum("count").alias("count"))
        .agg(F.sum("count").alias("total_logs"), largest.alias("top"))
        .select(
            F.col("top.source").alias("source"),
            F.col("top.count").alias("count"),
            (F.col("top.count") / F.col("total_logs")).alias("ratio"),
            "total_logs",
        )
        .filter((F.col("count") >= min_logs) & (F.col("ratio") > DOMINANT_SHARE))
    )
    message = F.format_string(
        "Unusual source distribution: '%s' accounts for %.1f%% of logs", "source", F.col("ratio") * 100
    )
    return system_anomaly(dominant, "source_anomaly", "low", message, dominant.columns)


def error_rate_rule(
    logs: DataFrame,
    threshold: float = ERRORS_PER_MINUTE,
    window_minutes: float = WINDOW_MINUTES,
    as_of: Instant = None,
) -> DataFrame:
    """The alert service's own threshold rule; no row when the window is not positive."""
    usable = window_minutes > 0
    window = window_minutes if usable else 1
    rate = (
        errors_per_minute(logs, window, as_of)
        .filter(F.lit(usable) & (F.col("errors_per_minute") > threshold))
        .select(
            F.col("error_count").alias("errorCount"),
            F.col("errors_per_minute").alias("errorsPerMinute"),
            F.lit(window).alias("windowMinutes"),
            F.lit(float(threshold)).alias("threshold"),
            F.lit("error_rate").alias("type"),
        )
    )
    message = F.format_string(
        f"High error rate detected: %.2f errors/minute (%d errors in {window} minutes)",
        "errorsPerMinute",
        "errorCount",
    )
    return system_anomaly(rate, "error_rate", "high", message, rate.columns)


def error_rate_alerts(
    logs: DataFrame,
    alerts: DataFrame,
    threshold: float = ERRORS_PER_MINUTE,
    window_minutes: float = WINDOW_MINUTES,
    dedup_hours: float = DEDUP_HOURS,
    as_of: Instant = None,
) -> DataFrame:
    """The rule's alert, unless an open alert of the same type exists within the look-back.

    The type inside the details is the key: the message carries changing numbers.
    """
    kind = F.get_json_object("details", "$.type")
    same = alert_ops.open_since(alerts, dedup_hours, as_of).select("severity", kind.alias("kind")).distinct()
    found = error_rate_rule(logs, threshold, window_minutes, as_of).withColumn("kind", F.col("anomaly_type"))
    return alert_ops.new_alerts(found.join(same, ["severity", "kind"], "left_anti").drop("kind"), as_of)


class ErrorBurst(CellDetector):
    """Looks at the given logs, or, with ``history``, at the stored ones.

    A burst may be spread over several micro-batches; ``history`` supplies the whole window.
    """

    def __init__(
        self,
        threshold: float = ERRORS_PER_MINUTE,
        window_minutes: float = WINDOW_MINUTES,
        history: Callable[[], DataFrame] | None = None,
    ) -> None:
        super().__init__("error_burst")
        self.threshold = threshold
        self.window_minutes = window_minutes
        self.history = history

    def interval(self, as_of: Instant = None) -> Interval:
        return before(as_of, minutes=self.window_minutes), instant(as_of)

    def detect_cells(self, cells: DataFrame, as_of: Instant = None) -> DataFrame:
        return _burst(cells, self.threshold, self.window_minutes)


class VolumeSpike(CellDetector):
    """Looks at the given logs, or, with ``history``, at the last hours of the stored ones.

    A micro-batch rarely spans the hours a baseline needs; ``history`` (for example the ``scan``
    of a log table) is called on every run and supplies them.
    """

    def __init__(
        self,
        std_threshold: float = SPIKE_DEVIATIONS,
        baseline_hours: float | None = None,
        history: Callable[[], DataFrame] | None = None,
    ) -> None:
        super().__init__("volume_spike")
        self.std_threshold = std_threshold
        self.baseline_hours = BASELINE_HOURS if history and baseline_hours is None else baseline_hours
        self.history = history

    def interval(self, as_of: Instant = None) -> Interval:
        since = None if self.baseline_hours is None else before(as_of, hours=self.baseline_hours)
        return since, instant(as_of)

    def detect_cells(self, cells: DataFrame, as_of: Instant = None) -> DataFrame:
        return _spike(cells, self.std_threshold, as_of)


class SourceAnomaly(CellDetector):
    """Looks at the given logs, or, with ``history``, at the stored ones it supplies."""

    def __init__(self, min_logs: int = MIN_SOURCE_LOGS, history: Callable[[], DataFrame] | None = None) -> None:
        super().__init__("source_anomaly")
        self.min_logs = min_logs
        self.history = history

    def detect_cells(self, cells: DataFrame, as_of: Instant = None) -> DataFrame:
        return _dominant(cells, self.min_logs)
