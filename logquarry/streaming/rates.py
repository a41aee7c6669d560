"""Sliding error rate and hourly volume over event time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from logquarry.operators.detectors.rules import WINDOW_MINUTES
from logquarry.sources.rollup import Rollup
from logquarry.streaming.ingest import RULE_INTERVAL, batch_folder, trigger

# How late a log may arrive and still be counted: None has no bound, like a batch run. The state is
# then one row per window of the time covered, whatever the number of logs.
LATENESS: str | None = None


def error_rate_windows(
    logs: DataFrame,
    window_minutes: int = WINDOW_MINUTES,
    slide_minutes: int = 1,
    lateness: str | None = LATENESS,
) -> DataFrame:
    """(window_start, window_end, total_count, error_count, errors_per_minute) per sliding window.

    Works on a stream and on a batch. With ``lateness`` as watermark a stream forgets old windows, and
    Spark drops later rows (``numRowsDroppedByWatermark`` of its progress). Each row belongs to
    several windows; partial aggregation folds them into one row per window and task before the
    shuffle.
    """
    if logs.isStreaming and lateness is not None:
        logs = logs.withWatermark("timestamp", lateness)
    span = F.window("timestamp", f"{window_minutes} minutes", f"{slide_minutes} minutes")
    return (
        logs.groupBy(span.alias("span"))
        .agg(
            F.count(F.lit(1)).alias("total_count"),
            F.count_if(F.lower("level") == "error").alias("error_count"),
        )
        .select(
            F.col("span.start").alias("window_start"),
            F.col("span.end").alias("window_end"),
            "total_count",
            "error_count",
            (F.col("error_count") / F.lit(float(window_minutes))).alias("errors_per_minute"),
        )
    )


def hourly_volume(logs: DataFrame, lateness: str | None = LATENESS) -> DataFrame:
    """(hour, count) per clock hour, on a stream or a batch; ``lateness`` as in error_rate_windows."""
    if logs.isStreaming and lateness is not None:
        logs = logs.withWatermark("timestamp", lateness)
    return (
        logs.groupBy(F.window("timestamp", "1 hour").alias("span"))
        .agg(F.count(F.lit(1)).alias("count"))
        .select(F.col("span.start").alias("hour"), "count")
    )


def start_updates(
    windows: DataFrame,
    path: str,
    checkpoint: str,
    name: str,
    interval: str | None = RULE_INTERVAL,
) -> StreamingQuery:
    """Write the windows that changed in each micro-batch; a replay replaces its own folder.

    The folder belongs to one checkpoint: a new one counts from scratch and needs a new folder.
    """

    def store(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(batch_folder(path, checkpoint, batch_id))

    return (
        windows.writeStream.queryName(name)
        .outputMode("update")
        .foreachBatch(store)
        .option("checkpointLocation", checkpoint)
        .trigger(**trigger(interval))
        .start()
    )


def start_rollup(
    logs: DataFrame, rollup: Rollup, checkpoint: str, name: str = "rollup", interval: str | None = RULE_INTERVAL
) -> StreamingQuery:
    """Keep up a rollup from streamed logs: bounded work per micro-batch, no state, no row too late."""

    def store(batch: DataFrame, batch_id: int) -> None:
        rollup.add(batch, checkpoint, batch_id)

    return (
        logs.writeStream.queryName(name)
        .foreachBatch(store)
        .option("checkpointLocation", checkpoint)
        .trigger(**trigger(interval))
        .start()
    )


def windows_of_minutes(
    cells: DataFrame, window_minutes: int = WINDOW_MINUTES, slide_minutes: int = 1
) -> DataFrame:
    """The rows of ``error_rate_windows`` from a rollup by minute and level.

    Windows begin on whole minutes, so a minute lies inside a window as a whole or not at all. Minutes,
    not logs, are put into their several windows.
    """
    span = F.window("start", f"{window_minutes} minutes", f"{slide_minutes} minutes")
    errors = F.when(F.lower("level") == "error", F.col("count")).otherwise(0)
    return (
        cells.groupBy(span.alias("span"))
        .agg(F.sum("count").alias("total_count"), F.sum(errors).alias("error_count"))
        .select(
            F.col("span.start").alias("window_start"),
            F.col("span.end").alias("window_end"),
            "total_count",
            "error_count",
            (F.col("error_count") / F.lit(float(window_minutes))).alias("errors_per_minute"),
        )
    )


def latest(spark: SparkSession, path: str, key: str) -> DataFrame:
    """Current value of every window: the row of its last micro-batch."""
    updates = spark.read.parquet(path).drop("stream")
    values = [c for c in updates.columns if c not in (key, "batch_id")]
    newest = updates.groupBy(key).agg(F.max_by(F.struct(*values), "batch_id").alias("row"))
    return newest.select(key, *[F.col(f"row.{c}").alias(c) for c in values])


def volume_against_baseline(hours: DataFrame, baseline: DataFrame) -> DataFrame:
    """Add the z-score of each hour against one-row baseline statistics (mean, std)."""
    stats = baseline.select("mean", "std")
    return hours.select(
        "*",
        stats.select("mean").scalar().alias("mean_count"),
        stats.select("std").scalar().alias("std_count"),
    ).withColumn(
        "z_score",
        F.when(F.col("std_count") > 0, (F.col("count") - F.col("mean_count")) / F.col("std_count")),
    )
