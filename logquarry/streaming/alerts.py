"""New logs to alerts, micro-batch by micro-batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from logquarry.functions.timerange import Instant
from logquarry.operators.detectors.base import Detector
from logquarry.operators.detectors.registry import alerts_from, run_detectors
from logquarry.operators.detectors.rules import DEDUP_HOURS
from logquarry.schema import POLL_RUN
from logquarry.session import materialise
from logquarry.sources.alerts import AlertTable
from logquarry.streaming.ingest import DETECT_INTERVAL, batch_folder, trigger

POLLED_AT = "_polled_at"


def start_detection(
    logs: DataFrame,
    detectors: list[Detector],
    alerts: AlertTable,
    runs: str,
    checkpoint: str,
    interval: str | None = DETECT_INTERVAL,
    dedup_hours: float = DEDUP_HOURS,
    as_of: Instant = None,
) -> StreamingQuery:
    """Run the detectors on each micro-batch of logs and store what is new.

    The position is the stream's checkpoint, saved after the alerts are written: a micro-batch
    may run again. Its instant is a column of the stream, which a repeated batch gets again, so its
    alerts have the same ids and are found among the stored ones. What the stream has to remember for
    the look-back is the open alerts of ``dedup_hours``; they are read from the alert table's newest days,
    so a restart, or another checkpoint, finds them too. Run records go to ``<runs>/detectors`` and
    ``<runs>/polls``.
    """

    def poll(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        stamped = batch.persist()
        seen, polled = stamped.agg(F.count(F.lit(1)), F.max(POLLED_AT).cast("string")).first()
        batch = stamped.drop(POLLED_AT)
        if seen:
            # One instant for the whole poll, so that its alerts agree on it.
            now = as_of if as_of is not None else polled
            findings = run_detectors(batch, detectors, now)
            # Only the days of the look-back are read, however many alerts are stored.
            known = alerts.open_since(dedup_hours, now)
            new = materialise(alerts_from(findings, known, dedup_hours, now))
            created = alerts.append(new).count()
            findings.runs_frame(spark).coalesce(1).write.mode("overwrite").parquet(
                batch_folder(f"{runs}/detectors", checkpoint, batch_id)
            )
            record = spark.range(1).select(
                F.lit(seen).cast("long").alias("logs_processed"),
                F.lit(created).cast("long").alias("alerts_created"),
                F.current_timestamp().alias("polled_at"),
            )
            record.coalesce(1).write.mode("overwrite").parquet(
                batch_folder(f"{runs}/polls", checkpoint, batch_id)
            )
        stamped.unpersist()

    return (
        logs.withColumn(POLLED_AT, F.current_timestamp())
        .writeStream.queryName("detection")
        .foreachBatch(poll)
        .option("checkpointLocation", checkpoint)
        .trigger(**trigger(interval))
        .start()
    )


def poll_runs(spark: SparkSession, runs: str) -> DataFrame:
    """Run records of all polls."""
    return spark.read.parquet(f"{runs}/polls").select(*[
        F.col(f.name).cast(f.dataType) for f in POLL_RUN.fields
    ])


def detector_runs(spark: SparkSession, runs: str) -> DataFrame:
    """Run records of all detectors."""
    return spark.read.parquet(f"{runs}/detectors").drop("stream", "batch_id")
