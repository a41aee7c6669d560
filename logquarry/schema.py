"""Table schemas shared by sources, operators and streams."""

from __future__ import annotations

from pyspark.sql import types as T

LOG_FIELDS = ("id", "timestamp", "level", "source", "message", "raw")
LEVELS = ("debug", "info", "warn", "error")
SEVERITIES = ("low", "medium", "high", "critical")
SYSTEM_LOG_ID = "system"

LOG = T.StructType(
    [
        T.StructField("id", T.StringType(), False),
        T.StructField("timestamp", T.TimestampType(), False),
        T.StructField("level", T.StringType(), False),
        T.StructField("source", T.StringType(), False),
        T.StructField("message", T.StringType(), False),
        T.StructField("raw", T.StringType()),
        T.StructField("log_date", T.DateType(), False),
    ]
)

ANOMALY = T.StructType(
    [
        T.StructField("log_id", T.StringType()),
        T.StructField("anomaly_type", T.StringType()),
        T.StructField("severity", T.StringType()),
        T.StructField("message", T.StringType()),
        T.StructField("details", T.StringType()),
    ]
)

ALERT = T.StructType(
    [
        T.StructField("id", T.StringType(), False),
        T.StructField("log_id", T.StringType(), False),
        T.StructField("severity", T.StringType(), False),
        T.StructField("message", T.StringType(), False),
        T.StructField("details", T.StringType()),
        T.StructField("created_at", T.TimestampType(), False),
        T.StructField("acknowledged", T.BooleanType(), False),
    ]
)

ACK = T.StructType([T.StructField("id", T.StringType(), False)])

INBOX = T.StructType(
    [
        T.StructField("id", T.LongType(), False),
        T.StructField("data", T.StringType(), False),
        T.StructField("created_at", T.TimestampType(), False),
    ]
)

PROCESSED = T.StructType(
    [
        T.StructField("id", T.LongType(), False),
        T.StructField("processed_at", T.TimestampType(), False),
    ]
)

DEAD_LETTER = T.StructType(
    [
        T.StructField("id", T.LongType(), False),
        T.StructField("content", T.StringType()),
        T.StructField("reason", T.StringType()),
        T.StructField("failed_at", T.TimestampType()),
    ]
)

# One row per detector per run, and one row per ingest or detection poll.
DETECTOR_RUN = T.StructType(
    [
        T.StructField("name", T.StringType(), False),
        T.StructField("enabled", T.BooleanType(), False),
        T.StructField("run_at", T.TimestampType()),
        T.StructField("anomalies", T.LongType(), False),
        T.StructField("error", T.StringType()),
    ]
)

POLL_RUN = T.StructType(
    [
        T.StructField("batch_id", T.LongType(), False),
        T.StructField("polled_at", T.TimestampType()),
        T.StructField("logs_processed", T.LongType(), False),
        T.StructField("alerts_created", T.LongType(), False),
    ]
)
