import sys
from datetime import datetime, timedelta, timezone
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from logquarry.session import configure

NOW = datetime(2026, 3, 1, 12, 30, tzinfo=timezone.utc)
LOGS = "id string, at string, level string, source string, message string, raw string"


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[4]")
        .appName("logquarry-tests")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "4g")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield configure(session)
    session.stop()


def ago(**amount) -> str:
    """A time before NOW as text."""
    return (NOW - timedelta(**amount)).replace(tzinfo=None).isoformat(sep=" ")


@pytest.fixture
def make_logs(spark):
    """Logs from (id, time text, level, source, message) rows."""

    def make(rows):
        df = spark.createDataFrame([(*row, None) for row in rows], LOGS)
        return df.withColumn("timestamp", F.col("at").cast("timestamp")).drop("at")

    return make


@pytest.fixture
def mixed_logs(make_logs):
    """Fifty logs, one a minute; every fifth is an error, every third comes from app."""
    return make_logs(
        [
            (
                f"log-{i}",
                ago(minutes=i),
                "error" if i % 5 == 0 else "info",
                "app" if i % 3 == 0 else "api",
                f"Test log message {i}",
            )
            for i in range(50)
        ]
    )


@pytest.fixture
def error_logs(make_logs):
    """Twenty errors within the last minutes."""
    return make_logs(
        [(f"err-{i}", ago(seconds=10 * i), "error", "app", f"Error occurred: exception type {i}") for i in range(20)]
    )
