"""Text lines from log files, in batch and as a stream.

A file source sees whole files: a shipper moves closed files into the folder. ``\\r\\n`` endings
are stripped and blank lines are kept. Files may be split between tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _numbered(lines: DataFrame) -> DataFrame:
    """Add the file path and ``seq``, a unique number that follows the line order.

    The number is taken right at the scan: a repeated task reads the same split in the same
    order and numbers its lines as before.
    """
    return lines.select(
        "value",
        F.col("_metadata.file_path").alias("path"),
        F.monotonically_increasing_id().alias("seq"),
    )


def read_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(value, path, seq) of all text files at ``path``."""
    return _numbered(spark.read.text(path))


def stream_lines(spark: SparkSession, folder: str, max_files: int = 100) -> DataFrame:
    """(value, path) of new text files in ``folder``, at most ``max_files`` per micro-batch."""
    lines = spark.readStream.option("maxFilesPerTrigger", max_files).text(folder)
    return lines.select("value", F.col("_metadata.file_path").alias("path"))
