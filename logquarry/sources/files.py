"""Parquet folders as tables: missing ones read as empty, and versioned ones can be replaced."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

VERSION = T.StructType([T.StructField("version", T.LongType(), False)])


def read_or_empty(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The Parquet table at ``path``, or no rows when nothing was written yet."""
    if not exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(path)


def _hadoop_path(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target


def exists(spark: SparkSession, path: str) -> bool:
    files, target = _hadoop_path(spark, path)
    return files.exists(target)


def delete_folder(spark: SparkSession, path: str) -> None:
    """Delete a table folder or partition through the Hadoop file system."""
    files, target = _hadoop_path(spark, path)
    files.delete(target, True)


def folder_names(spark: SparkSession, path: str) -> list[str]:
    """Names of what lies in a folder, none when it does not exist."""
    files, target = _hadoop_path(spark, path)
    return [entry.getPath().getName() for entry in files.listStatus(target)] if files.exists(target) else []


def create_marker(spark: SparkSession, path: str) -> None:
    """An empty file."""
    files, target = _hadoop_path(spark, path)
    files.create(target, True).close()


class VersionedTable:
    """A table that can be appended to and replaced as a whole.

    Rows live in ``<path>/v<n>``; the small table ``<path>/versions`` lists the versions, and the
    highest one is current. A replacement is written beside the current version and becomes
    visible with one append to the list, so readers never see a half-written table. One writer
    at a time is assumed.
    """

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType) -> None:
        self.spark = spark
        self.path = path.rstrip("/")
        self.schema = schema

    def version(self) -> int:
        listed = read_or_empty(self.spark, f"{self.path}/versions", VERSION)
        return listed.agg(F.coalesce(F.max("version"), F.lit(0))).first()[0]

    def _folder(self, version: int) -> str:
        return f"{self.path}/v{version}"

    def read(self) -> DataFrame:
        return read_or_empty(self.spark, self._folder(self.version()), self.schema)

    def append(self, rows: DataFrame) -> None:
        rows.select(*self.schema.fieldNames()).write.mode("append").parquet(
            self._folder(self.version())
        )

    def replace(self, rows: DataFrame) -> None:
        """Make ``rows`` (which may read the current version) the whole table."""
        successor = self.version() + 1
        rows.select(*self.schema.fieldNames()).write.mode("overwrite").parquet(
            self._folder(successor)
        )
        self.spark.createDataFrame([(successor,)], VERSION).coalesce(1).write.mode("append").parquet(
            f"{self.path}/versions"
        )
