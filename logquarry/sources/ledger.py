"""The ids a log table holds, bucketed by id, so that a batch meets them bucket by bucket."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logquarry.sources.files import create_marker, delete_folder, exists, folder_names

LEDGER = T.StructType([T.StructField("id", T.StringType()), T.StructField("timestamp", T.TimestampType())])


class IdLedger:
    """(id, timestamp) of all stored logs as a Parquet table bucketed by id.

    A batch is dealt by the same hash into as many partitions, so a join reads every bucket where it lies:
    the stored side is never shuffled. The number of buckets is that of ``spark.sql.shuffle.partitions``
    when the ledger is made, and kept in the name of its folder.

    Logs and ledger are two commits. A marker is set before the first and removed after the second; who
    finds one, or finds logs without a ledger, makes the ledger anew from the logs. One writer at a time
    is assumed.
    """

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark = spark
        self.path = path.rstrip("/")
        self._marker = f"{self.path}/unfinished"

    def _current(self) -> tuple[int, int] | None:
        """(version, buckets) of the newest complete ledger."""
        found = []
        for name in folder_names(self.spark, self.path):
            if name.startswith("v") and exists(self.spark, f"{self.path}/{name}/_SUCCESS"):
                version, buckets = name[1:].split("-")
                found.append((int(version), int(buckets)))
        return max(found, default=None)

    @property
    def buckets(self) -> int:
        current = self._current()
        return current[1] if current else int(self.spark.conf.get("spark.sql.shuffle.partitions"))

    def is_sound(self) -> bool:
        return self._current() is not None and not exists(self.spark, self._marker)

    def begin(self) -> None:
        """Call before the log table changes."""
        create_marker(self.spark, self._marker)

    def finish(self) -> None:
        """Call when logs and ledger agree again."""
        delete_folder(self.spark, self._marker)

    def ids(self) -> DataFrame:
        """(id, timestamp), read bucket by bucket."""
        current = self._current()
        return self.spark.table(self._table(*current)) if current else self.spark.createDataFrame([], LEDGER)

    def dealt(self, rows: DataFrame) -> DataFrame:
        """``rows`` in the partitions of the buckets."""
        return rows.repartition(self.buckets, "id")

    def add(self, rows: DataFrame) -> None:
        """Append the ids of stored rows; a file per bucket."""
        current = self._current()
        if current is None:
            self.rebuild(rows)
        else:
            self._write(self.dealt(rows), *current, "append")

    def rebuild(self, rows: DataFrame, buckets: int | None = None) -> None:
        """Make ``rows`` the whole ledger. They may come from the ledger itself."""
        current = self._current()
        version = current[0] + 1 if current else 0
        n = buckets or self.buckets
        delete_folder(self.spark, self._folder(version, n))  # left by a run that stopped
        self._write(rows.repartition(n, "id"), version, n, "overwrite")
        for name in folder_names(self.spark, self.path):
            if name.startswith("v") and name != f"v{version}-{n}":
                delete_folder(self.spark, f"{self.path}/{name}")

    def keep_from(self, boundary: F.Column) -> None:
        """Forget the ids of logs before ``boundary``, and join the small files of many batches."""
        if self._current() is not None:
            self.rebuild(self.ids().filter(F.col("timestamp").isNull() | (F.col("timestamp") >= boundary)))

    def _folder(self, version: int, buckets: int) -> str:
        return f"{self.path}/v{version}-{buckets}"

    def _name(self, version: int, buckets: int) -> str:
        return "ledger_" + hashlib.sha256(self._folder(version, buckets).encode()).hexdigest()[:24]

    def _table(self, version: int, buckets: int) -> str:
        """Name of the table in the session's catalog; a new session enters it again."""
        name = self._name(version, buckets)
        if not self.spark.catalog.tableExists(name):
            self.spark.sql(
                f"CREATE TABLE {name} (id STRING, timestamp TIMESTAMP) USING parquet "
                f"CLUSTERED BY (id) INTO {buckets} BUCKETS LOCATION '{self._folder(version, buckets)}'"
            )
        return name

    def _write(self, dealt: DataFrame, version: int, buckets: int, mode: str) -> None:
        if mode == "append":
            self._table(version, buckets)
        (
            dealt.select("id", "timestamp")
            .write.mode(mode)
            .bucketBy(buckets, "id")
            .option("path", self._folder(version, buckets))
            .format("parquet")
            .saveAsTable(self._name(version, buckets))
        )
