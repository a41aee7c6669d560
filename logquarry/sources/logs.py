"""The log table: Parquet partitioned by day."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logquarry.functions import text
from logquarry.functions.timerange import Instant, with_log_date
from logquarry.operators.conflicts import append_conflicts, new_rows
from logquarry.operators.retention import cutoff
from logquarry.operators.search import TOKEN_LINES
from logquarry.schema import LOG
from logquarry.sources.files import delete_folder, exists, folder_names, read_or_empty
from logquarry.sources.ledger import IdLedger

FILE_OPTIONS = {
    "parquet.bloom.filter.enabled#id": "true",
    "parquet.bloom.filter.adaptive.enabled": "true",
}


class DuplicateIds(ValueError):
    """A batch repeats an id or holds one that is already stored."""


class LogTable:
    """Logs by ``log_date``; files are sorted by time and carry a bloom filter on the id.

    The date folder and the timestamp statistics serve time ranges, the bloom filter serves
    look-ups by id. With ``token_lines`` the search tokens of message and source are stored as
    well, so that a phrase search is a substring test; they are computed by the same write that
    stores the log and are never out of step with it. The stored ids are kept in a ledger beside the
    logs, which appends look into instead of the logs. One writer at a time is assumed.
    """

    def __init__(self, spark: SparkSession, path: str, token_lines: bool = False) -> None:
        self.spark = spark
        self.path = path.rstrip("/")
        self.ledger = IdLedger(spark, f"{self.path}/_ids")
        stored = TOKEN_LINES.values() if token_lines else ()
        self.schema = T.StructType([*LOG.fields, *[T.StructField(name, T.StringType()) for name in stored]])

    def scan(self) -> DataFrame:
        return read_or_empty(self.spark, self.path, self.schema)

    def _prepared(self, logs: DataFrame) -> DataFrame:
        rows = with_log_date(logs)
        for column, stored in TOKEN_LINES.items():
            if stored in self.schema.fieldNames():
                rows = rows.withColumn(stored, text.token_line(F.col(column)))
        return rows.select(*self.schema.fieldNames())

    def _write(self, rows: DataFrame, path: str, mode: str) -> None:
        # Rows are brought together by day to keep files large; adaptive execution splits the busy
        # days again, so a day with a third of the rows does not end up in one task.
        (
            rows.hint("rebalance", F.col("log_date"))
            .sortWithinPartitions("log_date", "timestamp")
            .write.mode(mode)
            .options(**FILE_OPTIONS)
            .partitionBy("log_date")
            .parquet(path)
        )

    def _sound_ledger(self) -> IdLedger:
        """The ledger, made anew from the logs when it is missing or a run stopped halfway."""
        if not self.ledger.is_sound():
            if folder_names(self.spark, self.path):
                self.ledger.rebuild(self.scan().select("id", "timestamp"))
            self.ledger.finish()
        return self.ledger

    def _store(self, rows: DataFrame) -> None:
        """Write new rows and enter their ids."""
        self.ledger.begin()
        self._write(rows, self.path, "append")
        self.ledger.add(rows)
        self.ledger.finish()

    def append_batch(self, logs: DataFrame) -> int:
        """Store all rows or none; any repeated or already stored id refuses the whole batch.

        The check meets the ledger only. ``logs`` is evaluated once and kept while it is checked.
        """
        ledger = self._sound_ledger()
        rows = self._prepared(logs).persist()
        try:
            count = rows.count()
            if count == 0:
                return 0
            conflicts = append_conflicts(rows, ledger.ids(), ledger.dealt)
            examples = [f"{row['id']} ({row['reason']})" for row in conflicts.limit(5).collect()]
            if examples:
                raise DuplicateIds(", ".join(examples))
            self._store(rows)
            return count
        finally:
            rows.unpersist()

    def append(self, entry: DataFrame) -> int:
        """Store one log (the same rules)."""
        return self.append_batch(entry)

    def append_new(self, logs: DataFrame, look_up: bool = True) -> int:
        """Store the rows whose id is not stored yet, under whatever day; a replayed batch adds nothing.

        A message without a time of its own gets the time it is read, so a replay may fall on
        another day: ids are looked up in the ledger, which knows no days. ``look_up=False`` is
        for rows known to be new.
        """
        ledger = self._sound_ledger()
        rows = self._prepared(logs)
        fresh = (new_rows(rows, ledger.ids(), ledger.dealt) if look_up else rows).persist()
        count = fresh.count()
        if count:
            self._store(fresh)
        fresh.unpersist()
        return count

    def delete_old(self, days: float = 30, as_of: Instant = None) -> int:
        """Delete logs older than ``days``; returns how many.

        Whole days are dropped as folders. The day of the cutoff is rewritten from a staged copy
        of its remaining rows. A run that stopped in between is completed by the next one.
        """
        self._finish_staged()
        limit = cutoff(days, as_of)
        limit_at, limit_day = self.spark.range(1).select(limit.cast("string"), F.to_date(limit)).first()
        boundary = F.lit(limit_at).cast("timestamp")
        old = self.scan().filter(
            (F.col("log_date") <= F.lit(limit_day)) & (F.col("timestamp") < boundary)
        )
        ledger = self._sound_ledger()
        per_day = old.groupBy("log_date").agg(F.count(F.lit(1)).alias("n")).collect()
        if not per_day:
            return 0
        ledger.begin()
        for row in per_day:
            if row["log_date"] < limit_day:
                delete_folder(self.spark, f"{self.path}/log_date={row['log_date']}")
            else:
                self._keep_from(limit_day, boundary)
        ledger.keep_from(boundary)
        ledger.finish()
        return sum(row["n"] for row in per_day)

    def _staging(self) -> str:
        return f"{self.path}/_staged"

    def _keep_from(self, day, boundary) -> None:
        rest = self.scan().filter((F.col("log_date") == F.lit(day)) & (F.col("timestamp") >= boundary))
        if rest.isEmpty():
            delete_folder(self.spark, f"{self.path}/log_date={day}")
            return
        self._write(rest, self._staging(), "overwrite")
        self._finish_staged()

    def _finish_staged(self) -> None:
        """Move a complete staged copy over its day, then drop it."""
        if exists(self.spark, f"{self._staging()}/_SUCCESS"):
            rows = self.spark.read.schema(self.schema).parquet(self._staging())
            (
                rows.sortWithinPartitions("timestamp")
                .write.mode("overwrite")
                .option("partitionOverwriteMode", "dynamic")
                .options(**FILE_OPTIONS)
                .partitionBy("log_date")
                .parquet(self.path)
            )
        delete_folder(self.spark, self._staging())
