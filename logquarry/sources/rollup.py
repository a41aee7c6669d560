"""Counts of logs per time cell, kept up by a stream as mergeable partial counts."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logquarry.functions.timerange import Instant, instant
from logquarry.sources.files import delete_folder, exists, folder_names

UNITS = ("minute", "hour", "day")
UPTO = "stream string, upto long"


def time_cells(logs: DataFrame, unit: str, keys: tuple[str, ...]) -> DataFrame:
    """(start, keys..., count); logs without a time are in no cell."""
    return (
        logs.filter(F.col("timestamp").isNotNull())
        .groupBy(F.date_trunc(unit, "timestamp").alias("start"), *keys)
        .agg(F.count(F.lit(1)).alias("count"))
    )


class Rollup:
    """(start, keys..., count) per clock minute, hour or day.

    A micro-batch adds the counts of its own rows in a folder of its own, which a replay replaces. Counts
    are added up when they are read, so rows may come in any order and however late, and nothing is kept in
    the state of the stream. ``fold`` joins the small folders into one table, whose list of folders it
    replaces comes with it: a reader takes the newest complete fold and the folders not in its list.
    Streams may write at any time; one fold or deletion at a time is assumed.
    """

    def __init__(
        self, spark: SparkSession, path: str, unit: str = "hour", keys: tuple[str, ...] = ("level", "source")
    ) -> None:
        if unit not in UNITS:
            raise ValueError(f"unit must be one of {', '.join(UNITS)}")
        self.spark, self.path, self.unit, self.keys = spark, path.rstrip("/"), unit, keys
        texts = [T.StructField(key, T.StringType()) for key in keys]
        self.schema = T.StructType([T.StructField("start", T.TimestampType()), *texts, T.StructField("count", T.LongType())])

    def _partials(self) -> str:
        return f"{self.path}/partials"

    def add(self, logs: DataFrame, stream: str, batch_id: int) -> None:
        """The counts of one micro-batch of a stream (named by its checkpoint)."""
        name = f"{hashlib.sha256(stream.encode()).hexdigest()[:12]}-{batch_id}"
        time_cells(logs, self.unit, self.keys).write.mode("overwrite").parquet(f"{self._partials()}/{name}")

    def _fold(self) -> int | None:
        complete = [
            int(name[1:]) for name in folder_names(self.spark, f"{self.path}/folds")
            if exists(self.spark, f"{self.path}/folds/{name}/list/_SUCCESS")
        ]
        return max(complete, default=None)

    def _read(self) -> tuple[DataFrame, dict[str, int]]:
        """(partial counts, last micro-batch per stream that they hold)."""
        fold, upto = self._fold(), {}
        rows = self.spark.createDataFrame([], self.schema)
        if fold is not None:
            at = f"{self.path}/folds/v{fold}"
            rows = self.spark.read.schema(self.schema).parquet(f"{at}/cells")
            # One row per stream that ever wrote here.
            upto = {r.stream: r.upto for r in self.spark.read.schema(UPTO).parquet(f"{at}/list").collect()}
        later = [
            (name, stream, batch) for name, stream, batch in self._folders()
            if batch > upto.get(stream, -1) and exists(self.spark, f"{self._partials()}/{name}/_SUCCESS")
        ]
        if later:
            paths = [f"{self._partials()}/{name}" for name, _, _ in later]
            rows = rows.unionByName(self.spark.read.schema(self.schema).parquet(*paths))
        for _, stream, batch in later:
            upto[stream] = max(batch, upto.get(stream, -1))
        return rows, upto

    def _folders(self) -> list[tuple[str, str, int]]:
        found = [(name, *name.split("-")) for name in folder_names(self.spark, self._partials())]
        return [(name, stream, int(batch)) for name, stream, batch in found]

    def read(self) -> DataFrame:
        """All cells with their counts so far."""
        return self._merged(self._read()[0])

    def _merged(self, rows: DataFrame) -> DataFrame:
        return rows.groupBy("start", *self.keys).agg(F.sum("count").alias("count"))

    def fold(self) -> None:
        """Join all folders of micro-batches into one table."""
        rows, upto = self._read()
        self._replace(self._merged(rows), upto)

    def drop_before(self, boundary: Instant, logs: DataFrame) -> None:
        """Forget the time before ``boundary``, as a deletion of logs does.

        The cell that holds the boundary is counted anew from ``logs``, what is left of the log table.
        """
        edge = F.date_trunc(self.unit, instant(boundary))
        next_edge = edge + F.expr(f"INTERVAL 1 {self.unit.upper()}")
        of_edge = logs.filter((F.col("timestamp") >= instant(boundary)) & (F.col("timestamp") < next_edge))
        rows, upto = self._read()
        later = rows.filter(F.col("start") >= next_edge)  # whole cells
        self._replace(self._merged(later.unionByName(time_cells(of_edge, self.unit, self.keys))), upto)

    def _replace(self, cells: DataFrame, upto: dict[str, int]) -> None:
        last = self._fold()
        at = f"{self.path}/folds/v{0 if last is None else last + 1}"
        cells.write.mode("overwrite").parquet(f"{at}/cells")
        listed = self.spark.createDataFrame(list(upto.items()), UPTO)
        listed.coalesce(1).write.mode("overwrite").parquet(f"{at}/list")
        for name, stream, batch in self._folders():
            if batch <= upto.get(stream, -1):
                delete_folder(self.spark, f"{self._partials()}/{name}")
        if last is not None:
            delete_folder(self.spark, f"{self.path}/folds/v{last}")
