"""Alerts on Parquet, in a folder per day: only days that a deletion touches are written anew.

``<path>/alerts/alert_date=<day>`` holds the alerts that were created that day, and
``<path>/acks/alert_date=<day>`` the acknowledgements of these alerts since the day was last written,
whenever they were given. A day that is written anew takes its acknowledgements into its rows. Days are of
the session's time zone, UTC after ``configure``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logquarry.functions.timerange import Instant, before, instant
from logquarry.operators import alerts as ops
from logquarry.schema import ACK, ALERT
from logquarry.session import materialise
from logquarry.sources.files import delete_folder, exists, folder_names, read_or_empty

DAY = "alert_date"
DATED = T.StructField(DAY, T.DateType())


class AlertTable:
    """The alert store. One writer at a time is assumed."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark = spark
        self.path = path.rstrip("/")

    def _table(self, name: str, schema: T.StructType, since: Instant, until: Instant) -> DataFrame:
        rows = read_or_empty(self.spark, f"{self.path}/{name}", T.StructType([*schema.fields, DATED]))
        if since is not None:
            rows = rows.filter(F.col(DAY) >= F.to_date(instant(since)))
        if until is not None:
            rows = rows.filter(F.col(DAY) <= F.to_date(instant(until)))
        return rows

    def _rows(self, since: Instant = None, until: Instant = None) -> DataFrame:
        return self._table("alerts", ALERT, since, until)

    def _state(self, since: Instant = None, until: Instant = None) -> DataFrame:
        """Alerts of whole days with their current state and their day."""
        acked = self._table("acks", ACK, since, until).distinct().withColumn("_acked", F.lit(True))
        return (
            self._rows(since, until)
            .join(acked, [DAY, "id"], "left")
            .withColumn("acknowledged", F.col("acknowledged") | F.coalesce("_acked", F.lit(False)))
            .select(*ALERT.fieldNames(), DAY)
        )

    def read(self, since: Instant = None, until: Instant = None) -> DataFrame:
        """Alerts with their current state; with bounds on the time of creation only those days are read."""
        state = self._state(since, until)
        if since is not None:
            state = state.filter(F.col("created_at") >= instant(since))
        if until is not None:
            state = state.filter(F.col("created_at") <= instant(until))
        return state.drop(DAY)

    def open_since(self, hours: float = 1.0, as_of: Instant = None) -> DataFrame:
        """Unacknowledged alerts of the last ``hours``, from the days that these touch."""
        return self.read(before(as_of, hours=hours), instant(as_of)).filter(~F.col("acknowledged"))

    def create(self, anomalies: DataFrame, as_of: Instant = None) -> DataFrame:
        """Store anomalies as open alerts and return them; an unknown severity refuses them all."""
        bad = [row[0] for row in ops.invalid_severity(anomalies).select("severity").limit(5).collect()]
        if bad:
            raise ValueError(f"invalid severity: {bad}")
        return self.append(ops.new_alerts(anomalies, as_of))

    def append(self, alerts: DataFrame) -> DataFrame:
        """Store finished alerts whose id is not stored yet, and return those.

        An alert keeps its time of creation, which is part of its id, so an id is looked up only in
        the days that the new alerts span.
        """
        self._finish_staged()
        alerts = materialise(alerts.dropDuplicates(["id"]))
        first, last = alerts.agg(F.min("created_at").cast("string"), F.max("created_at").cast("string")).first()
        if first is None:
            return alerts
        fresh = materialise(alerts.join(self._rows(first, last).select("id"), "id", "left_anti"))
        self._write(fresh.select(*ALERT.fieldNames(), F.to_date("created_at").alias(DAY)), "alerts")
        return fresh

    def _write(self, rows: DataFrame, name: str, mode: str = "append") -> None:
        # Few files a day, and a day of many alerts is split.
        rows.hint("rebalance", DAY).write.mode(mode).partitionBy(DAY).parquet(f"{self.path}/{name}")

    def acknowledge(self, ids: DataFrame, since: Instant = None) -> DataFrame:
        """(id, found) for each id; the found ones are acknowledged.

        ``since`` limits the look-up to alerts of that day and later.
        """
        self._finish_staged()
        stored = self._rows(since).select("id", DAY)
        found = ids.select("id").distinct().join(stored, "id", "left")
        result = materialise(found.select("id", F.col(DAY).isNotNull().alias("found"), DAY))
        self._write(result.filter("found").select("id", DAY), "acks")
        return result.drop(DAY)

    def delete_old(self, days: float = 30, as_of: Instant = None) -> int:
        """Delete acknowledged alerts older than ``days``; returns how many."""
        if days <= 0:
            raise ValueError("days must be positive")
        return self._delete(days, as_of)

    def delete_acknowledged(self) -> int:
        """Delete all acknowledged alerts; returns how many."""
        return self._delete(None, None)

    def fold_acks(self) -> int:
        """Write the days that have acknowledgements anew, with these taken in; returns how many days."""
        self._finish_staged()
        days = self._days("acks")
        self._keep(self._state(), days)
        return len(days)

    def _delete(self, days: float | None, as_of: Instant) -> int:
        self._finish_staged()
        limit = None
        if days is not None:
            # One instant for all steps.
            limit = self.spark.range(1).select(before(as_of, days=days).cast("string")).first()[0]
        state = self._state(until=limit)
        gone = F.col("acknowledged")
        if limit is not None:
            gone = gone & (F.col("created_at") < F.lit(limit).cast("timestamp"))
        # One row per day of the calendar.
        per_day = state.groupBy(F.col(DAY).cast("string").alias("day")).agg(
            F.count_if(gone).alias("gone"), F.count(F.lit(1)).alias("n")
        )
        touched = per_day.filter("gone > 0").collect()
        self._keep(state.filter(~gone), [row["day"] for row in touched if row["gone"] < row["n"]])
        for row in touched:
            if row["gone"] == row["n"]:
                self._drop_day("alerts", row["day"])
                self._drop_day("acks", row["day"])
        return sum(row["gone"] for row in touched)

    def _days(self, name: str) -> list[str]:
        names = folder_names(self.spark, f"{self.path}/{name}")
        return [n.removeprefix(f"{DAY}=") for n in names if n.startswith(f"{DAY}=")]

    def _drop_day(self, name: str, day: str) -> None:
        delete_folder(self.spark, f"{self.path}/{name}/{DAY}={day}")

    def _keep(self, rows: DataFrame, days: list[str]) -> None:
        """Make ``rows`` the whole content of these days. A copy is staged first, as rows are read from there."""
        if days:
            self._write(rows.filter(F.col(DAY).isin([F.lit(d).cast("date") for d in days])), "_staged", "overwrite")
            self._finish_staged()

    def _finish_staged(self) -> None:
        """Move a complete staged copy over its days, drop their acknowledgements, then the copy.

        Every writer begins with this, so that a run that stopped in between is completed.
        """
        staged = f"{self.path}/_staged"
        if exists(self.spark, f"{staged}/_SUCCESS"):
            rows = self._table("_staged", ALERT, None, None)
            rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(DAY).parquet(f"{self.path}/alerts")
            for day in self._days("_staged"):
                self._drop_day("acks", day)
        delete_folder(self.spark, staged)
