"""Alert queries and the checks around creating and acknowledging alerts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logquarry.functions import ids
from logquarry.functions.text import ascii_lower
from logquarry.functions.timerange import Instant, before, in_range, instant
from logquarry.operators.search import Page, page_arguments
from logquarry.schema import ALERT, SEVERITIES, SYSTEM_LOG_ID

COLUMNS = tuple(ALERT.fieldNames())
LATEST = 5


def list_alerts(
    df: DataFrame,
    severity: str | None = None,
    acknowledged: bool | None = None,
    limit: object = None,
    offset: object = None,
) -> Page:
    """Newest alerts first, with the filters that are given."""
    size, skip = page_arguments(limit, offset)
    if severity:
        df = df.filter(F.col("severity") == severity)
    if acknowledged is not None:
        df = df.filter(F.col("acknowledged") == acknowledged)
    rows = df.select(*COLUMNS).orderBy(F.desc("created_at"), "id").offset(skip).limit(size)
    return Page(rows, df)


def by_id(df: DataFrame, alert_id: str) -> DataFrame:
    return df.filter(F.col("id") == alert_id).limit(1)


def recent_alerts(df: DataFrame, hours: float = 24.0, limit: int = 100, as_of: Instant = None) -> DataFrame:
    """Newest alerts of the last ``hours``."""
    since = in_range(df, before(as_of, hours=hours), instant(as_of), column="created_at")
    return since.orderBy(F.desc("created_at"), "id").limit(limit)


def open_since(df: DataFrame, hours: float = 1.0, as_of: Instant = None) -> DataFrame:
    """Unacknowledged alerts of the last ``hours``."""
    unseen = df.filter(~F.col("acknowledged"))
    return in_range(unseen, before(as_of, hours=hours), instant(as_of), column="created_at")


def similar_alert(df: DataFrame, pattern: str, severity: str, hours: float = 1.0, as_of: Instant = None) -> DataFrame:
    """The first open alert of that severity whose message contains the text (or no row)."""
    same = open_since(df, hours, as_of).filter(F.col("severity") == severity)
    hit = ascii_lower(F.col("message")).contains(ascii_lower(F.lit(pattern)))
    return same.filter(hit).orderBy("created_at", "id").limit(1)


def alert_stats(df: DataFrame) -> DataFrame:
    """Rows (section, name, count): total, unacknowledged, and one per severity; one shuffle."""
    cells = df.groupBy("severity").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(~F.col("acknowledged")).alias("open")
    )
    # The severities are a closed domain, so this second step sees a handful of rows.
    sections = F.array(
        F.struct(F.lit("severity").alias("section"), F.col("severity").alias("name"), F.col("n").alias("count")),
        F.struct(F.lit("total").alias("section"), F.lit("all").alias("name"), F.col("n").alias("count")),
        F.struct(F.lit("unacknowledged").alias("section"), F.lit("all").alias("name"), F.col("open").alias("count")),
    )
    return (
        cells.select(F.inline(sections))
        .groupBy("section", "name")
        .agg(F.sum("count").alias("count"))
    )


def count_unacknowledged(df: DataFrame, severity: str | None = None) -> DataFrame:
    still_open = df.filter(~F.col("acknowledged"))
    if severity:
        still_open = still_open.filter(F.col("severity") == severity)
    return still_open.agg(F.count(F.lit(1)).alias("count"))


def latest_counts(df: DataFrame, n: int = LATEST) -> DataFrame:
    """(alerts, critical) among the newest ``n`` alerts."""
    newest = list_alerts(df, limit=n).rows
    return newest.agg(
        F.count(F.lit(1)).alias("alerts"), F.count_if(F.col("severity") == "critical").alias("critical")
    )


def with_details(df: DataFrame) -> DataFrame:
    """Replace the details text by a VARIANT; empty or invalid text becomes null."""
    return df.withColumn("details", F.try_parse_json("details"))


def invalid_severity(df: DataFrame) -> DataFrame:
    """Rows whose severity is not one of the four."""
    return df.filter(~F.coalesce(F.col("severity").isin(*SEVERITIES), F.lit(False)))


def new_alerts(anomalies: DataFrame, as_of: Instant = None) -> DataFrame:
    """Anomalies of a known severity as open alerts; empty details become null."""
    created = instant(as_of)
    details = F.when(~F.trim("details").isin("", "{}", "null"), F.col("details"))
    return anomalies.filter(F.col("severity").isin(*SEVERITIES)).select(
        ids.content_id(
            F.col("log_id"), F.col("severity"), F.col("message"), F.col("details"), created
        ).alias("id"),
        "log_id",
        "severity",
        "message",
        details.alias("details"),
        created.alias("created_at"),
        F.lit(False).alias("acknowledged"),
    )


def with_acks(alerts: DataFrame, acks: DataFrame) -> DataFrame:
    """Current state: an alert is acknowledged when it was created so or its id was acknowledged."""
    acked = acks.select("id").distinct().withColumn("_acked", F.lit(True))
    return (
        alerts.join(acked, "id", "left")
        .withColumn("acknowledged", F.col("acknowledged") | F.coalesce("_acked", F.lit(False)))
        .select(*COLUMNS)
    )


def acknowledgeable(alerts: DataFrame, wanted: DataFrame) -> DataFrame:
    """(id, found) for each wanted id; repeating an acknowledgement still finds the alert."""
    known = alerts.select("id", F.lit(True).alias("_found"))
    return (
        wanted.select("id")
        .distinct()
        .join(known, "id", "left")
        .select("id", F.coalesce("_found", F.lit(False)).alias("found"))
    )


def orphans(alerts: DataFrame, logs: DataFrame) -> DataFrame:
    """Alerts that point at no stored log; alerts about the system as a whole are exempt."""
    return alerts.filter(F.col("log_id") != SYSTEM_LOG_ID).join(
        logs.select(F.col("id").alias("log_id")), "log_id", "left_anti"
    )


def deletable(alerts: DataFrame, days: float | None = None, as_of: Instant = None) -> DataFrame:
    """Acknowledged alerts, optionally only those older than ``days``."""
    done = alerts.filter(F.col("acknowledged"))
    if days is None:
        return done
    if days <= 0:
        raise ValueError("days must be positive")
    return done.filter(F.col("created_at") < before(as_of, days=days))


def surviving(alerts: DataFrame, days: float | None = None, as_of: Instant = None) -> DataFrame:
    """What remains after deleting those."""
    gone = F.col("acknowledged")
    if days is not None:
        if days <= 0:
            raise ValueError("days must be positive")
        gone = gone & (F.col("created_at") < before(as_of, days=days))
    return alerts.filter(~gone)
