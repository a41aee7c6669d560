"""The given tables seen as logs, lines, messages, bodies, batches and alerts.

The texts of lines and bodies are built from one SQL template for both engines; everything the
operators compute from them is written separately on each side.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logquarry.functions.timerange import with_log_date
from logquarry.session import configure

# ``ts`` is declared as an instant, so that a filter on it reaches the Parquet scan.
EVENTS = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"
DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"

# Default "now" of the registered queries: the first instant after the events.
AS_OF = "2024-01-31 00:00:00"

TEXTS = {
    "spark": {
        "epoch": "(unix_micros(ts) div 1000000)",
        "millis": "(unix_micros(ts) div 1000)",
        "iso": "date_format(ts, \"yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'\")",
        "spaced": "date_format(ts, 'yyyy-MM-dd HH:mm:ss')",
    },
    "duckdb": {
        "epoch": "(epoch_us(ts) // 1000000)",
        "millis": "(epoch_us(ts) // 1000)",
        "iso": "strftime(ts, '%Y-%m-%dT%H:%M:%S.%fZ')",
        "spaced": "strftime(ts, '%Y-%m-%d %H:%M:%S')",
    },
}

CENTS = "cast(round(value * 100) as bigint)"
MESSAGE = f"concat(event_type, ' by user ', cast(user_id as string), ' cents ', cast({CENTS} as string))"
SOURCE = "concat('svc-', cast(user_id % 7 as string))"
SPELLED = (
    "case event_type when 'error' then 'FATAL' when 'purchase' then 'Warning' when 'signup' then 'notice' "
    "when 'click' then 'Verbose' else 'TRACE' end"
)

RAW_LINE = f"""case event_id % 10
 when 0 then concat('{{"level":"', {SPELLED}, '","message":"', {MESSAGE}, '","source":"', {SOURCE}, '","timestamp":', cast(<epoch> as string), '}}')
 when 1 then concat('{{"severity":"', {SPELLED}, '","msg":"', {MESSAGE}, '","service":"', {SOURCE}, '","ts":"', <iso>, '"}}')
 when 2 then concat('{{"level":', cast(user_id % 5 as string), ',"text":"', {MESSAGE}, '","app":"', {SOURCE}, '","timestamp":', cast(<millis> as string), '}}')
 when 3 then concat('{{"log_level":"', {SPELLED}, '","message":"', {MESSAGE}, '","time":"', <spaced>, '"}}')
 when 4 then concat('[', upper(event_type), '] ', case user_id % 4 when 0 then 'Warned about' when 1 then 'severe trace of' when 2 then 'DEBUG of' else 'saw' end, ' user ', cast(user_id as string))
 when 5 then '   '
 when 6 then concat('{{"level":null,"severity":"', {SPELLED}, '","message":"', {MESSAGE}, '","timestamp":"', cast(<epoch> as string), '"}}')
 when 7 then concat('{{"message":"', {MESSAGE}, '","source":"', {SOURCE}, '","timestamp":"', <iso>, '"}}')
 when 8 then concat('{{"level":"info","message":', cast({CENTS} as string), '}}')
 else concat('{{"level":"error","message":"', {MESSAGE}) end"""

BODY = f"""case event_id % 9
 when 0 then concat('{{"message":"', {MESSAGE}, '","level":"', {SPELLED}, '","source":"', {SOURCE}, '","timestamp":"', <iso>, '","raw":"r"}}')
 when 1 then concat('{{"message":"', {MESSAGE}, '","raw":7}}')
 when 2 then concat('{{"message":"', {MESSAGE}, '","timestamp":', cast(<millis> as string), ',"source":5}}')
 when 3 then concat('{{"level":"', {SPELLED}, '","source":"', {SOURCE}, '"}}')
 when 4 then '{{"message":""}}'
 when 5 then concat('{{"message":', cast(user_id as string), '}}')
 when 6 then concat('{{"message":"', {MESSAGE}, '","source":"', repeat('s', 600), '","timestamp":"never"}}')
 when 7 then concat('{{"message":"', {MESSAGE}, '","level":', cast(user_id % 3 as string), '}}')
 else concat('{{"message":"', repeat('m', cast(9990 + user_id % 20 as int)), '"}}') end"""

SHAPED = f"""case event_id % 5
 when 0 then concat('{{"id":"', cast(event_id as string), '","message":"', {MESSAGE}, '","level":"info","source":"', {SOURCE}, '","timestamp":"', <iso>, '"}}')
 when 1 then concat('{{"id":', cast(event_id as string), ',"message":"', {MESSAGE}, '","level":"info","source":"', {SOURCE}, '","timestamp":"', <iso>, '"}}')
 when 2 then concat('{{"id":"', cast(event_id as string), '","message":"', {MESSAGE}, '","severity":"high","created_at":"', <iso>, '","acknowledged":', case user_id % 2 when 0 then 'true' else '"no"' end, '}}')
 when 3 then concat('["', {MESSAGE}, '"]')
 else concat('{{"id":"', cast(event_id as string), '","message":null,"level":"info","source":"x","timestamp":"', <iso>, '"}}') end"""


def in_dialect(template: str, engine: str) -> str:
    for name, text in TEXTS[engine].items():
        template = template.replace(f"<{name}>", text)
    return template if engine == "spark" else template.replace("as string)", "as varchar)")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return configure(spark).read.schema(EVENTS).parquet(f"{sf_dir}/events.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return configure(spark).read.schema(DOCUMENTS).parquet(f"{sf_dir}/documents.parquet")


def _padded(prefix: str, column: str):
    digits = F.col(column).cast("string")
    return F.concat(F.lit(prefix), F.lpad(digits, F.greatest(F.length(digits), F.lit(12)), F.lit("0")))


def event_logs(df: DataFrame) -> DataFrame:
    level = (
        F.when(F.col("event_type") == "error", "error")
        .when(F.col("event_type") == "purchase", "warn")
        .when(F.col("event_type").isin("signup", "click"), "info")
        .otherwise("debug")
    )
    return df.select(
        _padded("ev-", "event_id").alias("id"),
        F.col("ts").alias("timestamp"),
        level.alias("level"),
        F.expr(SOURCE).alias("source"),
        F.expr(MESSAGE).alias("message"),
        F.col("props").alias("raw"),
    )


def logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as logs."""
    return event_logs(events(spark, sf_dir))


def doc_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as logs, one per minute."""
    start = F.lit("2024-01-01 00:00:00").cast("timestamp")
    rows = documents(spark, sf_dir)
    return rows.select(
        _padded("doc-", "doc_id").alias("id"),
        F.timestamp_add("MINUTE", F.col("doc_id"), start).alias("timestamp"),
        F.lit("info").alias("level"),
        "source",
        F.col("text").alias("message"),
        F.lit(None).cast("string").alias("raw"),
    )


def all_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logs(spark, sf_dir).unionByName(doc_logs(spark, sf_dir))


def dated_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_log_date(logs(spark, sf_dir))


def event_messages(df: DataFrame) -> DataFrame:
    return df.select(F.col("event_id").alias("id"), F.expr(in_dialect(RAW_LINE, "spark")).alias("content"))


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return event_messages(events(spark, sf_dir))


def raw_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return messages(spark, sf_dir).select(
        "id", F.col("content").alias("value"), F.lit("events.log").alias("path")
    )


def bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).select("event_id", F.expr(in_dialect(BODY, "spark")).alias("body"))


def shaped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).select("event_id", F.expr(in_dialect(SHAPED, "spark")).alias("body"))


def inbox(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A hundred messages per batch; created when its last event happened."""
    rows = events(spark, sf_dir).select(
        F.expr("event_id div 100").alias("id"),
        "event_id",
        "ts",
        F.expr(in_dialect(RAW_LINE, "spark")).alias("content"),
    )
    items = F.sort_array(F.collect_list(F.struct("event_id", "content")))
    return rows.groupBy("id").agg(
        F.to_json(F.transform(items, lambda item: item["content"])).alias("data"),
        F.max("ts").alias("created_at"),
    )


def processed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every other batch was processed when it was created."""
    return (
        events(spark, sf_dir)
        .groupBy(F.expr("event_id div 100").alias("id"))
        .agg(F.max("ts").alias("processed_at"))
        .filter("id % 2 = 0")
    )


def alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Error events as alerts; every third one is acknowledged."""
    severity = (
        F.when(F.col("value") < 25, "low")
        .when(F.col("value") < 75, "medium")
        .when(F.col("value") < 150, "high")
        .otherwise("critical")
    )
    return (
        events(spark, sf_dir)
        .filter(F.col("event_type") == "error")
        .select(
            F.concat(F.lit("al-"), F.col("event_id").cast("string")).alias("id"),
            _padded("ev-", "event_id").alias("log_id"),
            severity.alias("severity"),
            F.concat(F.lit("High error rate detected: "), F.expr(SOURCE)).alias("message"),
            F.col("props").alias("details"),
            F.col("ts").alias("created_at"),
            (F.col("event_id") % 3 == 0).alias("acknowledged"),
        )
    )


def anomalies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One anomaly per event, with messages that repeat and begin like stored alerts."""
    message = (
        F.when(F.col("event_type") == "error", F.concat(F.lit("HIGH error rate detected: "), F.expr(SOURCE)))
        .when(
            F.col("event_type") == "purchase",
            F.concat(
                F.lit("Unusual purchase pattern seen for the account of user "),
                F.col("user_id").cast("string"),
            ),
        )
        .otherwise(F.concat(F.col("event_type"), F.lit(" by user "), F.col("user_id").cast("string"), F.lit(".")))
    )
    severity = (
        F.when(F.col("value") < 25, "low")
        .when(F.col("value") < 75, "medium")
        .when(F.col("value") < 150, "high")
        .when(F.col("value") < 250, "critical")
        .otherwise("urgent")
    )
    return events(spark, sf_dir).select(
        _padded("ev-", "event_id").alias("log_id"),
        F.lit("event").alias("anomaly_type"),
        severity.alias("severity"),
        message.alias("message"),
        F.when(F.col("event_id") % 2 == 0, F.col("props")).otherwise("{}").alias("details"),
        F.lit(0).alias("detector_seq"),
    )
