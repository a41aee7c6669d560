"""Queued messages and directly ingested bodies to log records, with their rejects."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logquarry.functions import ids, levels, timestamps
from logquarry.functions.jsontext import Field, extract
from logquarry.functions.timerange import Instant, instant

# Limits of direct ingestion.
MAX_MESSAGE_CHARS = 10_000
MAX_SOURCE_CHARS = 500


def _column_text(field: Field) -> Column:
    """Text of a string, or of a number as a double (how a text column stores a number)."""
    whole = (F.abs(field.number) < 1e15) & (field.number == F.floor(field.number))
    return (
        F.when(field.is_string(), field.text)
        .when(whole, F.concat(field.number.cast("long").cast("string"), F.lit(".0")))
        .otherwise(field.number.cast("string"))
    )


def _settled(df: DataFrame, reason: Column, *columns: Column | str) -> DataFrame:
    """Select the columns and ``reject_reason``.

    The reason passes a one-row generator. A filter on it then runs on the finished column;
    otherwise Spark would move the filter below the projection and evaluate all of this twice.
    """
    done = df.select(*columns, reason.alias("_reason"))
    return done.select("*", F.explode(F.array("_reason")).alias("reject_reason")).drop("_reason")


def classify_messages(
    df: DataFrame,
    as_of: Instant = None,
    content: str = "content",
    key: tuple[str, ...] = ("id",),
) -> DataFrame:
    """Normalise queued JSON messages; ``reject_reason`` says why a message cannot become a log.

    Output: the key columns, content, reject_reason, log_id, timestamp, level, source, message,
    raw. The log id is derived from key and content, so a replay produces the same rows.
    """
    given = df.select(*key, F.col(content).alias("content"))
    names = ("timestamp", "level", "source", "message")
    fields = extract(given, "content", names, numbers=names)
    level, source, message = Field.of("level"), Field.of("source"), Field.of("message")

    def unstorable(field: Field) -> Column:
        return field.truthy() & ~field.is_string() & ~field.is_number()

    stamped = fields.withColumn("_at", timestamps.message_value(Field.of("timestamp"), instant(as_of)))
    reason = (
        F.when(F.col("root_kind").isNull(), "invalid_json")
        .when(F.col("root_kind") == "VOID", "null_message")
        .when(level.truthy() & ~level.is_string(), "level_not_text")
        .when(F.col("_at").isNull(), "timestamp_out_of_range")
        .when(unstorable(source), "source_not_text")
        .when(unstorable(message), "message_not_text")
    )
    return _settled(
        stamped,
        reason,
        *key,
        "content",
        ids.content_id(*[F.col(k) for k in key], F.col("content")).alias("log_id"),
        F.col("_at").alias("timestamp"),
        levels.message_level(level.text).alias("level"),
        F.when(source.truthy(), _column_text(source)).otherwise("unknown").alias("source"),
        F.when(message.truthy(), _column_text(message)).otherwise(F.col("content")).alias("message"),
        F.col("content").alias("raw"),
    )


def normalize_messages(df: DataFrame, as_of: Instant = None, **kwargs) -> DataFrame:
    """Log records of the messages that can be normalised."""
    return (
        classify_messages(df, as_of, **kwargs)
        .filter(F.col("reject_reason").isNull())
        .select(F.col("log_id").alias("id"), "timestamp", "level", "source", "message", "raw")
    )


def dead_letters(df: DataFrame, as_of: Instant = None, **kwargs) -> DataFrame:
    """The other messages, with the reason each one failed."""
    key = kwargs.get("key", ("id",))
    return (
        classify_messages(df, as_of, **kwargs)
        .filter(F.col("reject_reason").isNotNull())
        .select(
            *key,
            "content",
            F.col("reject_reason").alias("reason"),
            instant(as_of).alias("failed_at"),
        )
    )


def skip_failed(messages: DataFrame, failed: DataFrame, key: tuple[str, ...] = ("id",)) -> DataFrame:
    """Messages that have not failed before."""
    return messages.join(failed.select(*key).distinct(), list(key), "left_anti")


def classify_bodies(
    df: DataFrame, as_of: Instant = None, body: str = "body", keep: tuple[str, ...] = ()
) -> DataFrame:
    """Check directly ingested JSON bodies; ``reject_reason`` is null for accepted ones."""
    given = df.select(*keep, F.col(body).alias("body"))
    names = ("timestamp", "level", "source", "message", "raw")
    fields = extract(given, "body", names, numbers=names)
    level, source, message = Field.of("level"), Field.of("source"), Field.of("message")
    stamp, raw = Field.of("timestamp"), Field.of("raw")
    # Lengths count UTF-16 units; the encoding is only needed between half the limit and the limit.
    too_long = (F.length(message.text) > MAX_MESSAGE_CHARS) | (
        (F.length(message.text) > MAX_MESSAGE_CHARS // 2)
        & (F.length(F.encode(message.text, "UTF-16BE")) > 2 * MAX_MESSAGE_CHARS)
    )
    at = F.when(stamp.is_number() & stamp.truthy(), timestamps.millis(stamp.number)).when(
        stamp.is_string(), timestamps.date_text(stamp.text)
    )
    origin = F.when(source.is_string() & source.truthy(), F.left(source.text, F.lit(MAX_SOURCE_CHARS)))
    reason = (
        F.when(F.col("root_kind").isNull(), "invalid_json")
        .when(~(message.truthy() & message.is_string()), "message_required")
        .when(too_long, "message_too_long")
        .when(level.truthy() & ~level.is_string(), "level_not_text")
    )
    return _settled(
        fields,
        reason,
        *keep,
        "body",
        F.coalesce(at, instant(as_of)).alias("timestamp"),
        levels.message_level(level.text).alias("level"),
        F.coalesce(origin, F.lit("api")).alias("source"),
        message.text.alias("message"),
        F.when(raw.is_string(), raw.text).alias("raw"),
        F.coalesce(source.is_string() & (F.length(source.text) > MAX_SOURCE_CHARS), F.lit(False)).alias("source_cut"),
    )


def validate_ingest(df: DataFrame, as_of: Instant = None, body: str = "body", keep: tuple[str, ...] = ()) -> DataFrame:
    """Accepted bodies as log records; ``source_cut`` marks a source that was longer. ``keep`` columns take part in the id, so equal bodies stay apart."""
    accepted = classify_bodies(df, as_of, body, keep).filter(F.col("reject_reason").isNull())
    return accepted.select(
        *keep,
        ids.content_id(*[F.col(k) for k in keep], F.col("body")).alias("id"),
        "timestamp",
        "level",
        "source",
        "message",
        "raw",
        "source_cut",
    )


def ingest_rejects(df: DataFrame, as_of: Instant = None, body: str = "body", keep: tuple[str, ...] = ()) -> DataFrame:
    """Refused bodies and why."""
    return (
        classify_bodies(df, as_of, body, keep)
        .filter(F.col("reject_reason").isNotNull())
        .select(*keep, "body", "reject_reason")
    )


def _of_types(df: DataFrame, column: str, types: dict[str, str]) -> DataFrame:
    fields = extract(df, column, tuple(types))
    for name, wanted in types.items():
        fields = fields.filter(F.col(f"{name}_kind") == wanted)
    return fields.select(*df.columns)


def log_shaped(df: DataFrame, column: str = "body") -> DataFrame:
    """JSON objects whose five log fields are all text."""
    names = ("id", "message", "level", "source", "timestamp")
    return _of_types(df, column, {name: "STRING" for name in names})


def alert_shaped(df: DataFrame, column: str = "body") -> DataFrame:
    """JSON objects with the four alert text fields and a boolean ``acknowledged``."""
    types = {name: "STRING" for name in ("id", "message", "severity", "created_at")}
    return _of_types(df, column, {**types, "acknowledged": "BOOLEAN"})


# Largest field lengths of logs handed in for analysis.
INPUT_LIMITS = {
    "id": 100,
    "timestamp": 100,
    "level": 20,
    "source": 100,
    "message": 10_000,
    "raw": 50_000,
}
# What a missing field of such a log becomes.
INPUT_DEFAULTS = {"id": "", "timestamp": "", "level": "info", "source": "unknown", "message": ""}


def classify_input(df: DataFrame) -> DataFrame:
    """Logs handed in for analysis, missing fields filled; ``reject_reason`` names the first
    overlong field and is null for usable logs.

    Missing columns are added. ``timestamp`` may be text (unparsable text becomes null, which the
    detectors skip) or already a timestamp.
    """
    types = dict(df.dtypes)
    filled = df
    for name in INPUT_LIMITS:
        column = F.col(name).cast("string") if name in types else F.lit(None).cast("string")
        if name in INPUT_DEFAULTS and types.get(name) != "timestamp":
            column = F.coalesce(column, F.lit(INPUT_DEFAULTS[name]))
        filled = filled.withColumn(f"_{name}", column)
    reasons = [F.when(F.length(f"_{name}") > limit, f"{name}_too_long") for name, limit in INPUT_LIMITS.items()]
    at = F.col("timestamp") if types.get("timestamp") == "timestamp" else timestamps.date_text(F.col("_timestamp"))
    return filled.select(
        F.col("_id").alias("id"),
        at.alias("timestamp"),
        F.col("_level").alias("level"),
        F.col("_source").alias("source"),
        F.col("_message").alias("message"),
        F.col("_raw").alias("raw"),
        F.coalesce(*reasons).alias("reject_reason"),
    )


def analysis_input(df: DataFrame) -> DataFrame:
    """The usable logs of ``classify_input``."""
    return classify_input(df).filter(F.col("reject_reason").isNull()).drop("reject_reason")


def input_rejects(df: DataFrame) -> DataFrame:
    """The other logs handed in, whole, and why they are refused."""
    return classify_input(df).filter(F.col("reject_reason").isNotNull())
