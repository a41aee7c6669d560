"""Raw log lines to log records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logquarry.functions import levels, timestamps
from logquarry.functions.jsontext import Field, extract, first_present
from logquarry.functions.timerange import Instant, instant

# Names under which producers write level, message, source and time.
LEVEL_FIELDS = ("level", "severity", "log_level")
MESSAGE_FIELDS = ("message", "msg", "text")
SOURCE_FIELDS = ("source", "service", "app")
TIME_FIELDS = ("timestamp", "time", "ts")


def parse_lines(
    df: DataFrame,
    as_of: Instant = None,
    line: str = "value",
    path: str = "path",
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """Turn one text line per row into timestamp, level, source, message, raw.

    A line that is a JSON object with a level and a message becomes a structured record; any
    other line is plain text. A blank line keeps its text, gets level ``unknown`` and its file as
    source. ``keep`` names input columns to carry through.
    """
    now = instant(as_of)
    lines = df.select(*keep, F.col(line).alias("_line"), F.col(path).alias("_path"))
    fields = extract(lines, "_line", LEVEL_FIELDS + MESSAGE_FIELDS + SOURCE_FIELDS + TIME_FIELDS, ("level", "timestamp"))
    level, *other_levels = [Field.of(name) for name in LEVEL_FIELDS]
    stamp, *other_times = [Field.of(name) for name in TIME_FIELDS]
    other_level = first_present(other_levels)
    other_time = first_present(other_times)
    message = first_present([Field.of(name) for name in MESSAGE_FIELDS])
    source = first_present([Field.of(name) for name in SOURCE_FIELDS])
    # A chosen field that should be text but is not turns the whole line into plain text.
    structured = (
        (level.present() | other_level.is_string())
        & message.is_string()
        & (source.kind.isNull() | source.is_string())
        & (stamp.present() | other_time.kind.isNull() | other_time.is_string())
    )
    text = F.col("_line")
    marked = fields.select(
        "*",
        structured.alias("_structured"),
        text.rlike(r"^[ \t\n\x0b\f\r]*$").alias("_blank"),
    )
    is_structured, blank = F.col("_structured"), F.col("_blank")
    return marked.select(
        *keep,
        F.when(is_structured, _timestamp(stamp, other_time.text, now)).otherwise(now).alias("timestamp"),
        F.when(blank, "unknown")
        .when(is_structured, _level(level, other_level.text))
        .otherwise(levels.plain_text_level(text))
        .alias("level"),
        F.when(blank, F.col("_path"))
        .when(is_structured, F.coalesce(source.text, F.lit("unknown")))
        .otherwise("plain_text")
        .alias("source"),
        F.when(is_structured, message.text).otherwise(text).alias("message"),
        F.when(~blank, text).alias("raw"),
    )


def _level(level: Field, other: Column) -> Column:
    """``level`` may be text or an integer code; any other type means ``info``."""
    by_code = F.lit("info")
    for name, code in levels.LEVEL_CODES.items():
        by_code = F.when((level.kind == "BIGINT") & (level.number == code), name).otherwise(by_code)
    return (
        F.when(level.is_string(), levels.line_level(level.text))
        .when(level.present(), by_code)
        .otherwise(levels.line_level(other))
    )


def _timestamp(stamp: Field, other: Column, now: Column) -> Column:
    """``timestamp`` may be a number or text; the other two names hold text."""
    text = F.when(stamp.is_string(), stamp.text).when(~stamp.present(), other)
    return F.when(stamp.is_number(), timestamps.line_number(stamp.number, now)).otherwise(
        timestamps.line_text(text, now)
    )


def encode_records(df: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Parsed records as the JSON messages a shipper queues; a null ``raw`` is left out."""
    fields = (
        "message",
        "level",
        "source",
        F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX").alias("timestamp"),
        "raw",
    )
    return df.select(*keep, F.to_json(F.struct(*fields)).alias("content"))
