"""Timestamps as written by log producers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from logquarry.functions.jsontext import Field

# Numbers beyond this are milliseconds, up to it seconds (lines); strictly below it
# seconds, from it on milliseconds (messages).
MILLIS_FROM = 1_000_000_000_000
# Fixed value: largest distance from the epoch, in milliseconds, that a message may carry.
MAX_MILLIS = 8_640_000_000_000_000

_ISO = r"^\s*(\d{4}-\d{1,2}-\d{1,2})[T ](\d{1,2}:\d{1,2}:\d{1,2})(\.\d+)?(Z|[+-]\d{2}:?\d{2})?"
_DATE_LIKE = r"^\s*\d{4}(-\d{2}){0,2}\s*$|^\s*\d{4}-\d{2}-\d{2}[T ]\d{1,2}:\d{2}"
_WITH_YEAR = r"\d{4}/|[A-Za-z]{3}.*\d{4}"

# Date texts besides ISO that messages may use.
_OTHER_DATES = ("yyyy/M/d[ HH:mm:ss]", "d MMM yyyy[ HH:mm:ss]", "MMM d, yyyy[ HH:mm:ss]")


def millis(value: Column) -> Column:
    """Epoch milliseconds (double, truncated) as a timestamp; null when out of range."""
    usable = F.abs(value) <= MAX_MILLIS
    return F.when(usable, F.timestamp_millis(F.when(usable, value).cast("long")))


def line_text(text: Column, as_of: Column) -> Column:
    """Timestamp text of a log line: epoch digits or ISO 8601, else ``as_of``.

    A zone suffix is honoured; without one the time is UTC.
    """
    number = text.try_cast("double")
    digits = F.when(
        F.length(text) <= 20, F.when(F.length(text) > 10, millis(number)).otherwise(millis(number * 1000))
    )
    iso = F.concat(
        F.regexp_extract(text, _ISO, 1),
        F.lit("T"),
        F.regexp_extract(text, _ISO, 2),
        F.regexp_extract(text, _ISO, 3),
        F.regexp_extract(text, _ISO, 4),
    ).try_cast("timestamp")
    parsed = F.when(text.rlike(r"^[0-9]+$"), digits).when(text.rlike(_ISO), iso)
    return F.coalesce(parsed, as_of)


def line_number(value: Column, as_of: Column) -> Column:
    """Numeric timestamp of a log line (double)."""
    whole = F.when(F.abs(value) < 9.2e18, value.cast("long")).cast("double")
    return F.coalesce(
        F.when(whole > MILLIS_FROM, millis(whole)).otherwise(millis(whole * 1000)), as_of
    )


def date_text(text: Column) -> Column:
    """Date text of a message: ISO 8601 and a few common forms; null when it is none of them."""
    iso = F.when(text.rlike(_DATE_LIKE), text.try_cast("timestamp"))
    bare = F.regexp_replace(text, r"^\s*([A-Za-z]{3}, )?|( (GMT|UTC))?\s*$", "")
    others = [F.try_to_timestamp(bare, F.lit(pattern)) for pattern in _OTHER_DATES]
    return F.coalesce(iso, F.when(text.rlike(_WITH_YEAR), F.coalesce(*others)))


def message_value(field: Field, as_of: Column) -> Column:
    """Timestamp field of a message, whatever its JSON type; null only when out of range.

    A number below 1e12 is in seconds, from there on in milliseconds; a missing or empty field
    and text that is no date mean ``as_of``.
    """
    number = field.number
    return (
        F.when(~field.truthy(), as_of)
        .when(field.is_number(), millis(F.when(number < MILLIS_FROM, number * 1000).otherwise(number)))
        .when(field.is_string(), F.coalesce(date_text(field.text), as_of))
        .otherwise(as_of)
    )
