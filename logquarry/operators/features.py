"""Per-log features for anomaly detection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logquarry.functions import levels, text

STATISTICAL = ("level_encoded", "message_length", "hour_of_day", "is_business_hours")
TEXTUAL = ("word_count", "unique_words", "has_error_keywords", "has_warning_keywords")

# Hour assumed for a missing timestamp, and the closed range of business hours.
DEFAULT_HOUR = 12
BUSINESS_HOURS = (9, 17)


def features(df: DataFrame, include_text: bool = True, keep: tuple[str, ...] = ()) -> DataFrame:
    """(log_id, timestamp, features...), all built-in expressions on one row at a time."""
    hour = F.coalesce(F.hour("timestamp"), F.lit(DEFAULT_HOUR))
    columns = [
        F.col("id").alias("log_id"),
        F.col("timestamp"),
        *[F.col(name) for name in keep],
        levels.level_code(F.col("level")).alias("level_encoded"),
        F.length("message").alias("message_length"),
        hour.alias("hour_of_day"),
        hour.between(*BUSINESS_HOURS).alias("is_business_hours"),
    ]
    if not include_text:
        return df.select(*columns)
    # Lower case and words are columns of their own, so that each is computed once per message.
    lowered = F.col("_lowered")
    columns += [
        text.words(lowered).alias("_words"),
        text.has_any(lowered, text.ERROR_KEYWORDS).alias("has_error_keywords"),
        text.has_any(lowered, text.WARNING_KEYWORDS).alias("has_warning_keywords"),
    ]
    return (
        df.withColumn("_lowered", F.lower("message"))
        .select(*columns)
        .withColumns(
            {"word_count": F.size("_words"), "unique_words": F.size(F.array_distinct("_words"))}
        )
        .select("log_id", "timestamp", *keep, *STATISTICAL, *TEXTUAL)
    )


def vector(include_text: bool = True) -> Column:
    """The features as an array of doubles in fixed order; booleans become 0 and 1."""
    names = STATISTICAL + (TEXTUAL if include_text else ())
    return F.array(*[F.col(name).cast("double") for name in names])


def feature_vectors(df: DataFrame, include_text: bool = True, keep: tuple[str, ...] = ()) -> DataFrame:
    """(log_id, vector)."""
    return features(df, include_text, keep).select("log_id", *keep, vector(include_text).alias("vector"))
