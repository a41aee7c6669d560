"""The message queue as tables: inbox batches and the ledger of processed ones."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logquarry.functions import jsontext
from logquarry.functions.timerange import Instant, before, instant

# Largest batch, default page of the queue, and the longest clean-up age in hours.
MAX_BATCH = 1000
DEFAULT_NEXT = 100
MAX_CLEANUP_HOURS = 720
DEFAULT_CLEANUP_HOURS = 24


def enqueue_lines(
    lines: DataFrame,
    as_of: Instant = None,
    first_id: int = 0,
    size: int = MAX_BATCH,
    seq: str = "seq",
    line: str = "content",
) -> DataFrame:
    """Pack lines into JSON-array batches of at most ``size``, in ``seq`` order.

    ``seq`` is a unique non-negative long that follows the line order. A batch is a run of
    ``size`` consecutive numbers, so no group can outgrow ``size`` rows and no ranking over a
    whole file is needed; gaps in ``seq`` only make some batches smaller.
    """
    if not 1 <= size <= MAX_BATCH:
        raise ValueError(f"batch size must be between 1 and {MAX_BATCH}")
    batches = (
        lines.filter(F.col(line).isNotNull())
        .groupBy(F.expr(f"`{seq}` div {size}").alias("batch"))
        .agg(F.sort_array(F.collect_list(F.struct(F.col(seq).alias("seq"), F.col(line).alias("line")))).alias("items"))
    )
    return batches.select(
        (F.col("batch") + F.lit(first_id)).cast("long").alias("id"),
        F.to_json(F.transform("items", lambda item: item["line"])).alias("data"),
        instant(as_of).alias("created_at"),
    )


def accept_bodies(df: DataFrame, body: str = "body", keep: tuple[str, ...] = ()) -> DataFrame:
    """Check submitted JSON bodies: (keep..., status, data).

    A body must be an array of at most 1,000 items; items that are not strings are dropped, and
    nothing left to store is an error. ``data`` is set for accepted bodies only.
    """
    parsed = jsontext.parse(df.select(*keep, F.col(body).alias("_body")), "_body")
    items = parsed.select(
        *keep,
        jsontext.kind_of(F.try_variant_get("_json", "$[0]", "variant")).alias("_kind"),
        F.try_variant_get("_json", "$[0]", "array<variant>").alias("_items"),
    )
    kept = items.withColumn(
        "_texts",
        F.transform(
            F.filter("_items", lambda item: F.schema_of_variant(item) == "STRING"),
            lambda item: F.try_variant_get(item, "$", "string"),
        ),
    )
    status = (
        F.when(F.col("_kind").isNull(), "invalid_json")
        .when(F.col("_kind") != "ARRAY", "not_an_array")
        .when(F.size("_items") > MAX_BATCH, "too_many_items")
        .when(F.size("_texts") == 0, "nothing_to_store")
        .otherwise("accepted")
    )
    return kept.select(
        *keep,
        status.alias("status"),
        F.when(status == "accepted", F.to_json("_texts")).alias("data"),
    )


def pending(inbox: DataFrame, processed: DataFrame) -> DataFrame:
    """Batches that are not in the ledger."""
    return inbox.join(processed.select("id").distinct(), "id", "left_anti")


def next_batches(inbox: DataFrame, processed: DataFrame, n: int = DEFAULT_NEXT) -> DataFrame:
    """The oldest ``n`` pending batches, 1 to 1,000."""
    if not 0 < n <= MAX_BATCH:
        raise ValueError(f"n must be from 1 to {MAX_BATCH}")
    return pending(inbox, processed).orderBy("created_at", "id").limit(n)


def mark_processed(batches: DataFrame, as_of: Instant = None) -> DataFrame:
    """Ledger rows for these batches."""
    return batches.select("id", instant(as_of).alias("processed_at"))


def explode_batches(inbox: DataFrame) -> DataFrame:
    """One message per line: (inbox_id, pos, content)."""
    lines = F.from_json("data", "array<string>")
    return inbox.select(F.col("id").alias("inbox_id"), F.posexplode(lines).alias("pos", "content"))


def inbox_stats(inbox: DataFrame, processed: DataFrame) -> DataFrame:
    """(pending, total) from one pass over a marked inbox."""
    done = processed.select("id", F.lit(True).alias("_done")).distinct()
    return inbox.join(done, "id", "left").agg(
        F.count_if(F.col("_done").isNull()).alias("pending"), F.count(F.lit(1)).alias("total")
    )


def expired(processed: DataFrame, hours: float = DEFAULT_CLEANUP_HOURS, as_of: Instant = None) -> DataFrame:
    """Ledger rows old enough to clean up; the age is at most 720 hours."""
    if hours > MAX_CLEANUP_HOURS:
        raise ValueError(f"hours must be at most {MAX_CLEANUP_HOURS}")
    return processed.filter(F.col("processed_at") < before(as_of, hours=hours))


def after_cleanup(inbox: DataFrame, processed: DataFrame, hours: float = DEFAULT_CLEANUP_HOURS, as_of: Instant = None) -> DataFrame:
    """The inbox without processed batches of that age."""
    return inbox.join(expired(processed, hours, as_of).select("id").distinct(), "id", "left_anti")
