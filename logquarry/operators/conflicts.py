"""Identifier conflicts of a batch of logs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _as_it_lies(rows: DataFrame) -> DataFrame:
    return rows


def append_conflicts(
    batch: DataFrame, stored: DataFrame, deal: Callable[[DataFrame], DataFrame] = _as_it_lies
) -> DataFrame:
    """(id, reason): ids that occur twice in the batch or are already stored.

    The batch is reduced to one row per id before it meets the stored ids, so a repeated id costs
    one row, and only the ``id`` column of the stored logs is read. ``deal`` brings these rows where the
    stored ids lie, if those are bucketed.
    """
    counts = deal(batch.groupBy("id").agg(F.count(F.lit(1)).alias("n")))
    repeated = counts.filter(F.col("n") > 1).select("id", F.lit("repeated_in_batch").alias("reason"))
    # An inner join, because Spark would move a semi-join below the aggregation.
    known = counts.join(stored.select("id"), "id").select(
        "id", F.lit("already_stored").alias("reason")
    )
    return repeated.unionByName(known.distinct())


def new_rows(
    batch: DataFrame, stored: DataFrame, deal: Callable[[DataFrame], DataFrame] = _as_it_lies
) -> DataFrame:
    """Batch rows whose id is not stored yet, one per id.

    Ids are content-derived, so rows that share an id are copies and any of them will do. ``deal`` as in
    ``append_conflicts``.
    """
    # An outer join, because Spark would move an anti-join below the dealing.
    known = stored.select("id", F.lit(True).alias("_known"))
    return deal(batch.dropDuplicates(["id"])).join(known, "id", "left").filter("_known IS NULL").drop("_known")
