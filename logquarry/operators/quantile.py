"""Exact quantile of a weighted column without gathering it in one place."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BINS = 4096


def exact_quantile(df: DataFrame, value: str, weight: str, p: float) -> float | None:
    """Quantile ``p`` with linear interpolation of ``value`` repeated ``weight`` times.

    ``df`` is scanned a few times, so cut its lineage first.
    """
    rows = df.select(F.col(value).alias("v"), F.col(weight).cast("long").alias("w"))
    rows = rows.filter(F.col("v").isNotNull())
    n, low, high = rows.agg(F.sum("w"), F.min("v"), F.max("v")).first()
    if not n:
        return None
    rank = (n - 1) * p
    below = int(rank)
    first = _ranked(rows, below, low, high)
    if rank == below:
        return first
    return first + (_ranked(rows, below + 1, low, high) - first) * (rank - below)


def _ranked(rows: DataFrame, rank: int, low: float, high: float) -> float:
    """Value at a rank counted from 0.

    Each round counts the rows per bin of the remaining value range (at most 4,096 counts reach
    the driver) and narrows the range to the bin that holds the rank, which always leaves out the
    lowest or the highest value.
    """
    skipped = 0
    while low < high:
        inside = rows.filter(F.col("v").between(low, high))
        share = (F.col("v") - F.lit(low)) / F.lit(high - low)
        bins = (
            inside.groupBy(F.least(F.floor(share * BINS), F.lit(BINS - 1)).alias("bin"))
            .agg(F.sum("w").alias("w"), F.min("v").alias("low"), F.max("v").alias("high"))
            .orderBy("bin")
            .collect()
        )
        for row in bins:
            if skipped + row["w"] > rank:
                low, high = row["low"], row["high"]
                break
            skipped += row["w"]
    return low
