"""The message queue on Parquet: an inbox table and a ledger of processed batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logquarry.functions.timerange import Instant
from logquarry.operators import inbox as ops
from logquarry.schema import INBOX, PROCESSED
from logquarry.session import materialise
from logquarry.sources.files import VersionedTable


class Inbox:
    """Append batches, take the oldest pending ones, clean up. One writer at a time is assumed."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.batches = VersionedTable(spark, f"{path}/inbox", INBOX)
        self.ledger = VersionedTable(spark, f"{path}/processed", PROCESSED)

    def _next_id(self) -> int:
        """One past the highest id ever given, also when that batch was cleaned up since."""
        highest = [
            table.read().agg(F.max("id")).first()[0] for table in (self.batches, self.ledger)
        ]
        return max((h for h in highest if h is not None), default=-1) + 1

    def enqueue(self, lines: DataFrame, as_of: Instant = None, size: int = ops.MAX_BATCH) -> bool:
        """Store lines (seq, content) as batches; False when there is none."""
        batches = materialise(ops.enqueue_lines(lines, as_of, self._next_id(), size))
        if batches.isEmpty():
            return False
        self.batches.append(batches)
        return True

    def take(self, n: int = ops.DEFAULT_NEXT, as_of: Instant = None) -> DataFrame:
        """The oldest pending batches, marked as processed."""
        taken = materialise(ops.next_batches(self.batches.read(), self.ledger.read(), n))
        self.ledger.append(ops.mark_processed(taken, as_of))
        return taken

    def stats(self) -> DataFrame:
        return ops.inbox_stats(self.batches.read(), self.ledger.read())

    def clean_up(self, hours: float = ops.DEFAULT_CLEANUP_HOURS, as_of: Instant = None) -> None:
        """Drop processed batches of that age from the inbox.

        The ledger keeps its rows: should the second table be written without the first, an id
        without a ledger row would be processed again.
        """
        rest = ops.after_cleanup(self.batches.read(), self.ledger.read(), hours, as_of)
        self.batches.replace(rest)
