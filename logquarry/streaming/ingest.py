"""Messages arriving as files become logs; messages that cannot become logs are set aside."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from logquarry.operators.messages import classify_messages
from logquarry.sources.files import read_or_empty
from logquarry.sources.logs import LogTable
from logquarry.schema import DEAD_LETTER

# How often lines are shipped, messages taken, logs examined and the rule checked.
CONSUME_INTERVAL = "5 seconds"
DETECT_INTERVAL = "30 seconds"
RULE_INTERVAL = "60 seconds"


def trigger(interval: str | None) -> dict[str, object]:
    """Trigger arguments: poll at an interval, or (None) take all there is in batches and stop."""
    return {"availableNow": True} if interval is None else {"processingTime": interval}


def read_stream(
    spark: SparkSession, folder: str, schema: T.StructType | str, glob: str = "*.parquet", max_files: int = 100
) -> DataFrame:
    """Rows of new Parquet files in ``folder``."""
    reader = spark.readStream.schema(schema).option("pathGlobFilter", glob)
    return reader.option("maxFilesPerTrigger", max_files).parquet(folder)


def batch_folder(path: str, checkpoint: str, batch_id: int) -> str:
    """Where a micro-batch writes: a replay of the batch replaces its own folder only.

    Batch numbers start again with a new checkpoint, so the checkpoint is part of the name.
    """
    stream = hashlib.sha256(checkpoint.encode()).hexdigest()[:12]
    return f"{path}/stream={stream}/batch_id={batch_id}"


def dead_letter_table(spark: SparkSession, path: str) -> DataFrame:
    """All dead letters, with the stream and micro-batch that set them aside."""
    origin = [T.StructField("stream", T.StringType()), T.StructField("batch_id", T.LongType())]
    return read_or_empty(spark, path, T.StructType([*DEAD_LETTER.fields, *origin]))


def start_ingest(
    messages: DataFrame,
    logs: LogTable,
    dead_letters: str,
    checkpoint: str,
    interval: str | None = CONSUME_INTERVAL,
    key: tuple[str, ...] = ("id",),
    recheck: bool = True,
) -> StreamingQuery:
    """Normalise streamed messages (key, content) into the log table.

    ``current_timestamp`` is fixed per micro-batch and kept in the checkpoint, and log ids come
    from the content, so a micro-batch that is run again writes the same rows: the log table
    skips known ids, and the dead letters of a batch replace themselves.

    Known ids are looked up in the table's ledger, bucket by bucket. When no message is ever delivered
    twice, only the first micro-batch after a start can be a repetition; ``recheck=False`` looks
    up ids for that one only, which keeps the others independent of the size of the table.
    """
    started = False

    classified = classify_messages(messages, key=key).withColumn("failed_at", F.current_timestamp())

    def store(batch: DataFrame, batch_id: int) -> None:
        nonlocal started
        batch = batch.persist()
        failed = batch.filter(F.col("reject_reason").isNotNull()).select(
            *key, "content", F.col("reject_reason").alias("reason"), "failed_at"
        )
        failed.write.mode("overwrite").parquet(batch_folder(dead_letters, checkpoint, batch_id))
        accepted = batch.filter(F.col("reject_reason").isNull())
        logs.append_new(
            accepted.drop("id").withColumnRenamed("log_id", "id"), look_up=recheck or not started
        )
        started = True
        batch.unpersist()

    return (
        classified.writeStream.queryName("ingest")
        .foreachBatch(store)
        .option("checkpointLocation", checkpoint)
        .trigger(**trigger(interval))
        .start()
    )
