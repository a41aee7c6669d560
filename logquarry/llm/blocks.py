"""Blocks of texts that ask sharded tables and get answers: the shape several operators share.

A block is one row of some megabytes: its texts, or what is needed of them, as local ids. For each
shard it sends one row with its distinct keys. The task of a shard sees the keys of all blocks
together, and answers each block in the order of its keys. So a key crosses the network once per
block and not once per occurrence, which also bounds what a hot key brings to its shard.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logquarry.llm import text as T
from logquarry.session import configure, scratch_path

REQUESTS = "shard int, chunk long, body binary"
# Keys that one shard holds, about; at least LEAST_SHARDS shards spread small inputs.
SHARD_KEYS = 1_000_000
LEAST_SHARDS = 64
ARROW = {
    "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
    "spark.sql.execution.arrow.maxBytesPerBatch": str(8 << 20),
}


def prepare(spark: SparkSession) -> SparkSession:
    """Session settings of the operators: Arrow batches bounded in bytes."""
    configure(spark)
    for key, value in ARROW.items():
        spark.conf.set(key, value)
    return spark


def chunk_ids() -> Iterator[int]:
    """Block numbers that no other task gives; the block table is written before it is used."""
    first = TaskContext.get().partitionId() << 32
    while True:
        yield first
        first += 1


def block_table(df: DataFrame, name: str) -> DataFrame:
    """Blocks as a table bucketed by block in the shared scratch folder.

    ``combine`` then reads the blocks where they lie, and only the answers are shuffled.
    """
    spark = df.sparkSession
    path, buckets = scratch_path(spark, name), int(spark.conf.get("spark.sql.shuffle.partitions"))
    table = f"{name}_{uuid.uuid4().hex}"
    # The columns of a block are compressed already.
    df.write.bucketBy(buckets, "chunk").option("compression", "none").option("path", path).format("parquet").saveAsTable(table)
    found = spark.table(table)
    spark.sql(f"DROP TABLE {table}")  # only the entry of the catalog; the files stay
    return found


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared scratch folder."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


PACKED = "chunk long, block binary"


def to_ipc(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
        writer.write_table(table)
    return sink.getvalue().to_pybytes()


def unpacked(blob: bytes) -> pa.Table:
    return pa.ipc.open_stream(blob).read_all()


def packed(tables: Iterator[pa.Table]) -> Iterator[pa.RecordBatch]:
    """Blocks with all their columns, one row each."""
    for chunk, block in zip(chunk_ids(), tables):
        yield pa.RecordBatch.from_pydict(
            {"chunk": pa.array([chunk], pa.int64()), "block": pa.array([to_ipc(block)], pa.binary())}
        )


def shard_count(keys: int | None, each: int = SHARD_KEYS) -> int:
    return max(LEAST_SHARDS, -(-(keys or 0) // each))


def total(table: DataFrame, column: str) -> int:
    return table.agg(F.coalesce(F.sum(column), F.lit(0))).first()[0]


def shard_of(hashes: np.ndarray, shards: int) -> np.ndarray:
    """Shards by the leading 32 bits, so that the order of hashes is the order of shards."""
    return ((hashes >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int64)


def runs(homes: np.ndarray) -> dict[int, tuple[int, int]]:
    """{shard: (start, end)} of an ascending array of shards; only shards that occur."""
    cuts = np.flatnonzero(np.diff(homes, prepend=-1)).tolist()
    return {int(homes[a]): (a, b) for a, b in zip(cuts, [*cuts[1:], len(homes)])}


def ask(table: DataFrame, requests: Callable, *columns: str) -> DataFrame:
    """requests(row as dict) yields (shard, bytes) for one block."""

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                out = list(requests(row))
                yield pa.RecordBatch.from_pydict(
                    {
                        "shard": pa.array([s for s, _ in out], pa.int32()),
                        "chunk": pa.array([row["chunk"]] * len(out), pa.int64()),
                        "body": pa.array([b for _, b in out], pa.binary()),
                    }
                )

    return table.select("chunk", *columns).mapInArrow(run, REQUESTS)


def answer(requests: DataFrame, serve: Callable) -> DataFrame:
    """serve(list of bodies, list of blocks) gives one body per request, or None for no answer.

    Bodies beyond those are reports of the shard; they get the block number -1.
    """

    def run(key, table):
        # A fixed order, whatever order the shuffle brought the rows in.
        table = table.sort_by("chunk")
        bodies, chunks = table.column("body").to_pylist(), table.column("chunk").to_pylist()
        out = serve(bodies, chunks)
        T.give_back()
        chunks += [-1] * (len(out) - len(chunks))
        keep = [i for i, body in enumerate(out) if body is not None]
        return pa.table(
            {
                "shard": pa.array([key[0].as_py()] * len(keep), pa.int32()),
                "chunk": pa.array([chunks[i] for i in keep], pa.int64()),
                "body": pa.array([out[i] for i in keep], pa.binary()),
            }
        )

    return requests.groupBy("shard").applyInArrow(run, REQUESTS)


def combine(table: DataFrame, answers: DataFrame, finish: Callable, schema: str) -> DataFrame:
    """finish(block row as dict, {shard: body}) gives the rows of the block as an Arrow table."""

    def run(key, left, right):
        T.give_back()
        bodies = dict(zip(right.column("shard").to_pylist(), right.column("body").to_pylist()))
        return finish(left.to_pylist()[0], bodies)

    return table.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(run, schema)
