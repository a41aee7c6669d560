"""Exact top-k by integer inner product with MaxScore over sharded posting lists.

A component of a vector is a term, its integer value the weight. Vectors are dealt to shards by hash;
a shard keeps, per term, the postings (vector, weight) of its vectors and the largest and smallest
weight. For a query the terms are ordered by the most they can add (score bound). While the best k so
far have a lowest score, the terms at the end of that order whose bounds together cannot reach it are
non-essential: only postings of essential terms are traversed, and the others are probed, term by
term, for vectors that can still compete. Whenever a shard has traversed the essential terms it scores
the k vectors that lead so far in full; the worst of them raises the bar before the others are probed, and
again halfway. Each shard gives its k best per query; shards are merged.

Queries go to the shards in blocks of QUERY_BLOCK, so the work is queries times vectors, in blocks.
All shards start from a threshold: the k-th best score among a bounded sample of vectors, which is a
lower bound of the final one and so cannot lose a result.

Defined results: a vector that is null or has a null, NaN or infinite component takes no part, nor
does a row without id. Vectors may differ in length; missing components add nothing. Rows that share
the id of the query are its own row; a query is a row, so each of several with one id has its ranks;
repeated candidates are candidates each. Ties go to the smaller id. Components must stay below 2**31 after scaling. An empty
table gives an empty table; empty vectors score 0.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from logquarry.llm import blocks as B
from logquarry.llm import text as T

SHARD_VECTORS = 4096
QUERY_BLOCK = 512
# Queries that meet a shard in one task; more queries meet it in several.
TASK_QUERIES = 1 << 16
# Vectors whose scores give the first threshold.
SEEDS = 1024
BEST = "key long, query_id long, vec_id long, score long"


class Shard:
    """Posting lists of some vectors (rows of ``weights``, 0 where a term is absent)."""

    def __init__(self, ids: np.ndarray, weights: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids, self.weights = ids[order], np.ascontiguousarray(weights[order].T)
        self.postings = []
        for row in self.weights:
            at = np.flatnonzero(row)
            self.postings.append((at, row[at]))
        none = np.zeros(len(self.weights), np.int64)
        self.most = self.weights.max(axis=1, initial=0) if len(ids) else none
        self.least = self.weights.min(axis=1, initial=0) if len(ids) else none

    def top(self, query: np.ndarray, own: int, k: int, threshold: int | None) -> tuple[np.ndarray, np.ndarray]:
        """(ids, scores) of at least all vectors among the best k that score ``threshold`` or more."""
        terms = np.flatnonzero(query)
        terms = terms[terms < len(self.weights)]
        # An absent term adds 0, which most and least allow for.
        bounds = np.maximum(query[terms] * self.most[terms], query[terms] * self.least[terms])
        order = np.argsort(-bounds, kind="stable")
        terms, bounds = terms[order], bounds[order]
        rest = np.concatenate([np.cumsum(bounds[::-1])[::-1], [0]])
        # The last terms that together stay below the threshold are non-essential.
        essential = len(terms) if threshold is None or threshold <= 0 else int(np.searchsorted(-rest, -threshold, "right"))
        essential = min(essential, len(terms))
        scores = np.zeros(len(self.ids), np.int64)
        seen = np.zeros(len(self.ids), bool)
        for term in terms[:essential].tolist():
            at, weights = self.postings[term]
            scores[at] += query[term] * weights
            seen[at] = True
        if threshold is None or threshold <= 0:
            seen[:] = True  # vectors without any common term score 0 and may compete
        seen &= self.ids != own
        live = np.flatnonzero(seen)
        partial = scores[live]
        for i in range(essential, len(terms)):
            if i in (essential, (essential + len(terms)) // 2) and len(live) > k:
                lead = np.argpartition(-partial, k - 1)[:k]
                whole = partial[lead] + query[terms[i:]] @ self.weights[terms[i:]][:, live[lead]]
                threshold = max(threshold, int(whole.min()))
            compete = partial + rest[i] >= threshold
            live, partial = live[compete], partial[compete]
            partial = partial + query[terms[i]] * self.weights[terms[i], live]
        if threshold is not None:
            live, partial = live[partial >= threshold], partial[partial >= threshold]
        best = np.lexsort((self.ids[live], -partial))[:k]
        return self.ids[live[best]], partial[best]


def _integers(vectors: DataFrame, scale: int) -> DataFrame:
    """(vec_id, terms): scaled integer components of the vectors that take part."""
    bad = F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    takes_part = F.col("vec_id").isNotNull() & ~F.coalesce(bad, F.lit(True))  # null for a null vector
    return vectors.filter(takes_part).select(
        "vec_id", F.transform("vector", lambda x: F.floor(x * F.lit(scale))).alias("terms")
    )


def _matrix(rows: list[list[int]], width: int = 0) -> np.ndarray:
    width = max([width, *map(len, rows)])
    out = np.zeros((len(rows), width), np.int64)
    for i, row in enumerate(rows):
        out[i, : len(row)] = row
    return out


def search(vectors: DataFrame, queries: DataFrame, k: int = 5, scale: int = 256) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best vectors of every query.

    Both tables need ``vec_id`` and ``embedding`` (array of numbers).
    """
    spark = B.prepare(vectors.sparkSession)

    def integers(df: DataFrame) -> DataFrame:
        return _integers(df.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("vector")), scale)

    def numbered(batches):
        keys = B.chunk_ids()
        for batch in batches:
            yield batch.append_column("key", pa.array([next(keys) for _ in range(len(batch))], pa.int64()))

    candidates = integers(vectors)
    asked = B.written(integers(queries).mapInArrow(numbered, "vec_id long, terms array<long>, key long"), "queries")
    n = candidates.count()
    shards = max(1, -(-n // SHARD_VECTORS))
    rounds = max(1, -(-asked.count() // TASK_QUERIES))
    # A bounded number of vectors, by hash; more of equal hash do no harm.
    share = int(min(1.0, SEEDS / max(n, 1)) * (1 << 31))
    seeds = candidates.filter(F.pmod(F.xxhash64("vec_id"), F.lit(1 << 31)) < share).limit(4 * SEEDS).toArrow()
    seed_ids = seeds.column("vec_id").to_numpy()
    held = spark.sparkContext.broadcast((seed_ids, _matrix(seeds.column("terms").to_pylist())))

    def query_blocks(batches):
        first = Shard(*held.value)
        for batch in batches:
            for i in range(0, len(batch), QUERY_BLOCK):
                part = batch.slice(i, QUERY_BLOCK)
                ids, rows = part.column("vec_id").to_numpy(), _matrix(part.column("terms").to_pylist())
                floors = []
                for own, row in zip(ids.tolist(), rows):
                    _, scores = first.top(row, own, k, None)
                    floors.append(int(scores[-1]) if len(scores) == k else None)
                body = B.to_ipc(pa.table({"key": part.column("key"), "vec_id": part.column("vec_id"), "terms": part.column("terms"), "floor": pa.array(floors, pa.int64())}))
                first_key = part.column("key")[0].as_py()
                turn = int(T.splitmix(np.array([first_key], np.uint64))[0]) % rounds
                for shard in range(turn, shards * rounds, rounds):
                    yield pa.RecordBatch.from_pydict(
                        {"shard": pa.array([shard], pa.int32()), "chunk": pa.array([first_key], pa.int64()), "body": pa.array([body], pa.binary())}
                    )

    def of_shard(key, left, right):
        ids, scores, owners, keys = [], [], [], []
        shard = Shard(left.column("vec_id").to_numpy(), _matrix(left.column("terms").to_pylist()))
        for body in right.column("body").to_pylist():
            block = B.unpacked(body)
            rows = _matrix(block.column("terms").to_pylist())
            for key_, own, row, floor in zip(*(block.column(c).to_pylist() for c in ("key", "vec_id")), rows, block.column("floor").to_pylist()):
                found, points = shard.top(row, own, k, floor)
                ids.append(found)
                scores.append(points)
                owners.append(np.full(len(found), own))
                keys.append(np.full(len(found), key_))
        flat = [np.concatenate(x).astype(np.int64) if x else np.empty(0, np.int64) for x in (keys, owners, ids, scores)]
        return pa.table(dict(zip(("key", "query_id", "vec_id", "score"), map(pa.array, flat))))

    # Dealt by row and not by id: a repeated id must not fill one shard.
    row = F.xxhash64("vec_id", F.monotonically_increasing_id())
    home = F.pmod(row, F.lit(shards)).cast("int") * rounds
    dealt = candidates.select("vec_id", "terms", F.explode(F.sequence(home, home + rounds - 1)).alias("shard"))
    blocks = asked.mapInArrow(query_blocks, B.REQUESTS)
    best = dealt.groupBy("shard").cogroup(blocks.groupBy("shard")).applyInArrow(of_shard, BEST)
    order = Window.partitionBy("key").orderBy(F.desc("score"), "vec_id")
    return best.select("query_id", F.row_number().over(order).alias("rank"), "vec_id", "score").filter(F.col("rank") <= k)
