"""Hard negatives by exact inner products with coordinate pruning over length buckets (after LEMP).

Vectors become integers and are dealt to buckets of similar length; large buckets are cut into shards by
hash. A shard holds, for every coordinate, its vectors ordered by that coordinate of their direction. For
an anchor that looks for scores of at least ``low``, a bucket whose longest vector cannot reach ``low`` is
skipped before anything is sent to it. Otherwise ``low`` bounds the angle between both directions by theta,
and so each coordinate of a candidate: if an anchor's direction has angle alpha to an axis, that of the
candidate lies in [alpha - theta, alpha + theta]. The FOCUS coordinates where the anchor is largest give
ranges of their ordered lists; the shortest is taken and the others are intersected with it. What is left
is verified by exact integer scores.

Two searches use it. The first finds each anchor's best vectors of its own label (the positives). The
second finds, for every positive, the best vectors of other labels whose score lies between ``least`` and
``most`` percent of the positive's. Both start from a bound that a sample of SEEDS vectors gives: the k-th
best score there is not above the final one, so nothing is lost. Shards give their k best each, which
are merged; anchors meet them in blocks, so the work is anchors times vectors, in blocks.

Defined results: a vector that is null or has a null, NaN or infinite component takes no part, nor does
a row without id or label. Labels are compared as text. Rows that share the anchor's id are not others
of it; repeated anchors are anchors each, repeated vectors are candidates each, and ties go to the
smaller id. Vectors may differ in length; missing components add nothing. Scores must fit a 64-bit
integer. Empty tables give an empty table. Other columns are not looked at.

Bounds: the sample, LENGTHS borders and counts are broadcast or collected; a shard has about SHARD_VECTORS
vectors and meets up to TASK_ANCHORS anchors in one task.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from logquarry.llm import blocks as B

LENGTHS = 32
SHARD_VECTORS = 4096
FOCUS = 3
SEEDS = 1024
ANCHOR_BLOCK = 256
TASK_ANCHORS = 1 << 14
# What rounding of directions and angles may add up to, by far.
SLACK = 1e-6
ROWS = "vec_id long, label string, terms array<long>"


def matrix(rows: list[list[int]], width: int = 0) -> np.ndarray:
    width = max([width, *map(len, rows)])
    out = np.zeros((len(rows), width), np.int64)
    for i, row in enumerate(rows):
        out[i, : len(row)] = row
    return out


class Vectors:
    """Some vectors with their ordered coordinate lists."""

    def __init__(self, table: pa.Table):
        table = table.sort_by("vec_id")
        self.ids = table.column("vec_id").to_numpy()
        names = pc.unique(table.column("label"))
        self.number = {name: i for i, name in enumerate(names.to_pylist())}
        self.label = pc.index_in(table.column("label"), names).to_numpy()
        self.weights = matrix(table.column("terms").to_pylist())
        self.length = np.sqrt((self.weights.astype(float) ** 2).sum(axis=1))
        self.zero = np.flatnonzero(self.length == 0)
        self.longest, self.shortest = self.length.max(initial=0.0), self.length.min(initial=np.inf)
        self.unit = np.ascontiguousarray((self.weights / np.maximum(self.length, 1.0)[:, None]).T)
        self.lists = np.argsort(self.unit, axis=1, kind="stable")
        self.values = np.take_along_axis(self.unit, self.lists, axis=1)

    def __len__(self) -> int:
        return len(self.ids)

    def feasible(self, query: np.ndarray, low: int | None) -> np.ndarray:
        """Places of all vectors that may score ``low`` or more, ascending."""
        norm = float(np.sqrt((query.astype(float) ** 2).sum()))
        if low is None or not len(self):
            return np.arange(len(self))
        if norm == 0 or self.longest == 0:
            return np.arange(len(self) if low <= 0 else 0)
        # Of all lengths here the one that asks for the widest angle.
        length = self.longest if low > 0 else self.shortest
        cosine = low / (norm * length) - SLACK if length > 0 else -1.0
        if cosine > 1:
            return np.empty(0, np.int64)
        if cosine <= -1:
            return np.arange(len(self))
        theta = np.arccos(cosine)
        width = min(len(query), len(self.unit))
        focus = np.argsort(-np.abs(query[:width]), kind="stable")[:FOCUS]
        alpha = np.arccos(np.clip(query[focus] / norm, -1, 1))
        bottom = np.cos(np.minimum(alpha + theta, np.pi)) - SLACK
        top = np.cos(np.maximum(alpha - theta, 0.0)) + SLACK
        ranges = [
            (int(np.searchsorted(self.values[f], a, "left")), int(np.searchsorted(self.values[f], b, "right")))
            for f, a, b in zip(focus.tolist(), bottom, top)
        ]
        if not ranges:
            return np.arange(len(self))
        first = min(range(len(ranges)), key=lambda i: ranges[i][1] - ranges[i][0])
        at = self.lists[focus[first], slice(*ranges[first])]
        for i, f in enumerate(focus.tolist()):
            if i != first:
                value = self.unit[f, at]
                at = at[(value >= bottom[i]) & (value <= top[i])]
        if low <= 0 and len(self.zero):  # these have no direction
            at = np.union1d(at, self.zero)
        return np.sort(at)

    def scores(self, query: np.ndarray, at: np.ndarray) -> np.ndarray:
        width = min(len(query), self.weights.shape[1])
        return self.weights[at, :width] @ query[:width]

    def best_like(self, own: int, label: str, query: np.ndarray, k: int, low: int | None):
        """(places, scores) of the k best of one label that score ``low`` or more."""
        at = self.feasible(query, low)
        at = at[(self.label[at] == self.number.get(label, -1)) & (self.ids[at] != own)]
        return self._first(at, self.scores(query, at), k, low)

    def best_unlike(self, own: int, label: str, query: np.ndarray, k: int, bands: list[tuple[int, int]]):
        """Per band (low, high) the (places, scores) of the k best of other labels inside it."""
        at = self.feasible(query, min((low for low, _ in bands), default=0))
        at = at[(self.label[at] != self.number.get(label, -1)) & (self.ids[at] != own)]
        scores = self.scores(query, at)
        for low, high in bands:
            inside = scores <= high
            yield self._first(at[inside], scores[inside], k, low)

    def _first(self, at: np.ndarray, scores: np.ndarray, k: int, low: int | None):
        if low is not None:
            at, scores = at[scores >= low], scores[scores >= low]
        best = np.lexsort((self.ids[at], -scores))[:k]
        return at[best], scores[best]


def integers(vectors: DataFrame, scale: int) -> DataFrame:
    """(vec_id, label, terms): scaled integer components of the rows that take part."""
    rows = vectors.select(
        F.col("vec_id").cast("long").alias("vec_id"),
        F.col("label").cast("string").alias("label"),
        F.col("embedding").cast("array<double>").alias("vector"),
    )
    bad = F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    part = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & ~F.coalesce(bad, F.lit(True))
    terms = F.transform("vector", lambda x: F.floor(x * F.lit(scale)))
    return rows.filter(part).select("vec_id", "label", terms.alias("terms"))


def _band(score: int, least: int, most: int) -> tuple[int, int]:
    """Integers s with least * score <= 100 * s <= most * score."""
    return -((-least * score) // 100), most * score // 100


class _Plan:
    """Length buckets, their shards, and what every task starts from."""

    def __init__(self, vectors: DataFrame):
        spark = vectors.sparkSession
        length = F.sqrt(F.aggregate("terms", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
        sized = vectors.withColumn("length", length)
        shares = [i / LENGTHS for i in range(1, LENGTHS)]
        row = sized.agg(F.percentile_approx("length", shares, 10_000).alias("borders"), F.count("*").alias("n")).first()
        borders, n = sorted(set(row.borders or [])), row.n
        bucket = F.size(F.filter(F.array(*map(F.lit, borders)), lambda x: x < F.col("length"))) if borders else F.lit(0)
        sized = sized.withColumn("bucket", bucket.cast("int"))
        counts = {r.bucket: r for r in sized.groupBy("bucket").agg(F.count("*").alias("n"), F.min("length").alias("low"), F.max("length").alias("high")).collect()}
        self.shards: list[tuple[float, float]] = []  # shortest and longest vector of each shard
        first, parts = [], []
        for b in range(len(borders) + 1):
            first.append(len(self.shards))
            parts.append(max(1, -(-counts[b].n // SHARD_VECTORS)) if b in counts else 1)
            self.shards += [(counts[b].low, counts[b].high) if b in counts else (0.0, 0.0)] * parts[-1]
        at = F.col("bucket") + 1
        firsts, counts_ = (F.element_at(F.array(*map(F.lit, xs)), at) for xs in (first, parts))
        # Dealt by row and not by id: a repeated id must not fill one shard.
        deal = F.pmod(F.xxhash64("vec_id", F.monotonically_increasing_id()), counts_)
        self.dealt = sized.select("vec_id", "label", "terms", (firsts + deal).cast("int").alias("shard"))
        share = int(min(1.0, SEEDS / max(n, 1)) * (1 << 31))
        seeds = vectors.filter(F.pmod(F.xxhash64("vec_id"), F.lit(1 << 31)) <= share).limit(4 * SEEDS)
        self.held = spark.sparkContext.broadcast(seeds.toArrow())


def _search(plan: _Plan, anchors: DataFrame, rounds: int, bound, serve, schema: str) -> DataFrame:
    """bound(seeds, row, query) adds what a row starts from and gives its least score, or skips with False;
    serve(shard, row, query) gives columns of results."""
    held, lengths = plan.held, np.array(plan.shards)

    def ask(batches):
        seeds = Vectors(held.value)
        for batch in batches:
            for i in range(0, len(batch), ANCHOR_BLOCK):
                rows = batch.slice(i, ANCHOR_BLOCK).to_pylist()
                lows = [bound(seeds, row, np.array(row["terms"], np.int64)) for row in rows]
                turn = rows[0]["key"] % rounds
                norms = [float(np.sqrt((np.array(row["terms"], float) ** 2).sum())) for row in rows]
                for shard, (_, longest) in enumerate(lengths.tolist()):
                    reach = [
                        row for row, low, norm in zip(rows, lows, norms)
                        if low is not False and (low is None or low <= norm * longest * (1 + SLACK) + SLACK)
                    ]
                    if reach:
                        body = B.to_ipc(pa.Table.from_pylist(reach))
                        yield pa.RecordBatch.from_pydict(
                            {"shard": pa.array([shard * rounds + turn], pa.int32()), "chunk": pa.array([rows[0]["key"]], pa.int64()), "body": pa.array([body], pa.binary())}
                        )

    def of_shard(key, left, right):
        shard, out = Vectors(left), []
        for body in right.column("body").to_pylist():
            for row in B.unpacked(body).to_pylist():
                out += serve(shard, row, np.array(row["terms"], np.int64))
        names = [part.split()[0] for part in schema.split(", ")]
        return pa.table({name: pa.array([row[i] for row in out], pa.int64()) for i, name in enumerate(names)})

    home = F.col("shard") * rounds
    dealt = plan.dealt.select("vec_id", "label", "terms", F.explode(F.sequence(home, home + rounds - 1)).alias("shard"))
    asked = anchors.mapInArrow(ask, B.REQUESTS)
    return dealt.groupBy("shard").cogroup(asked.groupBy("shard")).applyInArrow(of_shard, schema)


def mine(
    vectors: DataFrame,
    anchors: DataFrame,
    positives: int = 5,
    negatives: int = 10,
    least: int = 30,
    most: int = 90,
    scale: int = 256,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    For every anchor its ``positives`` best others of the same label, and for each of them the
    ``negatives`` best rows of other labels with least * positive <= 100 * negative <= most * positive.
    Both tables need ``vec_id``, ``label`` and ``embedding`` (array of numbers).
    """
    spark = B.prepare(vectors.sparkSession)
    candidates = integers(vectors, scale)

    def numbered(batches):
        keys = B.chunk_ids()
        for batch in batches:
            yield batch.append_column("key", pa.array([next(keys) for _ in range(len(batch))], pa.int64()))

    asked = B.written(integers(anchors, scale).mapInArrow(numbered, ROWS + ", key long"), "anchors")
    plan = _Plan(candidates)
    rounds = max(1, -(-asked.count() // TASK_ANCHORS))

    def positive_bound(seeds, row, query):
        _, scores = seeds.best_like(row["vec_id"], row["label"], query, positives, None)
        row["low"] = int(scores[-1]) if len(scores) == positives else None
        return row["low"]

    def find_positives(shard, row, query):
        at, scores = shard.best_like(row["vec_id"], row["label"], query, positives, row["low"])
        return [(row["key"], i, s) for i, s in zip(shard.ids[at].tolist(), scores.tolist())]

    found = _search(plan, asked, rounds, positive_bound, find_positives, "key long, positive_id long, score long")
    order = Window.partitionBy("key").orderBy(F.desc("score"), "positive_id")
    best = found.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= positives)
    lists = best.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("place", "positive_id", "score"))).alias("positives"))
    paired = B.written(asked.join(lists, "key"), "positives")

    def negative_bound(seeds, row, query):
        bands = [_band(p["score"], least, most) for p in row["positives"]]
        firm = [low for low, _ in bands]
        for j, (_, scores) in enumerate(seeds.best_unlike(row["vec_id"], row["label"], query, negatives, bands)):
            if len(scores) == negatives:
                firm[j] = max(firm[j], int(scores[-1]))
        row["bands"] = [{"low": low, "high": high} for low, (_, high) in zip(firm, bands)]
        open_ = [b["low"] for b in row["bands"] if b["low"] <= b["high"]]
        return min(open_) if open_ else False

    def find_negatives(shard, row, query):
        out = []
        # Bands that hold nothing do not widen the search.
        kept = [(p, (b["low"], b["high"])) for p, b in zip(row["positives"], row["bands"]) if b["low"] <= b["high"]]
        groups = shard.best_unlike(row["vec_id"], row["label"], query, negatives, [band for _, band in kept])
        for (p, _), (at, scores) in zip(kept, groups):
            out += [(row["key"], p["place"], row["vec_id"], p["positive_id"], p["score"], i, s) for i, s in zip(shard.ids[at].tolist(), scores.tolist())]
        return out

    schema = "key long, place long, anchor_id long, positive_id long, positive_score long, negative_id long, negative_score long"
    found = _search(plan, paired, rounds, negative_bound, find_negatives, schema)
    order = Window.partitionBy("key", "place").orderBy(F.desc("negative_score"), "negative_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= negatives)
    return ranked.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
