"""Near-duplicate documents by SimHash, linked exactly through vantage-point trees.

A fingerprint has a bit for each of 64 positions: 1 if the bit is set in over half the XXH64 hashes
(seed 42, UTF-8) of the lower-cased text's 3-word shingles, repeats included. Documents with one
fingerprint are one code. Codes that differ in BITS bits or fewer are linked.

A vantage-point tree deals the codes to shards. A node holds a vantage code and a radius: codes within
the radius go to the inner side, the others to the outer side. By the triangle inequality two linked
codes on different sides lie within BITS of the border, so outer codes up to radius + BITS are sent to
the inner side as well, and every linked pair meets in some shard. The tree is fitted on a bounded
sample, which decides only how even the shards are; every code is routed. Within a shard the same
tree, now over all its codes, goes on down to buckets of BUCKET codes, which are compared pair by pair.
Codes that no vantage point tells apart (a dense ball) are compared in pairs of blocks. A shard
gives links that connect what it found, at most one per code and bucket.

Bounds: the sample and the tree (SAMPLE codes per shard, up to MOST_SHARDS shards: 32 MB and 2 MB), codes
of one task (two blocks of TASK_CODES; a larger shard is dealt as pairs of blocks), fingerprints or
components that hold over a thousandth of all rows (fewer than 1,000; their rows are joined by
broadcast, so that no task gets all copies of one text).

Defined results: null and empty texts and texts of white space have fingerprint 0 and are linked like
any other; one or two words are one shingle. A null ``doc_id`` is never the smallest; the component of
rows without any id is null. Repeated rows are rows each. Texts of any length are handled whole, one
text within one task. Other columns are not looked at; those named in ``keep`` are passed on and must
not have the name of a result. An empty table gives an empty table.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logquarry.llm import blocks as B
from logquarry.llm import text as T
from logquarry.llm.components import components

SHINGLE, SEED, BITS = 3, 42, 2
BLOCK = 2 << 20
# Shingles whose bits are counted at once.
PIECE = 1 << 16
# Codes of a shard, about, while the tree has no more than MOST_SHARDS; SAMPLE codes are drawn for each.
SHARD_CODES, MOST_SHARDS, SAMPLE = 4096, 1 << 17, 32
# Codes of a block of an overfull shard, and codes that are compared pair by pair.
TASK_CODES, BUCKET = 1 << 20, 512
# Vantage points tried per node, and the share of the codes that a side must leave behind.
TRIALS, GAIN = 4, 0.1
# Keys with more than one row in HOT_SHARE are joined by broadcast.
HOT_SHARE = 1000


def _normal(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[bytes, np.ndarray, np.ndarray]:
    """The words with one space after each: (bytes, starts, ends)."""
    lengths = ends - starts + 1
    flat = np.append(data, np.uint8(32))[T.ranges(starts, lengths)]
    stops = np.cumsum(lengths)
    flat[stops - 1] = 32
    return flat.tobytes(), stops - lengths, stops - 1


def fingerprints(column) -> np.ndarray:
    """One 64-bit code per text, as signed integers."""
    data, offsets = T.text_bytes(column)
    starts, ends, first = T.spans(data, offsets, T.NOT_SPACE)
    flat, starts, ends = _normal(T.LOWER[data], starts, ends)
    counts = np.diff(first)
    docs = len(counts)
    shingles = np.where(counts > 0, np.maximum(counts - SHINGLE + 1, 1), 0)
    doc = np.repeat(np.arange(docs), shingles)
    head = T.ranges(first[:-1], shingles)
    tail = np.minimum(head + SHINGLE, first[doc + 1]) - 1
    ones = np.zeros((docs, 64), np.int64)
    for i in range(0, len(head), PIECE):
        spans = zip(starts[head[i : i + PIECE]].tolist(), ends[tail[i : i + PIECE]].tolist())
        hashes = np.array([xxhash.xxh64_intdigest(flat[a:b], SEED) for a, b in spans], np.uint64)
        of = doc[i : i + PIECE]
        cuts = np.flatnonzero(np.diff(of, prepend=-1))
        bits = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones[of[cuts]] += np.add.reduceat(bits, cuts, axis=0, dtype=np.int64)
    set_ = (2 * ones > shingles[:, None]).astype(np.uint8)
    return np.packbits(set_, axis=1, bitorder="little").view("<u8").ravel().astype(np.uint64).view(np.int64)


def _prints(docs: DataFrame, keep: tuple[str, ...]) -> DataFrame:
    def run(batches):
        for block in T.blocks(batches, "text", BLOCK):
            out = {"doc_id": block.column("doc_id"), "code": pa.array(fingerprints(block.column("text")))}
            yield from pa.table(out | {f"keep_{c}": block.column(f"keep_{c}") for c in keep}).to_batches()

    kept = [F.col(c).alias(f"keep_{c}") for c in keep]
    asked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *kept)
    return asked.mapInArrow(run, T.schema("doc_id long, code long", docs.select(*kept)))


def split(codes: np.ndarray, bits: int) -> tuple[np.uint64, int] | None:
    """The vantage code and radius that split best; None if no side would be clearly smaller."""
    best, found = (1 - GAIN) * len(codes), None
    for trial in range(TRIALS):
        vantage = codes[(2 * trial + 1) * len(codes) // (2 * TRIALS)]
        within = np.cumsum(np.bincount(np.bitwise_count(codes ^ vantage), minlength=65))
        inner = within[np.minimum(np.arange(65) + bits, 64)]
        larger = np.maximum(inner, len(codes) - within)
        radius = int(larger.argmin())
        if larger[radius] < best:
            best, found = larger[radius], (vantage, radius)
    return found


class Tree:
    """Vantage-point tree whose leaves are shards; children below zero are shards, -1 - number."""

    def __init__(self, sample: np.ndarray, shards: int, bits: int):
        self.bits, self.vantage, self.radius, self.inner, self.outer = bits, [], [], [], []
        self.shards = 0
        self.root = self._grow(np.unique(sample), shards)
        self.vantage = np.array(self.vantage, np.uint64)
        self.radius, self.inner, self.outer = (np.array(x, np.int64) for x in (self.radius, self.inner, self.outer))

    def _grow(self, codes: np.ndarray, shards: int) -> int:
        cut = split(codes, self.bits) if shards > 1 and len(codes) > 1 else None
        if cut is None:
            self.shards += 1
            return -self.shards
        node = len(self.vantage)
        distance = np.bitwise_count(codes ^ cut[0])
        for held, value in ((self.vantage, cut[0]), (self.radius, cut[1]), (self.inner, 0), (self.outer, 0)):
            held.append(value)
        # Shards in the proportion of what is beyond doubt on either side.
        outer = codes[distance > cut[1]]
        share = min(shards - 1, max(1, round(shards * len(outer) / len(codes))))
        self.inner[node] = self._grow(codes[distance <= cut[1] + self.bits], shards - share)
        self.outer[node] = self._grow(outer, share)
        return node

    def route(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place, shard): every shard that the code at a place has to be in."""
        place, node = np.arange(len(codes)), np.full(len(codes), self.root)
        places, shards = [], []
        while True:
            done = node < 0
            places.append(place[done])
            shards.append(-1 - node[done])
            place, node = place[~done], node[~done]
            if not len(place):
                return np.concatenate(places), np.concatenate(shards)
            distance = np.bitwise_count(codes[place] ^ self.vantage[node])
            inner, outer = distance <= self.radius[node] + self.bits, distance > self.radius[node]
            place, node = (
                np.concatenate([place[inner], place[outer]]),
                np.concatenate([self.inner[node[inner]], self.outer[node[outer]]]),
            )


def _stars(codes: np.ndarray, at: np.ndarray, bits: int) -> np.ndarray:
    """(member, root) pairs of ``at`` that connect what is linked among the codes there."""
    near = np.bitwise_count(codes[at][:, None] ^ codes[at][None, :]) <= bits
    label = np.arange(len(at))
    lonely = near.sum(axis=1) == 1
    if lonely.all():
        return np.empty((0, 2), np.int64)
    use = np.flatnonzero(~lonely)
    near = near[np.ix_(use, use)]
    label = np.arange(len(use))
    while True:
        least = np.where(near, label[None, :], len(use)).min(axis=1)
        if (least == label).all():
            break
        label = least[least]
    linked = np.flatnonzero(label != np.arange(len(use)))
    return np.stack([at[use[linked]], at[use[label[linked]]]], axis=1)


def links_within(codes: np.ndarray, bits: int) -> np.ndarray:
    """(i, j) places in ``codes`` (distinct) whose links connect all that are within ``bits`` of each other."""
    found = [np.empty((0, 2), np.int64)]
    waiting = [np.arange(len(codes))]
    while waiting:
        at = waiting.pop()
        cut = split(codes[at], bits) if len(at) > BUCKET else None
        if cut is not None:
            distance = np.bitwise_count(codes[at] ^ cut[0])
            waiting += [at[distance <= cut[1] + bits], at[distance > cut[1]]]
            continue
        parts = [at[i : i + BUCKET] for i in range(0, len(at), BUCKET)]
        for i, part in enumerate(parts):
            if len(parts) == 1:
                found.append(_stars(codes, part, bits))
            for other in parts[i + 1 :]:
                found.append(_stars(codes, np.concatenate([part, other]), bits))
    return _forest(np.concatenate(found), len(codes))


def _forest(links: np.ndarray, n: int) -> np.ndarray:
    """(place, root) pairs, one for each place that the links connect to a smaller one."""
    label = np.arange(n)
    while True:
        ends = label[links]
        least = ends.min(axis=1)
        before = label.copy()
        for side in (0, 1):
            np.minimum.at(label, ends[:, side], least)
        label = label[label]
        if (label == before).all():
            break
    linked = np.flatnonzero(label != np.arange(n))
    return np.stack([linked, label[linked]], axis=1)


def _code_links(codes: DataFrame, n: int, bits: int) -> DataFrame:
    """(a, b) codes; the links connect all codes that are within ``bits`` of each other."""
    spark = codes.sparkSession
    shards = min(MOST_SHARDS, -(-n // SHARD_CODES))
    # A bounded number of codes, by hash.
    share = int(min(1.0, SAMPLE * shards / max(n, 1)) * (1 << 31))
    sample = codes.filter(F.pmod(F.xxhash64("code"), F.lit(1 << 31)) <= share).select("code").limit(2 * SAMPLE * shards)
    tree = Tree(sample.toArrow().column("code").to_numpy().view(np.uint64), shards, bits)
    held = spark.sparkContext.broadcast(tree)

    def route(batches):
        for batch in batches:
            code = batch.column("code").to_numpy()
            place, shard = held.value.route(code.view(np.uint64))
            yield pa.RecordBatch.from_pydict({"shard": pa.array(shard, pa.int32()), "code": pa.array(code[place])})

    dealt = B.written(codes.select("code").mapInArrow(route, "shard int, code long"), "codes")
    parts = dealt.groupBy("shard").agg(F.ceil(F.count("*") / TASK_CODES).cast("int").alias("parts"))
    own = dealt.join(parts, "shard").withColumn("i", F.pmod(F.xxhash64("code"), F.col("parts")).cast("int"))
    # Block i of a shard meets every other block; a shard of one block is one task.
    met = own.select("shard", "code", "i", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("j"), "parts")
    met = met.filter("parts = 1 or i <> j").select("shard", "code", F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j"))

    def of_shard(table: pa.Table) -> pa.Table:
        code = np.sort(table.column("code").to_numpy())
        links = links_within(code.view(np.uint64), bits)
        T.give_back()
        return pa.table({"a": pa.array(code[links[:, 0]]), "b": pa.array(code[links[:, 1]])})

    return met.groupBy("shard", "i", "j").applyInArrow(of_shard, "a long, b long")


def _spread_join(left: DataFrame, right: DataFrame, key: str, total: int) -> DataFrame:
    """Inner join on a key that is unique on the right, where ``rows`` counts its rows of the left.

    Fewer than HOT_SHARE keys can hold more than total / HOT_SHARE rows each; these are broadcast.
    """
    hot, cold = right.filter(F.col("rows") * HOT_SHARE > total), right.filter(F.col("rows") * HOT_SHARE <= total)
    rest = left.join(F.broadcast(hot.select(key)), key, "left_anti")
    return left.join(F.broadcast(hot), key).unionByName(rest.join(cold, key)).drop("rows")


def near_duplicates(docs: DataFrame, bits: int = BITS, keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, fingerprint, component_id) of every document; then the columns ``keep``.

    ``fingerprint`` has 16 hexadecimal digits. ``component_id`` is the smallest ``doc_id`` reachable over
    links of ``bits`` differing bits or fewer.
    """
    B.prepare(docs.sparkSession)
    prints = B.written(_prints(docs, keep), "prints")
    codes = B.written(prints.groupBy("code").agg(F.min("doc_id").alias("least"), F.count("*").alias("rows")), "codes")
    n = codes.count()
    # XXH64 of one 64-bit integer is a bijection, so the hashes are names of the codes.
    links = _code_links(codes, n, bits).select(F.xxhash64("a").alias("a"), F.xxhash64("b").alias("b"))
    roots = components(links).withColumnRenamed("v", "name")
    named = codes.withColumn("name", F.xxhash64("code")).join(roots, "name", "left")
    named = B.written(named.select("code", "least", "rows", F.coalesce("root", "name").alias("root")), "named")
    groups = named.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("rows"))
    of_code = _spread_join(named.withColumnRenamed("rows", "of_code"), groups, "root", n)
    of_code = of_code.select("code", "component_id", F.col("of_code").alias("rows"))
    found = _spread_join(prints, of_code, "code", prints.count())
    return found.select(
        "doc_id",
        F.lpad(F.lower(F.hex("code")), 16, "0").alias("fingerprint"),
        "component_id",
        *(F.col(f"keep_{c}").alias(c) for c in keep),
    )
