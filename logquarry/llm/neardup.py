"""Near-duplicate documents: one-permutation MinHash, banded buckets, star-shaped candidate links.

Sets of 5-word shingles are named by a 128-bit hash; documents with the same set are one class and
need no comparison. A class goes by the number of one of its rows, which is made random. One hash per shingle fills BINS bins with minima; an empty bin takes the value of
a non-empty one that is chosen by hashing (optimal densification). BANDS bands of ROWS bins give
bucket keys. At the similarity asked for (0.85), two classes miss each other in all bands with
probability below 1e-6.

A bucket links its members to one centre, not to each other: to the member whose buckets hold the most
members, which in a family of copies is the text they come from. Links are confirmed on the full sets
of both texts. Where a bucket then still holds several components, its members outside the largest one
are a query set that meets all members of the bucket in blocks; full sets are compared in numpy where
they meet, and only links leave the task. So no link between different texts is lost to the stars, and
no pairs are written for what is connected already or not alike.

Members of a popular centre are dealt over several tasks with a copy of the centre each. Exact copies
meet in a partial aggregate.

Defined results: null and empty texts, and texts of white space, have an empty set, are linked with
nothing and are kept. A null ``doc_id`` is never the smallest; a group without any id keeps all its
rows, and rows that repeat the smallest id are all kept. Texts of any length are handled whole. Other
columns are not looked at. An empty table gives an empty table.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logquarry.llm import blocks as B
from logquarry.llm import text as T
from logquarry.llm.components import components

SHINGLE = 5
BANDS, ROWS = 24, 5
BINS = BANDS * ROWS
# Bytes of text whose shingles are taken at once.
BLOCK = 2 << 20
# Attempts to find a non-empty bin by hashing before the next one to the right is taken.
ATTEMPTS = 64
# Members of a centre per task, and members of one side of a block comparison.
STAR_MEMBERS = 250
BLOCK_MEMBERS, BLOCK_SHINGLES = 1024, 1_000_000
SETS = "row long, doc_id long, n long, class binary, signature binary, text string"
BUCKETS = "bucket long, row long, n long"
STAR = "a long, b long, shared long, total long"
EMPTY = np.uint64(T.MASK)


def shingles(column) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, offsets): the distinct shingles of every text, ascending within a text."""
    data, offsets = T.text_bytes(column)
    data = T.LOWER[data]
    starts, ends, first = T.spans(data, offsets, T.NOT_SPACE)
    words = T.hasher().segments(data, starts, ends)
    counts = np.diff(first)
    doc = np.repeat(np.arange(len(counts)), counts)
    hashes = T.windows(words, SHINGLE)
    inside = np.flatnonzero(doc[: len(hashes)] == doc[SHINGLE - 1 :][: len(hashes)])
    found, of = [hashes[inside]], [doc[inside]]
    for n in range(1, SHINGLE):  # short texts are one shingle
        short = np.flatnonzero(counts == n)
        if len(short):
            runs = T.windows(words, n, seed=100 + n)
            found.append(runs[first[short]])
            of.append(short)
    flat, of = np.concatenate(found), np.concatenate(of)
    order = np.lexsort((flat, of))
    flat, of = flat[order], of[order]
    new = np.ones(len(flat), bool)
    new[1:] = (flat[1:] != flat[:-1]) | (of[1:] != of[:-1])
    flat, of = flat[new], of[new]
    return flat, np.searchsorted(of, np.arange(len(counts) + 1))


def set_names(flat: np.ndarray, offsets: np.ndarray) -> list[bytes | None]:
    """A 128-bit name per set, whatever its order; None for empty sets."""
    sums = []
    for salt in (0x1F83D9ABFB41BD6B, 0x5BE0CD19137E2179):
        mixed = np.concatenate([np.zeros(1, np.uint64), np.cumsum(T.splitmix(flat ^ np.uint64(salt)), dtype=np.uint64)])
        sums.append(T.splitmix(mixed[offsets[1:]] - mixed[offsets[:-1]] + np.uint64(salt)))
    names = np.stack(sums, axis=1)
    return [name.tobytes() if n else None for name, n in zip(names, np.diff(offsets).tolist())]


def _probes() -> np.ndarray:
    """The bins that an empty bin tries, by attempt."""
    bins = np.arange(BINS, dtype=np.uint64)
    tries = np.arange(1, ATTEMPTS + 1, dtype=np.uint64) << np.uint64(32)
    return (T.splitmix(bins[:, None] + tries[None, :]) % np.uint64(BINS)).astype(np.int64)


PROBES = _probes()


def signatures(flat: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of BINS minima per set; rows of empty sets hold EMPTY."""
    sets = len(offsets) - 1
    out = np.full(sets * BINS, EMPTY)
    mixed = T.splitmix(flat ^ np.uint64(0x6A09E667F3BCC908))
    of = np.repeat(np.arange(sets), np.diff(offsets))
    bins = ((mixed >> np.uint64(32)) * np.uint64(BINS) >> np.uint64(32)).astype(np.int64)
    np.minimum.at(out, of * BINS + bins, mixed & np.uint64(0xFFFFFFFF))
    out = out.reshape(sets, BINS)
    full = out != EMPTY
    rows, cols = np.nonzero(~full & full.any(axis=1)[:, None])
    dense = out.copy()
    for attempt in range(ATTEMPTS):
        if not len(rows):
            break
        source = PROBES[cols, attempt]
        hit = full[rows, source]
        dense[rows[hit], cols[hit]] = out[rows[hit], source[hit]]
        rows, cols = rows[~hit], cols[~hit]
    step = 0
    while len(rows):
        step += 1
        source = (cols + step) % BINS
        hit = full[rows, source]
        dense[rows[hit], cols[hit]] = out[rows[hit], source[hit]]
        rows, cols = rows[~hit], cols[~hit]
    return dense


def _band_keys(signature: np.ndarray) -> np.ndarray:
    bands = signature.reshape(len(signature), BANDS, ROWS)
    key = np.broadcast_to(np.arange(BANDS, dtype=np.uint64), bands.shape[:2])
    for i in range(ROWS):
        key = T.splitmix(key * np.uint64(0x9E3779B97F4A7C15) + bands[:, :, i])
    return key


def _sets(docs: DataFrame, keep: tuple[str, ...]) -> DataFrame:
    def run(batches):
        at = TaskContext.get().partitionId() << 40
        for block in T.blocks(batches, "text", BLOCK):
            flat, offsets = shingles(block.column("text"))
            rows = T.splitmix(np.arange(at, at + len(block), dtype=np.uint64))
            at += len(block)
            small = (signatures(flat, offsets) & np.uint64(0xFFFF)).astype(np.uint16)
            out = pa.table(
                {
                    "row": pa.array(rows.view(np.int64)),
                    "doc_id": block.column("doc_id"),
                    "n": pa.array(np.diff(offsets), pa.int64()),
                    "class": pa.array(set_names(flat, offsets), pa.binary()),
                    "signature": pa.array([row.tobytes() for row in small], pa.binary()),
                    "text": block.column("text"),
                    **{f"keep_{c}": block.column(f"keep_{c}") for c in others},
                }
            )
            yield from out.to_batches()

    others = [c for c in keep if c != "text"]  # the text is there already
    kept = [F.col(c).alias(f"keep_{c}") for c in others]
    schema = T.schema(SETS, docs.select(*kept))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *kept).mapInArrow(run, schema)


def _buckets(classes: DataFrame) -> DataFrame:
    def run(batches):
        for batch in batches:
            raw = batch.column("signature").to_pylist()
            rows = np.array([np.frombuffer(r, np.uint16) for r in raw]).reshape(len(raw), BINS).astype(np.uint64)
            place = pa.array(np.repeat(np.arange(len(raw)), BANDS))
            yield pa.RecordBatch.from_pydict(
                {
                    "bucket": pa.array(_band_keys(rows).ravel().view(np.int64)),
                    "row": batch.column("row").take(place),
                    "n": batch.column("n").take(place),
                }
            )

    return classes.select("row", "n", "signature").mapInArrow(run, BUCKETS)


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of the pairs (a, b) of classes whose full sets are similar enough.

    ``a`` is the centre. Its members are dealt over tasks of about STAR_MEMBERS, each with the text of
    the centre before those of the members.
    """
    pairs = B.written(pairs, "pairs")
    sizes = pairs.groupBy("a").agg(F.ceil(F.count("*") / STAR_MEMBERS).cast("int").alias("parts"))
    sizes = B.written(sizes, "stars")
    wide = sizes.filter("parts > 1")  # a small share of the pairs
    centres = sizes.select(F.col("a").alias("row"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    members = pairs.join(wide, "a", "left").select(
        F.col("b").alias("row"), "a", F.pmod(F.xxhash64("b"), F.coalesce("parts", F.lit(1))).cast("int").alias("part")
    )
    wanted = members.withColumn("kind", F.lit(1)).unionByName(
        centres.select("row", F.col("row").alias("a"), "part", F.lit(0).alias("kind"))
    )
    rows = wanted.join(sets.select("row", "text"), "row").select("a", "part", "kind", F.col("row").alias("b"), "text")
    dealt = rows.repartition(F.col("a"), F.col("part")).sortWithinPartitions("a", "part", "kind")

    def run(batches):
        centre, own = None, None
        for block in T.blocks(batches, "text", BLOCK):
            flat, offsets = shingles(block.column("text"))
            rows = zip(*(block.column(c).to_pylist() for c in ("a", "kind", "b")))
            found = []
            for i, (a, kind, b) in enumerate(rows):
                mine = flat[offsets[i] : offsets[i + 1]]
                if not kind:
                    centre, own = a, mine
                    continue
                assert centre == a
                at = np.minimum(np.searchsorted(own, mine), len(own) - 1)
                shared = int((own[at] == mine).sum())
                total = len(own) + len(mine) - shared
                if 100 * shared >= percent * total:
                    found.append((a, b, shared, total))
            yield pa.RecordBatch.from_pydict(
                {name: pa.array([row[i] for row in found], kind) for i, (name, kind) in enumerate(
                    (("a", pa.int64()), ("b", pa.int64()), ("shared", pa.int64()), ("total", pa.int64())))}
            )

    return B.written(dealt.mapInArrow(run, STAR), "confirmed")


def _residual(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) of classes that share a bucket and are in different components.

    ``members`` holds (bucket, row, n, root) of buckets with several components. The members outside
    the largest component of a bucket meet all its members, in blocks, and the full sets are compared
    where they meet: only links leave the task.
    """
    parts = members.groupBy("bucket", "root").agg(F.count("*").alias("count"), F.sum("n").alias("n"))
    top = parts.groupBy("bucket").agg(F.max(F.struct("count", "root")).alias("top"), F.sum("count").alias("size"), F.sum("n").alias("shingles"))
    top = top.select("bucket", F.col("top.root").alias("top"), "size", "shingles")
    asked = parts.join(top, "bucket").filter(F.col("root") != F.col("top")).groupBy("bucket").agg(
        F.first("top").alias("top"),
        _blocks(F.first("size"), F.first("shingles")).alias("all_blocks"),
        _blocks(F.sum("count"), F.sum("n")).alias("asking_blocks"),
    )
    sized = members.join(asked, "bucket")
    i_of, j_of = (F.pmod(F.xxhash64("row"), F.col(c)).cast("int") for c in ("asking_blocks", "all_blocks"))
    all_i, all_j = (F.explode(F.sequence(F.lit(0), F.col(c) - 1)) for c in ("asking_blocks", "all_blocks"))
    queries = sized.filter(F.col("root") != F.col("top")).select("bucket", "row", "root", F.lit(0).alias("side"), i_of.alias("i"), all_j.alias("j"))
    others = sized.select("bucket", "row", "root", F.lit(1).alias("side"), all_i.alias("i"), j_of.alias("j"))
    met = queries.unionByName(others).join(sets.select("row", "text"), "row")
    met = met.repartition(F.col("bucket"), F.col("i"), F.col("j")).sortWithinPartitions("bucket", "i", "j", "side")

    def groups(batches):
        held: list[pa.RecordBatch] = []
        for batch in batches:
            key = [batch.column(c).to_numpy() for c in ("bucket", "i", "j")]
            cuts = np.flatnonzero(np.any([k[1:] != k[:-1] for k in key], axis=0)) + 1
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(batch)]):
                part = batch.slice(a, b - a)
                if held and any(held[-1].column(c)[0] != part.column(c)[0] for c in ("bucket", "i", "j")):
                    yield pa.Table.from_batches(held)
                    held = []
                held.append(part)
        if held:
            yield pa.Table.from_batches(held)

    def run(batches):
        for group in groups(batches):
            flat, offsets = shingles(group.column("text"))
            asks = int((group.column("side").to_numpy() == 0).sum())  # they come first
            roots, names = group.column("root").to_numpy(), group.column("row").to_numpy()
            vocabulary, number = np.unique(flat, return_inverse=True)
            sizes = np.diff(offsets)
            theirs, starts = number[offsets[asks] :], offsets[asks:-1] - offsets[asks]
            mark = np.zeros(len(vocabulary), bool)
            out: set[tuple[int, int]] = set()
            for q in range(asks if len(starts) else 0):
                own = number[offsets[q] : offsets[q + 1]]
                mark[own] = True
                shared = np.add.reduceat(mark[theirs], starts, dtype=np.int64)
                mark[own] = False
                linked = (100 * shared >= percent * (sizes[q] + sizes[asks:] - shared)) & (roots[asks:] != roots[q])
                for other in names[asks:][linked].tolist():
                    out.add((min(int(names[q]), other), max(int(names[q]), other)))
            yield pa.RecordBatch.from_pydict(
                {"a": pa.array([p[0] for p in out], pa.int64()), "b": pa.array([p[1] for p in out], pa.int64())}
            )

    return met.mapInArrow(run, "a long, b long").distinct()


def _blocks(members: F.Column, shingles_: F.Column) -> F.Column:
    """Blocks so that one has about BLOCK_MEMBERS members and BLOCK_SHINGLES shingles at most."""
    return F.greatest(F.ceil(members / BLOCK_MEMBERS), F.ceil(shingles_ / BLOCK_SHINGLES)).cast("int")


def _labelled(members: DataFrame, roots: DataFrame) -> DataFrame:
    """(bucket, row, n, root) of the buckets that hold several components."""
    named = members.join(roots.withColumnRenamed("v", "row"), "row", "left").select(
        "bucket", "row", "n", F.coalesce("root", "row").alias("root")
    )
    mixed = named.groupBy("bucket").agg(F.count("*").alias("size"), F.min("root").alias("low"), F.max("root").alias("high"))
    # The only pair of a bucket of two was confirmed or refused already.
    return named.join(mixed.filter("size > 2 and low <> high").select("bucket"), "bucket")


def near_duplicates(docs: DataFrame, percent: int = 80, keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept, first) of every document; then the columns ``keep``.

    Documents are linked when 100 * shared shingles >= ``percent`` * all shingles of both, and the
    smallest ``doc_id`` that links reach names the component; ``kept`` is true for it.
    ``first`` is true for exactly one row of each component, one of those with the smallest id.
    """
    B.prepare(docs.sparkSession)
    table = B.written(_sets(docs, keep), "sets")
    filled = table.filter("class is not null")
    # Rows without an id come after all others.
    place = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "row")
    named = filled.groupBy("class").agg(F.min("row").alias("row"), F.min(place).alias("least"))
    named = B.written(named, "classes")
    classes = table.select("row", "n", "signature").join(named.select("row"), "row", "left_semi")
    buckets = _buckets(classes)
    shared = buckets.groupBy("bucket").agg(F.count("*").alias("size")).filter("size > 1")
    members = B.written(buckets.join(shared, "bucket"), "buckets")
    fame = members.groupBy("row").agg(F.sum("size").alias("fame"))
    famous = B.written(members.select("bucket", "row", "n").join(fame, "row"), "members")
    centres = famous.groupBy("bucket").agg(F.max("fame").alias("fame"))
    # Of the most popular members the one with the largest number.
    centres = famous.join(centres, ["bucket", "fame"]).groupBy("bucket").agg(F.max("row").alias("a"), F.max_by("n", "row").alias("n_a"))
    stars = famous.join(centres, "bucket").filter(F.col("a") != F.col("row"))
    fits = 100 * F.least("n_a", "n") >= percent * F.greatest("n_a", "n")
    links = _confirmed(stars.filter(fits).select("a", F.col("row").alias("b")).distinct(), table, percent)
    roots = components(links)
    rest = B.written(_residual(B.written(_labelled(famous, roots), "mixed"), table, percent), "rest")
    if not rest.isEmpty():
        roots = components(links.select("a", "b").union(rest))
    groups = named.join(roots.withColumnRenamed("v", "row"), "row", "left").select(
        "class", "least", F.coalesce("root", "row").alias("root")
    )
    least = groups.groupBy("root").agg(F.min("least").alias("component"))
    of_class = groups.join(least, "root").select("class", "component.*")
    of_class = of_class.select("class", F.col("doc_id").alias("component"), F.col("row").alias("first_row"))
    held = {c: "text" if c == "text" else f"keep_{c}" for c in keep}
    rows = table.select("row", "doc_id", "n", "class", *held.values()).join(of_class, "class", "left")
    alone = F.col("class").isNull()
    component = F.when(alone, F.col("doc_id")).otherwise(F.col("component"))
    return rows.select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        component.alias("component_id"),
        F.col("doc_id").eqNullSafe(component).alias("kept"),
        (alone | (F.col("row") == F.col("first_row"))).alias("first"),
        *(F.col(name).alias(c) for c, name in held.items()),
    )
