"""Benchmark decontamination: windows of benchmark words are looked for in all document windows.

Texts are lower-cased (A-Z) and cut into words of letters, digits and non-ASCII characters. Every run
of ``n`` consecutive words of an item is a window; an item of fewer words is one window. The hashes
of all windows are a broadcast set when they are within MAX_BROADCAST bytes. Beyond that blocks of
documents send their distinct window hashes to shards of the windows, and get back the windows that
may occur in them. Either way each hash hit is verified on the words themselves.

Defined results: null and empty texts have no words and are never contaminated; items without words
are never found; repeated items count once per item id; every row is looked at by itself, whatever
its id. Items without an id are left out, or with ``unnamed`` their words are hit like those of others and
only a name for the list of items is missing. Long texts are blocks of their own. Other columns pass through ``clean`` unchanged. With no
items nothing is contaminated.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logquarry.llm import blocks as B
from logquarry.llm import text as T

# Window texts and hashes that may be broadcast, in bytes.
MAX_BROADCAST = 64 << 20
WINDOWS = "hash long, n int, words binary, item string"
REPORT = "doc_id long, n_words long, n_hit long, items array<string>, spans array<struct<start:long,end:long>>"
SPAN = pa.struct([("start", pa.int64()), ("end", pa.int64())])
FILTER_BITS = 20
# Bytes of text looked at once.
BLOCK = 2 << 20


class Words:
    """The words of all texts of a block."""

    def __init__(self, column):
        data, self.offsets = T.text_bytes(column)
        self.data = T.LOWER[data]
        self.starts, self.ends, self.first = T.spans(self.data, self.offsets, T.ALNUM)
        self.hashes = T.hasher().segments(self.data, self.starts, self.ends)
        self.doc = np.repeat(np.arange(len(self.offsets) - 1), np.diff(self.first))

    def windows(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """(first word, hash) of the windows of ``n`` words that lie within one text."""
        hashes = T.windows(self.hashes, n)
        at = np.flatnonzero(self.doc[: len(hashes)] == self.doc[n - 1 :][: len(hashes)])
        return at, hashes[at]

    def verified(self, at: np.ndarray, words: list[bytes]) -> np.ndarray:
        """Those of the word positions ``at`` where ``words`` follow each other."""
        for i, word in enumerate(words):
            starts, ends = self.starts[at + i], self.ends[at + i]
            at, starts = at[ends - starts == len(word)], starts[ends - starts == len(word)]
            if not len(at):
                break
            same = self.data[starts[:, None] + np.arange(len(word))] == np.frombuffer(word, np.uint8)
            at = at[same.all(axis=1)]
        return at


class Index:
    """Windows of items by length and hash."""

    def __init__(self, rows: pa.Table):
        found: dict[int, dict[int, dict[bytes, set[str]]]] = {}
        for hash_, n, words, item in zip(*(rows.column(c).to_pylist() for c in ("hash", "n", "words", "item"))):
            found.setdefault(n, {}).setdefault(hash_ & T.MASK, {}).setdefault(words, set()).update([] if item is None else [item])
        self.found = found
        self.hashes = {n: np.array(sorted(h), np.uint64) for n, h in found.items()}
        self.filters = {}
        for n, hashes in self.hashes.items():
            self.filters[n] = np.zeros(1 << FILTER_BITS, bool)
            self.filters[n][hashes >> np.uint64(64 - FILTER_BITS)] = True

    def hits(self, words: Words):
        """Yields (word positions, number of words, items) for every window that occurs."""
        for n, hashes in self.hashes.items():
            at, found = words.windows(n)
            may = self.filters[n][found >> np.uint64(64 - FILTER_BITS)]
            at, found = at[may], found[may]
            place = np.minimum(np.searchsorted(hashes, found), len(hashes) - 1)
            same = hashes[place] == found
            at, place = at[same], place[same]
            order = np.argsort(place, kind="stable")
            at, place = at[order], place[order]
            cuts = np.flatnonzero(np.diff(place, prepend=-1))
            for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(place)]):
                for spelled, items in self.found[n][int(hashes[place[a]])].items():
                    real = words.verified(at[a:b], spelled.split(b" "))
                    if len(real):
                        yield real, n, items


def window_table(items: DataFrame, n: int, unnamed: bool = False) -> DataFrame:
    """The distinct windows of all items, with the id of the item as text."""

    def run(batches):
        for batch in batches:
            words = Words(batch.column("text"))
            ids = batch.column("item").to_pylist()
            counts = np.diff(words.first)
            rows: dict[str, list] = {"hash": [], "n": [], "words": [], "item": []}
            for size in sorted({min(n, int(c)) for c in counts if c}):
                at, hashes = words.windows(size)
                fits = np.minimum(counts[words.doc[at]], n) == size
                for i, h in zip(at[fits].tolist(), hashes[fits].view(np.int64).tolist()):
                    spelled = [words.data[a:b].tobytes() for a, b in zip(words.starts[i : i + size], words.ends[i : i + size])]
                    for column, value in zip(rows.values(), (h, size, b" ".join(spelled), ids[words.doc[i]])):
                        column.append(value)
            yield pa.RecordBatch.from_pydict(
                rows, pa.schema([("hash", pa.int64()), ("n", pa.int32()), ("words", pa.binary()), ("item", pa.string())])
            )

    items = items.select(F.col("item_id").cast("string").alias("item"), "text")
    if not unnamed:
        items = items.filter("item is not null")
    return items.mapInArrow(run, WINDOWS).distinct()


def _report(block: pa.Table, index: Index) -> tuple[np.ndarray, list[list[str]], list[list[tuple[int, int]]], np.ndarray]:
    """(words, items, hit byte spans, hit words) of every text of the block."""
    words = Words(block.column("text"))
    texts = len(words.offsets) - 1
    cover = np.zeros(len(words.starts) + 1, np.int64)
    items: list[set[str]] = [set() for _ in range(texts)]
    for at, n, found in index.hits(words):
        np.add.at(cover, at, 1)
        np.add.at(cover, at + n, -1)
        for doc in np.unique(words.doc[at]).tolist():
            items[doc] |= found
    hit = np.cumsum(cover[:-1]) > 0
    # A window ends within its text, so runs of hit words are cut at the ends of texts.
    edge = np.ones(len(hit), bool)
    edge[1:] = words.doc[1:] != words.doc[:-1]
    before, after = np.roll(hit, 1), np.roll(hit, -1)
    opens = np.flatnonzero(hit & (~before | edge))
    closes = np.flatnonzero(hit & (~after | np.roll(edge, -1)))
    spans: list[list[tuple[int, int]]] = [[] for _ in range(texts)]
    for a, b in zip(opens.tolist(), closes.tolist()):
        doc = words.doc[a]
        spans[doc].append((int(words.starts[a] - words.offsets[doc]), int(words.ends[b] - words.offsets[doc])))
    n_hit = np.bincount(words.doc[hit], minlength=texts)
    return np.diff(words.first), [sorted(i) for i in items], spans, n_hit


def _as_report(block: pa.Table, index: Index) -> pa.Table:
    n_words, items, spans, n_hit = _report(block, index)
    return pa.table(
        {
            "doc_id": block.column("doc_id").cast(pa.int64()),
            "n_words": pa.array(n_words, pa.int64()),
            "n_hit": pa.array(n_hit, pa.int64()),
            "items": pa.array(items, pa.list_(pa.string())),
            "spans": pa.array([[{"start": a, "end": b} for a, b in s] for s in spans], pa.list_(SPAN)),
        }
    )


def _without_documents(block: pa.Table, index: Index) -> pa.Table:
    return block.filter(pa.array(_report(block, index)[3] == 0))


def _without_spans(block: pa.Table, index: Index) -> pa.Table:
    spans = _report(block, index)[2]
    texts = block.column("text").to_pylist()
    for i, cut in enumerate(spans):
        if cut:
            raw = texts[i].encode()
            ends = [0, *(b for _, b in cut)]
            texts[i] = b"".join(raw[a:b] for a, b in zip(ends, [*(a for a, _ in cut), len(raw)])).decode()
    place = block.schema.get_field_index("text")
    return block.set_column(place, "text", pa.array(texts, block.schema.field("text").type))


def _through(docs: DataFrame, items: DataFrame, n: int, act, schema, max_broadcast: int, unnamed: bool) -> DataFrame:
    spark = B.prepare(docs.sparkSession)
    windows = B.written(window_table(items, n, unnamed), "windows")
    size = windows.agg(F.coalesce(F.sum(F.octet_length("words") + F.coalesce(F.octet_length("item"), F.lit(0)) + 32), F.lit(0))).first()[0]
    if size <= max_broadcast:
        held = spark.sparkContext.broadcast(windows.toArrow())

        def run(batches):
            index = Index(held.value)
            for block in T.blocks(batches, "text", BLOCK):
                yield from act(block, index).to_batches()

        return docs.mapInArrow(run, schema)
    return _sharded(docs, windows, act, schema)


def _sharded(docs: DataFrame, windows: DataFrame, act, schema) -> DataFrame:
    """The same where the windows are too many to broadcast."""
    lengths = [row.n for row in windows.select("n").distinct().collect()]  # n at most
    table = B.block_table(docs.mapInArrow(lambda batches: B.packed(T.blocks(batches, "text")), B.PACKED), "texts")
    shards = B.shard_count(windows.count())

    def requests(row):
        words = Words(B.unpacked(row["block"]).column("text"))
        found = [np.unique(words.windows(n)[1]) for n in lengths]
        found = np.unique(np.concatenate(found)) if found else np.empty(0, np.uint64)
        for shard, (a, b) in B.runs(B.shard_of(found, shards)).items():
            yield shard, found[a:b].tobytes()

    def pack_windows(batches):
        for batch in batches:
            hashes = batch.column("hash").to_numpy().view(np.uint64)
            home = B.shard_of(hashes, shards)
            for shard in np.unique(home).tolist():
                part = pa.Table.from_batches([batch]).filter(pa.array(home == shard))
                yield pa.RecordBatch.from_pydict(
                    {
                        "shard": pa.array([shard], pa.int32()),
                        "chunk": pa.array([-1], pa.int64()),
                        "body": pa.array([B.to_ipc(part)], pa.binary()),
                    }
                )

    def serve(bodies, chunks):
        mine = [B.unpacked(b) for b, c in zip(bodies, chunks) if c < 0]
        known = pa.concat_tables(mine) if mine else None
        out = []
        for body, chunk in zip(bodies, chunks):
            if chunk < 0 or known is None:
                out.append(None)
                continue
            asked = pa.array(np.frombuffer(body, np.int64))
            part = known.filter(pc.is_in(known.column("hash"), asked))
            out.append(B.to_ipc(part) if part.num_rows else None)
        return out

    empty = pa.schema([("hash", pa.int64()), ("n", pa.int32()), ("words", pa.binary()), ("item", pa.string())]).empty_table()

    def finish(row, answers):
        return act(B.unpacked(row["block"]), Index(pa.concat_tables([empty, *(B.unpacked(answers[s]) for s in sorted(answers))])))

    asked = B.ask(table, requests, "block").union(windows.mapInArrow(pack_windows, B.REQUESTS))
    return B.combine(table, B.answer(asked, serve), finish, schema)


def report(docs: DataFrame, items: DataFrame, n: int = 10, max_broadcast: int = MAX_BROADCAST, unnamed: bool = False) -> DataFrame:
    """(doc_id, n_words, n_hit, items, spans): hit words, the items that occur, and hit byte spans.

    ``docs`` needs ``doc_id`` and ``text``, ``items`` needs ``item_id`` and ``text``.
    """
    return _through(docs.select("doc_id", "text"), items, n, _as_report, REPORT, max_broadcast, unnamed)


def clean(docs: DataFrame, items: DataFrame, n: int = 10, remove: str = "documents", max_broadcast: int = MAX_BROADCAST, unnamed: bool = False) -> DataFrame:
    """``docs`` without contaminated documents, or (``remove="spans"``) without their hit spans."""
    act = {"documents": _without_documents, "spans": _without_spans}[remove]
    return _through(docs, items, n, act, docs.schema, max_broadcast, unnamed)
