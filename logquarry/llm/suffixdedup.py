"""Passages that occur at several places of a corpus, by a sparse suffix array.

A word lies in a repeated passage when it lies in a window of ``least`` words that occurs elsewhere too,
so all such windows are looked for, and longer passages are unions of them. Of every window the run of
ANCHOR words with the least hash is its anchor (runs within a text only); suffixes are kept at anchors.
Two equal windows have equal anchors at different places. Blocks of documents ask shards how many places
an anchor has; a suffix whose anchor has no other place goes no further.

The other suffixes are dealt by anchor and sorted by it and the words that follow, and each is compared with
the NEIGHBOURS next ones: where the anchors agree, the match is extended word by word to the right and to
the left, and counts from ``least`` words on. So of an anchor with up to NEIGHBOURS + 1 places each two
suffixes are compared; equal anchors share a partition, and are too few to make it large.

Suffixes of anchors with more places tie in too many ways for a bounded number of neighbours. Their
windows are counted instead, in shards: a block sends a window once, however often it holds it, so
a passage that a third of all documents hold brings its shard one entry per block.

The result is whole: how many texts share a passage, and what surrounds it there, does not matter.
Suffixes are compared by 32 bits of hash per word, so by 1,600 bits for a passage; counted windows by 96
bits, so two different windows count as equal with a probability of 2**-96 per pair.

Words are cut at white space, with A-Z in lower case. Defined results: null and empty texts have no
words; texts shorter than a passage have no repeats; a passage that repeats within one text counts;
repeated rows are repeats of each other. A null ``doc_id`` is kept. Long texts are blocks of their own;
other columns are not looked at; an empty table gives an empty table.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logquarry.llm import blocks as B
from logquarry.llm import text as T

ANCHOR = 8
# Following suffixes that a suffix is compared with.
NEIGHBOURS = 8
# What an anchor is: without another place, with few places (compared), with many (windows are counted).
ALONE, FEW, MANY = 0, 1, 2
# Suffixes whose surrounding words are gathered at once.
SLICE = 4096
SUFFIXES = "anchor long, key binary, chunk long, at long"
TABLE = "chunk long, ids array<long>, counts binary, seq binary, words binary, runs binary, n_runs long, n_windows long"
REPEATS = "doc_id long, n_words long, n_repeated long, spans array<struct<start:long,end:long>>"
SPAN = pa.struct([("start", pa.int64()), ("end", pa.int64())])


def anchors(runs: np.ndarray, doc: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """(starts, anchors) of the windows of ``window`` runs that lie within a text, ascending."""
    reach = window + ANCHOR - 1
    if len(doc) < reach:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    views = np.lib.stride_tricks.sliding_window_view(runs, window)
    inside = np.flatnonzero(doc[: len(views)] == doc[reach - 1 :][: len(views)])
    picks = np.empty(len(inside), np.int64)
    for i in range(0, len(inside), 1 << 16):
        at = inside[i : i + (1 << 16)]
        picks[i : i + (1 << 16)] = at + views[at].argmin(axis=1)
    return inside, picks


def distinct(hashes: np.ndarray, checks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first index of every distinct pair in ascending order, number of the pair of each element)."""
    order = np.lexsort((checks, hashes))
    h, c = hashes[order], checks[order]
    new = np.ones(len(order), bool)
    new[1:] = (h[1:] != h[:-1]) | (c[1:] != c[:-1])
    number = np.empty(len(order), np.int64)
    number[order] = np.cumsum(new) - 1
    return order[new], number


class Words:
    """Word hashes of a block, from its text or from its row."""

    def __init__(self, row=None, column=None, window: int = 0):
        if row is None:
            data, offsets = T.text_bytes(column)
            data = T.LOWER[data]
            starts, ends, first = T.spans(data, offsets, T.NOT_SPACE)
            self.hashes, self.counts = T.hasher().segments(data, starts, ends), np.diff(first)
        else:
            self.counts = T.unpack(row["counts"]).astype(np.int64)
            names = T.unpack_deltas(row["words"])
            self.hashes = names[T.unpack(row["seq"])] if len(names) else names
        self.first = np.concatenate([[0], np.cumsum(self.counts)]).astype(np.int64)
        self.doc = np.repeat(np.arange(len(self.counts)), self.counts)
        self.all_runs = T.windows(self.hashes, ANCHOR)
        self.starts, self.picks = anchors(self.all_runs, self.doc, window)

    def windows(self, starts: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
        """64 and 32 bits of hash of the ``least`` words from each start on, of the runs that cover them."""
        out = np.zeros((2, len(starts)), np.uint64)
        for offset in (*range(0, least - ANCHOR, ANCHOR), least - ANCHOR):
            runs = self.all_runs[starts + offset]
            for i, seed in enumerate((7, 11)):
                out[i] = T.splitmix((out[i] + np.uint64(seed)) * np.uint64(0x2545F4914F6CDD1D) + runs)
        return out[0], (out[1] >> np.uint64(32)).astype(np.uint32)

    def around(self, at: np.ndarray, right: int, left: int) -> np.ndarray:
        """Per place, 32 bits of each word from it on, then of those before it backwards; 0 beyond the text."""
        ids = np.maximum((self.hashes >> np.uint64(32)).astype(np.uint32), 1)
        steps = np.concatenate([np.arange(right), -1 - np.arange(left)])
        out = np.zeros((len(at), right + left), np.uint32)
        for i in range(0, len(at), SLICE):
            some = at[i : i + SLICE]
            places, doc = some[:, None] + steps, self.doc[some]
            inside = (places >= self.first[doc][:, None]) & (places < self.first[doc + 1][:, None])
            out[i : i + SLICE] = np.where(inside, ids[np.clip(places, 0, len(ids) - 1)], 0)
        return out


def matches(anchors: np.ndarray, around: np.ndarray, right: int, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, words before, words from there on) of both sides of each match of at least ``least`` words.

    Rows are in the order of the suffixes; a row is compared with the NEIGHBOURS after it.
    """
    found = [(np.empty(0, np.int64),) * 3]
    for step in range(1, min(NEIGHBOURS, len(anchors) - 1) + 1):
        row = np.flatnonzero(anchors[:-step] == anchors[step:])
        same = (around[row] == around[row + step]) & (around[row] != 0)
        # The first word that differs ends the extension to either side.
        ahead = np.logical_and.accumulate(same[:, :right], axis=1).sum(axis=1)
        back = np.logical_and.accumulate(same[:, right:], axis=1).sum(axis=1)
        hit = ahead + back >= least
        for place in (row[hit], row[hit] + step):
            found.append((place, back[hit], ahead[hit]))
    row, back, ahead = (np.concatenate(x) for x in zip(*found))
    return row, back, ahead


def _block_table(docs: DataFrame, window: int) -> DataFrame:
    def run(batches):
        for chunk, block in zip(B.chunk_ids(), T.blocks(batches, "text")):
            words = Words(column=block.column("text"), window=window)
            names, local = np.unique(words.hashes, return_inverse=True)
            runs, n = np.unique(words.all_runs[np.unique(words.picks)], return_counts=True)
            yield pa.RecordBatch.from_pylist(
                [
                    {
                        "chunk": chunk,
                        "ids": block.column("doc_id").to_pylist(),
                        "counts": T.pack(T.smallest(words.counts)),
                        "seq": T.pack(T.smallest(local)),
                        "words": T.pack_deltas(names),
                        # How many places each anchor has here, as far as that matters, and the anchors.
                        "runs": np.minimum(n, NEIGHBOURS + 2).astype(np.uint8).tobytes() + runs.tobytes(),
                        "n_runs": len(runs),
                        "n_windows": len(words.starts),
                    }
                ],
                pa.schema(
                    [
                        ("chunk", pa.int64()),
                        ("ids", pa.list_(pa.int64())),
                        *((c, pa.binary()) for c in ("counts", "seq", "words", "runs")),
                        ("n_runs", pa.int64()),
                        ("n_windows", pa.int64()),
                    ]
                ),
            )

    return docs.select("doc_id", "text").mapInArrow(run, TABLE)


def _runs(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = len(blob) // 9
    return np.frombuffer(blob, np.uint64, n, n), np.frombuffer(blob, np.uint8, n)


def repeated_passages(docs: DataFrame, least: int = 50) -> DataFrame:
    """(doc_id, n_words, n_repeated, spans): words of every text in passages that occur elsewhere too.

    A passage has at least ``least`` words (more than twice ANCHOR); spans are word ranges.
    """
    B.prepare(docs.sparkSession)
    window, right, left = least - ANCHOR + 1, least, least - ANCHOR
    table = B.block_table(_block_table(docs, window), "suffixes")
    shards = B.shard_count(B.total(table, "n_runs"))
    # Of all windows; those around anchors of many places are fewer.
    window_shards = B.shard_count(B.total(table, "n_windows"))

    def requests(row):
        runs, places = _runs(row["runs"])
        for shard, (a, b) in B.runs(B.shard_of(runs, shards)).items():
            yield shard, places[a:b].tobytes() + runs[a:b].tobytes()

    def serve(bodies, _):
        asked = [_runs(b) for b in bodies]
        runs, places = (np.concatenate(x) for x in zip(*asked))
        names, at = np.unique(runs, return_inverse=True)
        n = np.bincount(at, weights=places)
        kind = np.where(n > NEIGHBOURS + 1, MANY, np.where(n > 1, FEW, ALONE)).astype(np.uint8)
        return [kind[np.searchsorted(names, r)].tobytes() for r, _ in asked]

    def kinds(words, row, answers):
        """What the anchor of each window of the block is."""
        runs, _ = _runs(row["runs"])
        kind = np.full(len(runs), ALONE, np.uint8)
        places_of = B.runs(B.shard_of(runs, shards))
        for shard, body in answers.items():
            a, b = places_of[shard]
            kind[a:b] = np.frombuffer(body, np.uint8)
        if not len(runs):
            return np.empty(0, np.uint8)
        return kind[np.searchsorted(runs, words.all_runs[words.picks])]

    def suffixes(row, answers):
        words = Words(row=row, window=window)
        at = np.unique(words.picks[kinds(words, row, answers) == FEW])
        keys = words.around(at, right, left)
        width = 4 * keys.shape[1]
        offsets = pa.py_buffer(np.arange(len(at) + 1, dtype=np.int32) * np.int32(width))
        return pa.table(
            {
                "anchor": pa.array(words.all_runs[at].view(np.int64), pa.int64()),
                "key": pa.Array.from_buffers(pa.binary(), len(at), [None, offsets, pa.py_buffer(keys.tobytes())]),
                "chunk": pa.array(np.full(len(at), row["chunk"]), pa.int64()),
                "at": pa.array(at, pa.int64()),
            }
        )

    def neighbours(batches):
        """Spans of matches, the numbers of a block in one row; no shard, as they answer no request."""
        last = None
        for batch in batches:
            if not len(batch):
                continue
            around = np.frombuffer(b"".join(batch.column("key").to_pylist()), np.uint32).reshape(len(batch), -1)
            own = [batch.column("anchor").to_numpy(), around, batch.column("chunk").to_numpy(), batch.column("at").to_numpy()]
            if last is not None:
                own = [np.concatenate(x) for x in zip(last, own)]
            row, back, ahead = matches(own[0], own[1], right, least)
            chunks, at = own[2][row], own[3][row]
            found = np.unique(np.stack([chunks, at - back, at + ahead]), axis=1)
            names, cuts = np.unique(found[0], return_index=True)
            bodies = [np.ascontiguousarray(x).tobytes() for x in np.split(found[1:], cuts[1:], axis=1)] if len(names) else []
            yield pa.RecordBatch.from_pydict(
                {
                    "shard": pa.nulls(len(names), pa.int32()),
                    "chunk": pa.array(names, pa.int64()),
                    "body": pa.array(bodies, pa.binary()),
                }
            )
            last = [x[-NEIGHBOURS:] for x in own]

    def candidates(row, answers):
        """Of a block its words, the starts of the windows with an anchor of many places, and their hashes."""
        words = Words(row=row, window=window)
        starts = words.starts[kinds(words, row, answers) == MANY]
        return words, starts, *words.windows(starts, least)

    def window_requests(row, answers):
        _, _, hashes, checks = candidates(row, answers)
        first, number = distinct(hashes, checks)
        several = np.bincount(number, minlength=len(first)) > 1
        hashes, checks = hashes[first], checks[first]
        shard, body = [], []
        for home, (a, b) in B.runs(B.shard_of(hashes, window_shards)).items():
            shard.append(home)
            body.append((b - a).to_bytes(4, "little") + np.packbits(several[a:b]).tobytes() + hashes[a:b].tobytes() + checks[a:b].tobytes())
        return pa.table(
            {
                "shard": pa.array(shard, pa.int32()),
                "chunk": pa.array([row["chunk"]] * len(shard), pa.int64()),
                "body": pa.array(body, pa.binary()),
            }
        )

    def serve_windows(bodies, _):
        asked = []
        for body in bodies:
            n = int.from_bytes(body[:4], "little")
            stop = 4 + (n + 7) // 8
            several = np.unpackbits(np.frombuffer(body[4:stop], np.uint8), count=n)
            asked.append((np.frombuffer(body, np.uint64, n, stop), np.frombuffer(body, np.uint32, n, stop + 8 * n), several))
        hashes, checks, several = (np.concatenate(x) for x in zip(*asked))
        _, number = distinct(hashes, checks)
        repeated = (np.bincount(number, weights=1 + several) > 1)[number]
        cuts = np.cumsum([len(h) for h, _, _ in asked])[:-1]
        return [np.packbits(x).tobytes() for x in np.split(repeated, cuts)]

    answers = B.written(B.answer(B.ask(table, requests, "runs"), serve), "anchors")
    blocks = table.drop("ids", "n_runs", "n_windows")
    found = B.answer(B.combine(blocks, answers, window_requests, B.REQUESTS), serve_windows)
    # Anchors are hashes of at most NEIGHBOURS + 1 places, so dealing by them is even, and needs no sample.
    array = B.combine(blocks, answers, suffixes, SUFFIXES).repartition("anchor").sortWithinPartitions("anchor", "key", "chunk", "at")
    # Answers on windows get negative numbers, to be told from those on anchors.
    replies = answers.union(found.select((-1 - F.col("shard")).alias("shard"), "chunk", "body")).union(
        array.mapInArrow(neighbours, B.REQUESTS)
    )

    def finish(key, left_, right_):
        T.give_back()
        row = left_.to_pylist()[0]
        replies = list(zip(right_.column("shard").to_pylist(), right_.column("body").to_pylist()))
        answers = {shard: body for shard, body in replies if shard is not None}
        words, starts, hashes, checks = candidates(row, {s: b for s, b in answers.items() if s >= 0})
        first, number = distinct(hashes, checks)
        flags = np.zeros(len(first), bool)
        places_of = B.runs(B.shard_of(hashes[first], window_shards))
        for shard, body in answers.items():
            if shard < 0:
                a, b = places_of[-1 - shard]
                flags[a:b] = np.unpackbits(np.frombuffer(body, np.uint8), count=b - a)
        starts = starts[flags[number]]
        counts, first = words.counts, words.first
        cover = np.zeros(first[-1] + 1, np.int64)
        cover[starts] += 1
        cover[starts + least] -= 1
        for begins, ends in (np.frombuffer(b, np.int64).reshape(2, -1) for shard, b in replies if shard is None):
            np.add.at(cover, begins, 1)
            np.add.at(cover, ends, -1)
        covered = np.cumsum(cover[:-1]) > 0
        doc = np.repeat(np.arange(len(counts)), counts)
        edge_ = np.ones(len(covered), bool)
        edge_[1:] = doc[1:] != doc[:-1]
        opens = np.flatnonzero(covered & (~np.roll(covered, 1) | edge_))
        closes = np.flatnonzero(covered & (~np.roll(covered, -1) | np.roll(edge_, -1)))
        spans: list[list[dict]] = [[] for _ in counts]
        for a, b in zip(opens.tolist(), closes.tolist()):
            spans[doc[a]].append({"start": int(a - first[doc[a]]), "end": int(b + 1 - first[doc[a]])})
        return pa.table(
            {
                "doc_id": pa.array(row["ids"], pa.int64()),
                "n_words": pa.array(counts, pa.int64()),
                "n_repeated": pa.array(np.bincount(doc[covered], minlength=len(counts)), pa.int64()),
                "spans": pa.array(spans, pa.list_(SPAN)),
            }
        )

    rows = table.drop("n_runs", "n_windows").groupBy("chunk")
    return rows.cogroup(replies.groupBy("chunk")).applyInArrow(finish, REPEATS)
