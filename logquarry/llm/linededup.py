"""Removal of lines that many documents share, by sharded minimal perfect hashes.

The key of a line is the line without white space at both ends and with A-Z in lower case. Blocks of
documents send every distinct key once to its shard (a range of the key hash), with the number of
documents of the block that hold it and the largest of their ids. A shard builds a minimal perfect
hash over its distinct keys; it indexes an array of fingerprints, one of document counts and one of
largest ids. The keys of a block probe these arrays, and the answers go back to the block. A line
that a third of all documents hold is one entry per block.

Keys are 128-bit hashes: 64 bits place the key, the fingerprint holds the other 64.

Defined results: null and empty texts are one empty line, which stays. Every row counts as a
document of its own. A null ``doc_id`` counts as the smallest id. Of rows that repeat the largest
id, all keep the line. Texts of any length are handled; other columns are not looked at; an empty
table gives an empty table.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from logquarry.llm import blocks as B
from logquarry.llm import text as T
from logquarry.llm.mph import MinimalHash

TABLE = "chunk long, ids array<long>, rest binary, sizes binary, text binary, seq binary, keys binary, n_keys long"
RESULT = "doc_id long, text string, n_lines long, n_dropped long"
NO_ID = -(1 << 63)
# Bytes of text in a block; the arrays over its bytes take many times that.
BLOCK = 4 << 20


def line_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, lines before each text); every text has one line more than line feeds."""
    feeds = np.flatnonzero(data == 10)
    texts = len(offsets) - 1
    of = np.searchsorted(offsets, feeds, "right") - 1
    first = np.zeros(texts + 1, np.int64)
    first[1:] = np.cumsum(np.bincount(of, minlength=texts)[:texts] + 1)
    starts, ends = np.empty(first[-1], np.int64), np.empty(first[-1], np.int64)
    starts[first[:-1]] = offsets[:-1]
    ends[first[1:] - 1] = offsets[1:]
    at = np.arange(len(feeds)) + of
    ends[at], starts[at + 1] = feeds, feeds + 1
    return starts, ends, first


def line_keys(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(lines with a key of at least ``least`` code points, their two hashes)."""
    solid = np.flatnonzero(T.NOT_SPACE[data])
    a, b = np.searchsorted(solid, starts), np.searchsorted(solid, ends)
    lines = np.flatnonzero(a < b)
    first, last = solid[a[lines]], solid[b[lines] - 1] + 1
    del solid
    points = np.zeros(len(data) + 1, np.int32)
    np.cumsum((data & 0xC0) != 0x80, out=points[1:])
    keep = points[last] - points[first] >= least
    lines, first, last = lines[keep], first[keep], last[keep]
    low = T.LOWER[data]
    return lines, T.hasher(11).segments(low, first, last), T.hasher(12).segments(low, first, last)


def _block_table(docs: DataFrame, least: int, keep: tuple[str, ...]) -> DataFrame:
    def run(batches):
        for chunk, block in zip(B.chunk_ids(), T.blocks(batches, "text", BLOCK)):
            data, offsets = T.text_bytes(block.column("text"))
            starts, ends, first = line_spans(data, offsets)
            lines, h1, h2 = line_keys(data, starts, ends, least)
            ids = block.column("doc_id").to_pylist()
            order = np.lexsort((h2, h1))
            new = np.ones(len(order), bool)
            new[1:] = (h1[order][1:] != h1[order][:-1]) | (h2[order][1:] != h2[order][:-1])
            number = np.empty(len(order), np.int64)
            number[order] = np.cumsum(new) - 1
            k1, k2 = h1[order][new], h2[order][new]
            seq = np.zeros(len(starts), np.int64)
            seq[lines] = number + 1
            doc = np.searchsorted(first, lines, "right") - 1
            pairs = np.unique(number * len(ids) + doc) if len(lines) else np.empty(0, np.int64)
            key, doc = (pairs // len(ids), pairs % len(ids)) if len(pairs) else (pairs, pairs)
            holders = np.bincount(key, minlength=len(k1))
            named = np.array([NO_ID if i is None else i for i in ids], np.int64)
            last = np.full(len(k1), NO_ID, np.int64)
            np.maximum.at(last, key, named[doc])
            keys = np.stack([k1, k2, holders.astype(np.uint64), last.view(np.uint64)]) if len(k1) else np.empty((4, 0), np.uint64)
            yield pa.RecordBatch.from_pylist(
                [
                    {
                        "chunk": chunk,
                        "ids": ids,
                        "rest": B.to_ipc(block.select(list(keep))) if keep else b"",
                        "sizes": T.pack(T.smallest(np.diff(offsets))),
                        "text": zstandard.compress(data.tobytes(), 3),
                        "seq": T.pack(T.smallest(seq)),
                        "keys": T.pack(keys.ravel()),
                        "n_keys": len(k1),
                    }
                ],
                pa.schema(
                    [
                        ("chunk", pa.int64()),
                        ("ids", pa.list_(pa.int64())),
                        *((c, pa.binary()) for c in ("rest", "sizes", "text", "seq", "keys")),
                        ("n_keys", pa.int64()),
                    ]
                ),
            )

    return docs.select("doc_id", "text", *keep).mapInArrow(run, TABLE)


def drop_common_lines(
    docs: DataFrame, documents: int = 3, code_points: int = 20, keep: tuple[str, ...] = ()
) -> DataFrame:
    """(doc_id, text, n_lines, n_dropped): every text without its common lines; then columns ``keep``.

    A key of at least ``code_points`` code points that at least ``documents`` documents hold loses
    all its lines but those in the document with the largest id. The others stay, joined by \\n.
    """
    B.prepare(docs.sparkSession)
    table = B.block_table(_block_table(docs, code_points, keep), "lines")
    shards = B.shard_count(B.total(table, "n_keys"))

    def requests(row):
        keys = T.unpack(row["keys"]).reshape(4, -1)
        for shard, (a, b) in B.runs(B.shard_of(keys[0], shards)).items():
            yield shard, keys[:, a:b].tobytes()

    def serve(bodies, _):
        asked = [np.frombuffer(b, np.uint64).reshape(4, -1) for b in bodies]
        h1, h2, holders, last = np.concatenate(asked, axis=1)
        order = np.lexsort((h2, h1))
        new = np.ones(len(order), bool)
        new[1:] = (h1[order][1:] != h1[order][:-1]) | (h2[order][1:] != h2[order][:-1])
        cuts = np.flatnonzero(new)
        d1, d2 = h1[order][cuts], h2[order][cuts]
        place = MinimalHash(d1, d2)
        at = place(d1, d2)
        fingerprints, counts, largest = np.empty(len(d1), np.uint64), np.empty(len(d1), np.int64), np.empty(len(d1), np.int64)
        fingerprints[at] = d2
        counts[at] = np.add.reduceat(holders[order].astype(np.int64), cuts)
        largest[at] = np.maximum.reduceat(last[order].view(np.int64), cuts)
        out = []
        for keys in asked:
            at = place(keys[0], keys[1])
            common = (fingerprints[at] == keys[1]) & (counts[at] >= documents)
            flags = np.packbits(common).tobytes()
            out.append(len(common).to_bytes(4, "little") + flags + largest[at][common].tobytes())
        return out

    def finish(row, answers):
        common, largest = [], []
        for shard in sorted(answers):
            body = answers[shard]
            n = int.from_bytes(body[:4], "little")
            stop = 4 + (n + 7) // 8
            flags = np.unpackbits(np.frombuffer(body[4:stop], np.uint8), count=n).astype(bool)
            ids = np.full(n, NO_ID, np.int64)
            ids[flags] = np.frombuffer(body[stop:], np.int64)
            common.append(flags)
            largest.append(ids)
        common = np.concatenate([np.zeros(1, bool), *common])
        largest = np.concatenate([np.full(1, NO_ID), *largest])
        offsets = np.concatenate([[0], np.cumsum(T.unpack(row["sizes"]).astype(np.int64))]).astype(np.int64)
        text = zstandard.decompress(row["text"])
        data = np.frombuffer(text, np.uint8)
        starts, ends, first = line_spans(data, offsets)
        seq = T.unpack(row["seq"]).astype(np.int64)
        ids = row["ids"]
        named = np.repeat(np.array([NO_ID if i is None else i for i in ids], np.int64), np.diff(first))
        drop = common[seq] & (largest[seq] != named)
        dropped = np.add.reduceat(drop, first[:-1]) if len(ids) else np.empty(0, np.int64)
        texts = []
        for i, n in enumerate(dropped.tolist()):
            if not n:
                texts.append(text[offsets[i] : offsets[i + 1]])
                continue
            kept = np.flatnonzero(~drop[first[i] : first[i + 1]]) + first[i]
            texts.append(b"\n".join([text[a:b] for a, b in zip(starts[kept].tolist(), ends[kept].tolist())]))
        out = pa.table(
            {
                "doc_id": pa.array(ids, pa.int64()),
                "text": pa.array(texts, pa.binary()).cast(pa.string()),
                "n_lines": pa.array(np.diff(first), pa.int64()),
                "n_dropped": pa.array(dropped, pa.int64()),
            }
        )
        for name, column in zip(keep, B.unpacked(row["rest"]).columns if keep else ()):
            out = out.append_column(name, column)
        return out

    answers = B.answer(B.ask(table, requests, "keys"), serve)
    schema = T.schema(RESULT, docs.select(*keep))
    return B.combine(table.select("chunk", "ids", "rest", "sizes", "text", "seq"), answers, finish, schema)
