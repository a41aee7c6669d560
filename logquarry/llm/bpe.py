"""Byte-level BPE: every distinct word is encoded once, ids go back to the places of the word.

``encode`` cuts the texts of a block into pre-tokens and keeps, in place of the texts, the positions
as local word numbers. The distinct words of all blocks are shuffled by hash; the task of a shard
encodes each of them once and answers every block; a block then puts the ids back by position. So
words cross the network once per block, and positions never go to the words. A frequent word is one
entry per block, whatever its count. ``decode`` looks the ids up in the table of token bytes.

Defined results: null and empty texts have no ids; a null ``doc_id`` and repeated rows are kept as
they are; long texts are blocks of their own; other columns are not looked at. Empty table in, empty
table out.
"""

from __future__ import annotations

import base64
import heapq

import numpy as np
import pyarrow as pa
import regex
import zstandard
from pyspark.sql import DataFrame

from logquarry.llm import blocks as B
from logquarry.llm import text as T

BLOCK_TABLE = (
    "chunk long, ids array<long>, counts binary, seq binary, words binary, n_words long"
)
IDS = "doc_id long, ids binary"
# Bytes of text in a block: its words are Python strings for a while.
BLOCK = 3 << 20
# Words that one shard encodes, about; they are Python objects for a while.
SHARD_WORDS = 300_000
# Words longer than this are merged with a heap.
LONG_WORD = 64

_RANKS: dict[str, dict[bytes, int]] = {}
_TOKENS: dict[str, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}


def load_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to rank, from a rank file (base64 and rank per line)."""
    if path not in _RANKS:
        with open(path, "rb") as file:
            _RANKS[path] = {base64.b64decode(a): int(b) for a, b in (line.split() for line in file if line.strip())}
    return _RANKS[path]


def token_table(path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(all bytes, start, length) by id."""
    if path not in _TOKENS:
        ranks = load_ranks(path)
        by_id = {rank: token for token, rank in ranks.items()}
        tokens = [by_id.get(i, b"") for i in range(max(by_id, default=-1) + 1)]
        lengths = np.array([len(t) for t in tokens], np.int64)
        _TOKENS[path] = (np.frombuffer(b"".join(tokens), np.uint8), np.cumsum(lengths) - lengths, lengths)
    return _TOKENS[path]


def encode_word(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one pre-token: always the leftmost pair of the lowest rank is merged."""
    known = ranks.get(word)
    if known is not None:
        return [known]
    if len(word) > LONG_WORD:
        return _encode_long(word, ranks)
    parts = [word[i : i + 1] for i in range(len(word))]
    costs = [ranks.get(a + b) for a, b in zip(parts, parts[1:])]
    while True:
        best = min((c for c in costs if c is not None), default=None)
        if best is None:
            return [ranks[p] for p in parts]
        i = costs.index(best)
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
        del costs[i]
        if i < len(costs):
            costs[i] = ranks.get(parts[i] + parts[i + 1])
        if i:
            costs[i - 1] = ranks.get(parts[i - 1] + parts[i])


def _encode_long(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    n = len(word)
    end = list(range(1, n + 1))  # of the part that starts here; 0 once it is merged away
    before = list(range(-1, n - 1))
    heap: list[tuple[int, int, int]] = []

    def offer(i: int) -> None:
        j = end[i]
        if j < n:
            rank = ranks.get(word[i : end[j]])
            if rank is not None:
                heapq.heappush(heap, (rank, i, end[j]))

    for i in range(n - 1):
        offer(i)
    while heap:
        _, i, stop = heapq.heappop(heap)
        j = end[i]
        if not j or j >= n or end[j] != stop:  # a part of this pair has changed
            continue
        end[i], end[j] = stop, 0
        if stop < n:
            before[stop] = i
        offer(i)
        if before[i] >= 0:
            offer(before[i])
    out, i = [], 0
    while i < n:
        out.append(ranks[word[i : end[i]]])
        i = end[i]
    return out


def _pack_words(words: list[bytes]) -> bytes:
    lengths = T.pack(T.smallest(np.array([len(w) for w in words], np.int64)))
    return len(lengths).to_bytes(4, "little") + lengths + zstandard.compress(b"".join(words), 3)


def _unpack_words(blob: bytes) -> list[bytes]:
    n = int.from_bytes(blob[:4], "little")
    ends = np.cumsum(T.unpack(blob[4 : 4 + n]).astype(np.int64)).tolist()
    data = zstandard.decompress(blob[4 + n :])
    return [data[a:b] for a, b in zip([0, *ends], ends)]


def _homes(words: list[bytes], shards: int) -> np.ndarray:
    """The shard of every word."""
    ends = np.cumsum([len(w) for w in words], dtype=np.int64)
    starts = np.concatenate([[0], ends[:-1]]).astype(np.int64) if words else ends
    return B.shard_of(T.hasher().segments(np.frombuffer(b"".join(words), np.uint8), starts, ends), shards)


def _block_table(docs: DataFrame, pattern: str) -> DataFrame:
    def run(batches):
        split = regex.compile(pattern).findall
        for chunk, block in zip(B.chunk_ids(), T.blocks(batches, "text", BLOCK)):
            local: dict[str, int] = {}
            parts, counts = [], []
            for text in block.column("text").to_pylist():
                words = split(text) if text else []
                counts.append(len(words))
                parts.append(np.array([local.setdefault(w, len(local)) for w in words], np.int64))
            places = np.concatenate(parts) if parts else np.empty(0, np.int64)
            # Frequent words get small numbers, which pack well.
            order = np.argsort(-np.bincount(places, minlength=len(local)), kind="stable")
            number = np.empty(len(local), np.int64)
            number[order] = np.arange(len(local))
            listed = list(local)
            words = [listed[i].encode() for i in order.tolist()]
            yield pa.RecordBatch.from_pylist(
                [
                    {
                        "chunk": chunk,
                        "ids": block.column("doc_id").to_pylist(),
                        "counts": T.pack(T.smallest(np.array(counts, np.int64))),
                        "seq": T.pack(T.smallest(number[places])),
                        "words": _pack_words(words),
                        "n_words": len(words),
                    }
                ],
                pa.schema(
                    [
                        ("chunk", pa.int64()),
                        ("ids", pa.list_(pa.int64())),
                        *((c, pa.binary()) for c in ("counts", "seq", "words")),
                        ("n_words", pa.int64()),
                    ]
                ),
            )

    return docs.select("doc_id", "text").mapInArrow(run, BLOCK_TABLE)


def encode(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """(doc_id, ids): the ids of every text as little-endian unsigned 32-bit integers.

    ``docs`` needs ``doc_id`` and ``text``. Words never merge across matches of ``pattern``; bytes
    that no token covers alone would be an error of the rank file.
    """
    B.prepare(docs.sparkSession)
    table = B.block_table(_block_table(docs, pattern), "bpe")
    shards = B.shard_count(B.total(table, "n_words"), SHARD_WORDS)

    def requests(row):
        words = _unpack_words(row["words"])
        homes = _homes(words, shards)
        order = np.argsort(homes, kind="stable")
        placed = order.tolist()
        for shard, (a, b) in B.runs(homes[order]).items():
            yield shard, _pack_words([words[i] for i in placed[a:b]])

    def serve(bodies, _):
        ranks = load_ranks(ranks_path)
        known: dict[bytes, list[int]] = {}
        out = []
        for body in bodies:
            ids: list[int] = []
            lengths = []
            for word in _unpack_words(body):
                found = known.get(word)
                if found is None:
                    found = known[word] = encode_word(word, ranks)
                ids += found
                lengths.append(len(found))
            packed = T.pack(T.smallest(np.array(lengths, np.int64)))
            out.append(len(packed).to_bytes(4, "little") + packed + T.pack(T.smallest(np.array(ids, np.int64))))
        return out

    def finish(row, answers):
        homes = _homes(_unpack_words(row["words"]), shards)
        order = np.argsort(homes, kind="stable")
        lengths, ids = [], []
        for shard in sorted(answers):
            body = answers[shard]
            n = int.from_bytes(body[:4], "little")
            lengths.append(T.unpack(body[4 : 4 + n]).astype(np.int64))
            ids.append(T.unpack(body[4 + n :]).astype(np.uint32))
        sizes = np.zeros(len(homes), np.int64)
        starts = np.zeros(len(homes), np.int64)
        if ids:
            found = np.concatenate(lengths)
            sizes[order] = found
            starts[order] = np.cumsum(found) - found
            flat = np.concatenate(ids)
        else:
            flat = np.empty(0, np.uint32)
        seq, counts = T.unpack(row["seq"]), T.unpack(row["counts"]).astype(np.int64)
        encoded, at = [], 0
        for count in counts.tolist():
            words = seq[at : at + count]
            at += count
            encoded.append(flat[T.ranges(starts[words], sizes[words])].astype("<u4").tobytes())
        return pa.table({"doc_id": pa.array(row["ids"], pa.int64()), "ids": pa.array(encoded, pa.binary())})

    answers = B.answer(B.ask(table, requests, "words"), serve)
    return B.combine(table.select("chunk", "ids", "counts", "seq", "words"), answers, finish, IDS)


def decode(encoded: DataFrame, ranks_path: str) -> DataFrame:
    """``encoded`` with ``decoded``, the bytes of its ``ids``; null ids give null."""
    B.prepare(encoded.sparkSession)
    step = 1 << 16  # ids looked up at once

    def text_of(blob: bytes) -> bytes:
        data, starts, lengths = token_table(ranks_path)
        ids = np.frombuffer(blob, "<u4")
        pieces = []
        for i in range(0, len(ids), step):
            part = ids[i : i + step]
            pieces.append(data[T.ranges(starts[part], lengths[part])].tobytes())
        return b"".join(pieces)

    def run(batches):
        for batch in batches:
            texts = [None if b is None else text_of(b) for b in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.binary())], [*batch.schema.names, "decoded"])

    return encoded.select("doc_id", "ids").mapInArrow(run, IDS + ", decoded binary")
