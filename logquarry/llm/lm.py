"""Language-model scores from sharded Elias-Fano tries of smoothed bigram probabilities.

A token is a word (A-Z in lower case, cut at white space) or the end that closes every text; the token
before the first one is a start mark. The model interpolates discounted bigrams with add-one unigrams:

    p(w) = (c(w) + 1) / (N + V + 1)
    p(w | v) = max(c(v w) - D, 0) / c(v) + D * n(v) / c(v) * p(w)      n(v): distinct successors of v

and p(w | v) = p(w) where v was never seen. Blocks of documents send each shard their distinct tokens
and bigrams with the counts in training documents. A token lives in the shard of its hash, a bigram in
that of its first token; the bigrams of tokens with over a thousandth of all training tokens, at most
a thousand, go by the second one, so that no shard holds a hot context alone. A shard adds the counts
up and builds a trie in one flat buffer of Elias-Fano levels: contexts, pointers to the ranges of
their successors, and successors as numbers relative to their context, with quantised log
probabilities and backoff weights beside them. The bigrams of all blocks are looked up by successor
search within the range of their context, and the answers go back to the blocks, which sum them by
document. What crosses the network is a block's distinct n-grams, so it grows with the corpus.

Tokens are 64-bit hashes; within a context a successor is known by 40 bits of it. Probabilities are
stored to 1/4096 of a decade.

Defined results: null and empty texts are the end token alone. A null ``train`` counts as false. The
score of every row is its own; repeated rows count as often as they occur. Without training documents
all probabilities are those of one unknown token. Long texts are blocks of their own; other columns
are not looked at; an empty table gives an empty table.
"""

from __future__ import annotations

import mmap

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logquarry.llm import blocks as B
from logquarry.llm import text as T
from logquarry.llm.eliasfano import EliasFano

TABLE = (
    "chunk long, ids array<long>, train binary, counts binary, seq binary, order binary, words binary, seen binary, "
    "n_words long, n_pairs long, n_tokens long, n_docs long, frequent array<struct<word:long,n:long>>"
)
SCORES = (
    "doc_id long, train boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
)
DISCOUNT = 0.75
# A context with more than this share of the training tokens is dealt by its successors.
HOT = 1 / 1000
END, START = T.splitmix(np.array([0xE0D, 0x57A], np.uint64))
STEPS = 4096
MISSING = 0xFFFF


def quantised(p: np.ndarray) -> np.ndarray:
    return np.minimum(np.rint(-np.log10(p) * STEPS), MISSING - 1).astype(np.uint16)


def restored(codes: np.ndarray) -> np.ndarray:
    return np.where(codes == MISSING, 0.0, 10.0 ** (-codes.astype(np.float64) / STEPS))


class Trie:
    """Contexts and their successors in one buffer."""

    def __init__(self, buffer):
        self.contexts, at = EliasFano.at(buffer, 0)
        self.pointers, at = EliasFano.at(buffer, at)
        self.vocabulary, at = EliasFano.at(buffer, at)
        self.successors, at = EliasFano.at(buffer, at)
        self.probabilities = np.frombuffer(buffer, np.uint16, self.successors.n, at)
        self.backoffs = np.frombuffer(buffer, np.uint16, self.contexts.n, at + 2 * self.successors.n)

    @staticmethod
    def levels(contexts: np.ndarray, pointers: np.ndarray, successors: np.ndarray, p: np.ndarray, backoff: np.ndarray) -> bytes:
        """The buffer for ascending contexts; successors[pointers[i]:pointers[i + 1]] ascend too."""
        vocabulary, number = np.unique(successors, return_inverse=True)
        of = np.repeat(np.arange(len(contexts)), np.diff(pointers))
        relative = number.astype(np.uint64) + of.astype(np.uint64) * np.uint64(len(vocabulary))
        parts = [EliasFano.of(x).tobytes() for x in (contexts, pointers, vocabulary, relative)]
        return b"".join([*parts, quantised(p).tobytes(), quantised(backoff).tobytes()])

    @classmethod
    def mapped(cls, levels: bytes) -> Trie:
        memory = mmap.mmap(-1, max(1, len(levels)))
        memory.write(levels)
        return cls(memory)

    def context(self, names: np.ndarray) -> np.ndarray:
        """The number of every context, -1 for unknown ones."""
        if not self.contexts.n:
            return np.full(len(names), -1)
        at = self.contexts.successor(names)
        known = at < self.contexts.n
        known[known] = self.contexts[at[known]] == names[known]
        return np.where(known, at, -1)

    def lookup(self, context: np.ndarray, successors: np.ndarray) -> np.ndarray:
        """Codes of the probabilities, MISSING where the successor does not follow the context."""
        out = np.full(len(context), MISSING, np.uint16)
        open_ = np.flatnonzero(context >= 0)
        number = self.vocabulary.successor(successors[open_])
        known = number < self.vocabulary.n
        known[known] = self.vocabulary[number[known]] == successors[open_[known]]
        open_, number = open_[known], number[known]
        want = number.astype(np.uint64) + context[open_].astype(np.uint64) * np.uint64(self.vocabulary.n)
        at = self.successors.successor(want)
        inside = at < self.pointers[context[open_] + 1].astype(np.int64)
        open_, at, want = open_[inside], at[inside], want[inside]
        same = self.successors[at] == want
        out[open_[same]] = self.probabilities[at[same]]
        return out


def _tokens(column) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, tokens per text) of the words of all texts, each with the end after them."""
    data, offsets = T.text_bytes(column)
    data = T.LOWER[data]
    starts, ends, first = T.spans(data, offsets, T.NOT_SPACE)
    words = T.hasher().segments(data, starts, ends)
    counts = np.diff(first)
    out = np.full(len(words) + len(counts), END)
    out[np.arange(len(words)) + np.repeat(np.arange(len(counts)), counts)] = words
    return out, counts + 1


def _before(local: np.ndarray, counts: np.ndarray, start: int) -> np.ndarray:
    """The token before each token."""
    previous = np.roll(local, 1)
    previous[np.cumsum(counts) - counts] = start
    return previous


def _block_table(docs: DataFrame) -> DataFrame:
    def run(batches):
        for chunk, block in zip(B.chunk_ids(), T.blocks(batches, "text")):
            hashes, counts = _tokens(block.column("text"))
            words, local = np.unique(hashes, return_inverse=True)
            train = block.column("train").to_numpy(zero_copy_only=False).astype(bool)
            learnt = np.repeat(train, counts)
            seen = np.bincount(local[learnt], minlength=len(words))
            order = np.argsort(-np.bincount(local, minlength=len(words)), kind="stable")
            number = np.empty(len(words), np.int64)
            number[order] = np.arange(len(words))
            pairs = _before(local, counts, len(words)).astype(np.int64) * len(words) + local
            frequent = np.flatnonzero(seen > HOT * learnt.sum())
            yield pa.RecordBatch.from_pylist(
                [
                    {
                        "chunk": chunk,
                        "ids": block.column("doc_id").to_pylist(),
                        "train": np.packbits(train).tobytes(),
                        "counts": T.pack(T.smallest(counts)),
                        "seq": T.pack(T.smallest(number[local])),
                        "order": T.pack(T.smallest(order)),
                        "words": T.pack_deltas(words),
                        "seen": T.pack(T.smallest(seen)),
                        "n_words": len(words),
                        "n_pairs": len(np.unique(pairs)),
                        "n_tokens": int(learnt.sum()),
                        "n_docs": int(train.sum()),
                        "frequent": [{"word": w, "n": n} for w, n in zip(words[frequent].view(np.int64).tolist(), seen[frequent].tolist())],
                    }
                ],
                pa.schema(
                    [
                        ("chunk", pa.int64()),
                        ("ids", pa.list_(pa.int64())),
                        *((c, pa.binary()) for c in ("train", "counts", "seq", "order", "words", "seen")),
                        *((c, pa.int64()) for c in ("n_words", "n_pairs", "n_tokens", "n_docs")),
                        ("frequent", pa.list_(pa.struct([("word", pa.int64()), ("n", pa.int64())]))),
                    ]
                ),
            )

    return docs.select("doc_id", "text", F.coalesce("train", F.lit(False)).alias("train")).mapInArrow(run, TABLE)


def _hot_counts(table: DataFrame, tokens: int, documents: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, training counts) of the hot contexts, ascending; the start mark is one of them."""
    found = table.select(F.explode("frequent").alias("w")).groupBy("w.word").agg(F.sum("w.n").alias("n"))
    # A word above the share in the corpus is above it in some block; at most 1 / HOT stay.
    words = [row.word for row in found.filter(F.col("n") > HOT * tokens).select("word").collect()]
    hot = np.sort(np.array(words, np.int64).view(np.uint64))

    def exact(batches):
        for batch in batches:
            total = np.zeros(len(hot), np.int64)
            for row in batch.to_pylist():
                names, seen = T.unpack_deltas(row["words"]), T.unpack(row["seen"])
                at = np.minimum(np.searchsorted(names, hot), len(names) - 1)
                total += np.where(names[at] == hot, seen[at], 0).astype(np.int64)
            yield pa.RecordBatch.from_pydict({"word": pa.array(hot.view(np.int64)), "n": pa.array(total)})

    counts = table.select("words", "seen").mapInArrow(exact, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")) if len(hot) else None
    known = {row.word & T.MASK: row.n for row in counts.collect()} if len(hot) else {}
    known[int(START)] = documents
    names = np.array(sorted(known), np.uint64)
    return names, np.array([known[int(n)] for n in names], np.int64)


def _sections(*arrays: bytes) -> bytes:
    return b"".join(len(a).to_bytes(4, "little") + a for a in arrays)


def _cut(body: bytes) -> list[bytes]:
    out, at = [], 0
    while at < len(body):
        n = int.from_bytes(body[at : at + 4], "little")
        out.append(body[at + 4 : at + 4 + n])
        at += 4 + n
    return out


def score(docs: DataFrame, discount: float = DISCOUNT, model_path: str | None = None) -> DataFrame:
    """Scores of every text under the model of those whose ``train`` is true.

    (doc_id, train, n_tokens, n_known, train_tokens, base_score, score): ``base_score`` is the log10
    probability under p(w) alone, ``score`` under the whole model; ``n_known`` counts tokens that occur
    in training texts. With ``model_path`` the tries are also written there, one row per shard.
    """
    B.prepare(docs.sparkSession)
    table = B.block_table(_block_table(docs), "lm")
    tokens, documents = B.total(table, "n_tokens"), B.total(table, "n_docs")
    shards = B.shard_count(B.total(table, "n_pairs"))
    hot, hot_counts = _hot_counts(table, tokens, documents)

    class Block:
        """Tokens and distinct bigrams of a block, and where they live."""

        def __init__(self, row):
            self.words = T.unpack_deltas(row["words"])
            self.counts = T.unpack(row["counts"]).astype(np.int64)
            self.local = T.unpack(row["order"]).astype(np.int64)[T.unpack(row["seq"])]
            self.train = np.unpackbits(np.frombuffer(row["train"], np.uint8), count=len(self.counts)).astype(bool)
            names = np.concatenate([self.words, np.array([START], np.uint64)])
            at = np.minimum(np.searchsorted(hot, names), len(hot) - 1)
            self.hot = np.where(hot[at] == names, at, -1)
            homes = B.shard_of(self.words, shards)
            self.word_runs = B.runs(homes)
            width = len(self.words)
            pairs = _before(self.local, self.counts, width) * width + self.local
            distinct, self.pair = np.unique(pairs, return_inverse=True)
            self.v, self.w = distinct // width, distinct % width
            place = self.hot[self.v]
            home = np.where(place >= 0, homes[self.w], np.append(homes, 0)[self.v])
            self.order = np.argsort(home * (len(hot) + 1) + place + 1, kind="stable")
            # A shard that has bigrams has a token of them too.
            self.pair_runs = B.runs(home[self.order])

        def pairs_of(self, shard: int) -> np.ndarray:
            return self.order[slice(*self.pair_runs.get(shard, (0, 0)))]

    def requests(row):
        block = Block(row)
        seen = T.unpack(row["seen"])
        counts = np.bincount(block.pair[np.repeat(block.train, block.counts)], minlength=len(block.v))
        for shard, (a, b) in block.word_runs.items():
            pairs = block.pairs_of(shard)
            v = block.v[pairs]
            place = block.hot[v]
            runs = np.bincount(v[place < 0] - a, minlength=b - a)
            hot_runs = np.bincount(place[place >= 0], minlength=len(hot))
            yield shard, _sections(
                T.pack_deltas(block.words[a:b]),
                T.pack(seen[a:b]),
                T.pack(T.smallest(runs)),
                T.pack(T.smallest(hot_runs)),
                T.pack(block.words[block.w[pairs]] >> np.uint64(24)),
                T.pack(T.smallest(counts[pairs])),
            )

    def serve(bodies, _):
        asked = []
        for body in bodies:
            words, seen, runs, hot_runs, successors, counts = _cut(body)
            words = T.unpack_deltas(words)
            contexts = np.concatenate([np.repeat(words, T.unpack(runs)), np.repeat(hot, T.unpack(hot_runs))])
            asked.append((words, T.unpack(seen).astype(np.int64), contexts, T.unpack(successors), T.unpack(counts).astype(np.int64)))
        words, seen, contexts, successors, counts = (np.concatenate(x) for x in zip(*asked))
        names, at = np.unique(words, return_inverse=True)
        totals = np.zeros(len(names), np.int64)
        np.add.at(totals, at, seen)
        learnt = counts > 0
        contexts, successors, counts = contexts[learnt], successors[learnt], counts[learnt]
        order = np.lexsort((successors, contexts))
        contexts, successors, counts = contexts[order], successors[order], counts[order]
        new = np.ones(len(contexts), bool)
        new[1:] = (contexts[1:] != contexts[:-1]) | (successors[1:] != successors[:-1])
        starts = np.flatnonzero(new)
        counts = np.add.reduceat(counts, starts) if len(starts) else counts
        contexts, successors = contexts[starts], successors[starts]
        first = np.flatnonzero(np.concatenate([np.ones(min(1, len(contexts)), bool), contexts[1:] != contexts[:-1]]))
        pointers = np.append(first, len(contexts))
        own = contexts[first]
        place = np.minimum(np.searchsorted(hot, own), len(hot) - 1)
        is_hot = hot[place] == own
        of = np.where(is_hot, hot_counts[place], totals[np.minimum(np.searchsorted(names, own), max(len(names) - 1, 0))] if len(names) else 0)
        followers = np.diff(pointers)
        p = (counts - discount) / np.repeat(of, followers)
        trie = Trie.mapped(levels := Trie.levels(own, pointers, successors, p, discount * followers / np.maximum(of, 1)))
        out = []
        for words, _, contexts, successors, _ in asked:
            cut = np.flatnonzero(np.concatenate([np.ones(min(1, len(contexts)), bool), contexts[1:] != contexts[:-1]]))
            known = np.repeat(trie.context(contexts[cut]), np.diff(np.append(cut, len(contexts))))
            of_word = trie.context(words)
            backoffs = np.where(of_word >= 0, trie.backoffs[of_word] if trie.contexts.n else MISSING, MISSING).astype(np.uint16)
            out.append(
                _sections(
                    T.pack(T.smallest(totals[np.searchsorted(names, words)])),
                    T.pack(backoffs),
                    T.pack(trie.lookup(known, successors)),
                )
            )
        hot_followers = np.zeros(len(hot), np.int64)
        hot_followers[place[is_hot]] = followers[is_hot]
        out.append(np.append(hot_followers, (totals > 0).sum()).astype(np.int64).tobytes())
        return [*out, levels] if model_path else out

    answers = B.written(B.answer(B.ask(table, requests, "ids", "train", "counts", "seq", "order", "words", "seen"), serve), "answers")
    reports = answers.filter("chunk = -1")
    if model_path:
        reports.filter(F.octet_length("body") != 8 * (len(hot) + 1)).select("shard", F.col("body").alias("levels")).write.parquet(model_path)

    def spread(batches):
        for batch in batches:
            for body in batch.column("body").to_pylist():
                values = np.frombuffer(body, np.int64)
                yield pa.RecordBatch.from_pydict({"place": pa.array(np.arange(len(values))), "n": pa.array(values)})

    sums = reports.filter(F.octet_length("body") == 8 * (len(hot) + 1)).select("body").mapInArrow(spread, "place long, n long")
    sums = {row.place: row.n for row in sums.groupBy("place").agg(F.sum("n").alias("n")).collect()}
    types = sums.get(len(hot), 0)
    # Backoff weights of the hot contexts, from their followers in all shards.
    hot_backoff = np.array([discount * sums.get(i, 0) / n if n else 1.0 for i, n in enumerate(hot_counts.tolist())])

    def finish(row, bodies):
        block = Block(row)
        width = len(block.words)
        seen, backoff = np.zeros(width, np.int64), np.ones(width + 1)
        p = np.zeros(len(block.v))
        for shard, body in bodies.items():
            a, b = block.word_runs[shard]
            totals, weights, codes = map(T.unpack, _cut(body))
            seen[a:b] = totals
            backoff[a:b] = np.where(weights == MISSING, 1.0, restored(weights))
            p[block.pairs_of(shard)] = restored(codes)
        at = np.flatnonzero(block.hot >= 0)
        backoff[at] = hot_backoff[block.hot[at]]
        base = (seen + 1) / (tokens + types + 1)
        logs = np.log10(p + backoff[block.v] * base[block.w])
        starts = np.cumsum(block.counts) - block.counts

        def summed(values):
            return np.add.reduceat(values, starts) if len(starts) else np.empty(0, values.dtype)

        return pa.table(
            {
                "doc_id": pa.array(row["ids"], pa.int64()),
                "train": pa.array(block.train),
                "n_tokens": pa.array(block.counts, pa.int64()),
                "n_known": pa.array(summed((seen > 0).astype(np.int64)[block.local]), pa.int64()),
                "train_tokens": pa.array(np.full(len(starts), tokens), pa.int64()),
                "base_score": pa.array(summed(np.log10(base)[block.local]), pa.float64()),
                "score": pa.array(summed(logs[block.pair]), pa.float64()),
            }
        )

    return B.combine(table, answers.filter("chunk >= 0"), finish, SCORES)
