"""Language identification, words first, character n-grams for words never seen.

``train`` counts the words of every language and keeps smoothed log frequencies: of words, and of
character n-grams (1 to NGRAM characters, with word edges) weighted by word counts. ``predict`` scores
a text as the sum over its words: a known word by its log frequency per language; an unknown word by
its n-grams, from the left the longest known one at each place, then the next shorter, down to single
characters. Distinct words of a block are scored once.

Every language that occurs is learned, from a bounded sample of its labelled rows: about an equal share of
TRAIN_DOCS documents but LEAST_DOCS at least, of the smallest hashes of id and text, with at
most WORDS words and NGRAMS n-grams (the most frequent). Beyond LANGUAGES languages there are fewer words
and n-grams of each, so the model keeps its size and may be broadcast. Prediction covers all rows.

Defined results: a text that is null or has no letter is ``und`` with score 0; so is every text when
there is no labelled row. Equal scores go to the language first in alphabetical order. Repeated rows
are predicted alike; a null ``doc_id`` is kept. Long texts are blocks of their own.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from logquarry.llm import blocks as B
from logquarry.llm import text as T

TRAIN_DOCS = 20_000
WORDS = 50_000
NGRAMS = 20_000
NGRAM = 4
# Documents of a language with many, where languages are many.
LEAST_DOCS = 200
# Beyond so many languages each gets fewer features: all languages are learned.
LANGUAGES = 32
UNKNOWN = "und"
FEATURES = "lang string, kind int, feature string, n long"
LETTERS = regex.compile(r"\p{L}+(?:['’]\p{L}+)*")
# Scores of words, one per word and language, that a task keeps between blocks.
CACHE = 4_800_000
# Texts whose words are counted at once.
COUNTED = 250
# Bytes of text in a block: its words are Python strings for a while.
BLOCK = 2 << 20


class Features:
    """Log frequencies of features: one base per language, and entries where a feature was counted."""

    def __init__(self, features: list[str], columns: np.ndarray, counts: np.ndarray, languages: int):
        self.places: dict[str, int] = {}
        at = np.array([self.places.setdefault(f, len(self.places)) for f in features], np.int64)
        n = len(self.places)
        totals = np.bincount(columns, weights=counts, minlength=languages) + 0.5 * n
        order = np.argsort(at, kind="stable")
        self.columns = columns[order]
        self.values = np.log((counts[order] + 0.5) / totals[self.columns])
        self.first = np.searchsorted(at[order], np.arange(n + 1))
        self.base = np.log(0.5 / totals) if n else np.zeros(languages)
        absent = np.bincount(columns, minlength=languages) < n
        self.least = min(self.values.min(initial=0.0), self.base[absent].min(initial=0.0))

    def row(self, place: int) -> np.ndarray:
        a, b = self.first[place], self.first[place + 1]
        out = self.base.copy()
        out[self.columns[a:b]] = self.values[a:b]
        return out


class Model:
    """Scores of words by language, from the features of ``train``."""

    def __init__(self, rows: pa.Table):
        langs, kinds, features, n = (rows.column(c).to_pylist() for c in ("lang", "kind", "feature", "n"))
        self.languages = sorted(set(langs))
        column = {lang: i for i, lang in enumerate(self.languages)}
        columns, counts, kinds = np.array([column[x] for x in langs], np.int64), np.array(n, float), np.array(kinds, np.int64)
        self.known, self.grams = (
            Features([features[i] for i in np.flatnonzero(kinds == kind).tolist()], columns[kinds == kind], counts[kinds == kind], len(self.languages))
            for kind in (0, 1)
        )
        self.floor = np.full(len(self.languages), self.grams.least)
        self.words: dict[str, int] = {}
        self.table = np.empty((CACHE // max(len(self.languages), LANGUAGES), len(self.languages)))

    def rows(self, words: list[str]) -> np.ndarray:
        """The log frequencies of distinct words, in their order."""
        if len(self.words) + len(words) > len(self.table):
            self.words = {}
        if len(words) > len(self.table):
            self.table = np.empty((len(words), len(self.languages)))
        at = np.empty(len(words), np.int64)
        for i, word in enumerate(words):
            place = self.words.get(word)
            if place is None:
                place = self.words[word] = len(self.words)
                known = self.known.places.get(word)
                self.table[place] = self._unknown(word) if known is None else self.known.row(known)
            at[i] = place
        return self.table[at]

    def _unknown(self, word: str) -> np.ndarray:
        marked = f"\x02{word}\x03"
        total, i = self.floor * 0, 0
        while i < len(marked):
            for n in range(min(NGRAM, len(marked) - i), 0, -1):
                found = self.grams.places.get(marked[i : i + n])
                if found is not None:
                    total += self.grams.row(found)
                    break
            else:
                n = 1
                total += self.floor
            i += n
        return total


def train(labelled: DataFrame) -> DataFrame:
    """(lang, kind, feature, n): counts of words (kind 0) and n-grams (kind 1) of ``text`` by ``lang``."""

    def count(batches):
        for batch in (b.slice(i, COUNTED) for b in batches for i in range(0, len(b), COUNTED)):
            found: Counter = Counter()
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
                for word in LETTERS.findall(text.lower()):
                    found[lang, word] += 1
            yield pa.RecordBatch.from_pydict(
                {
                    "lang": pa.array([k[0] for k in found], pa.string()),
                    "kind": pa.array([0] * len(found), pa.int32()),
                    "feature": pa.array([k[1] for k in found], pa.string()),
                    "n": pa.array(list(found.values()), pa.int64()),
                }
            )

    def grams(batches):
        for batch in batches:
            found: Counter = Counter()
            for lang, word, n in zip(*(batch.column(c).to_pylist() for c in ("lang", "feature", "n"))):
                marked = f"\x02{word}\x03"
                for size in range(1, NGRAM + 1):
                    for i in range(len(marked) - size + 1):
                        found[lang, marked[i : i + size]] += n
            yield pa.RecordBatch.from_pydict(
                {
                    "lang": pa.array([k[0] for k in found], pa.string()),
                    "kind": pa.array([1] * len(found), pa.int32()),
                    "feature": pa.array([k[1] for k in found], pa.string()),
                    "n": pa.array(list(found.values()), pa.int64()),
                }
            )

    def summed(df: DataFrame) -> DataFrame:
        return df.groupBy("lang", "kind", "feature").agg(F.sum("n").alias("n"))

    usable = labelled.filter("lang is not null and text is not null")
    named = usable.groupBy("lang").count().collect()
    # The bounded sample: hashes below the share that is wanted of a language.
    share = max(TRAIN_DOCS // max(len(named), 1), LEAST_DOCS)
    place = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 40))
    near = F.lit(0)
    if named:
        shares = {row.lang: int(min(1.0, share / row["count"]) * (1 << 40)) for row in named}
        near = F.create_map(*[F.lit(x) for pair in shares.items() for x in pair])[F.col("lang")]
    sample = usable.withColumn("near", near).filter(place < F.col("near")).select("lang", "text")
    fewer = min(1.0, LANGUAGES / max(len(named), 1))
    words = summed(sample.mapInArrow(count, FEATURES))
    words = B.written(words, "words")
    return B.written(_most(words, max(1, int(WORDS * fewer))).union(_most(summed(words.mapInArrow(grams, FEATURES)), max(1, int(NGRAMS * fewer)))), "langid")


def _most(counts: DataFrame, n: int) -> DataFrame:
    """The n most frequent features of every language."""
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "feature")
    return counts.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= n).drop("place")


def predict(docs: DataFrame, model: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``keep`` of ``docs``, with ``lang_pred`` and ``score``.

    The score is the probability of the language under the model, with the evidence per word tempered
    by the root of the number of words, between 0 and 1.
    """
    spark = B.prepare(docs.sparkSession)
    held = spark.sparkContext.broadcast(model.toArrow())

    def run(batches):
        scorer = Model(held.value)
        for block in T.blocks(batches, "text", int(BLOCK * min(1.0, LANGUAGES / max(len(scorer.languages), 1)))):
            local: dict[str, int] = {}
            parts = []
            for text in block.column("text").to_pylist():
                words = LETTERS.findall(text.lower()) if text else []
                parts.append(np.array([local.setdefault(w, len(local)) for w in words], np.int64))
            table = scorer.rows(list(local))
            langs, scores = [], []
            for places in parts:
                if not len(places) or not scorer.languages:
                    langs.append(UNKNOWN)
                    scores.append(0.0)
                    continue
                total = table[places].sum(axis=0)
                best = int(np.argmax(total))
                langs.append(scorer.languages[best])
                scores.append(float(1 / np.exp((total - total[best]) / math.sqrt(len(places))).sum()))
            out = block.select(list(keep)).append_column("lang_pred", pa.array(langs, pa.string()))
            yield from out.append_column("score", pa.array(scores, pa.float64())).to_batches()

    kept = docs.select(*keep).schema
    schema = kept.add("lang_pred", "string").add("score", "double")
    return docs.select(*dict.fromkeys([*keep, "text"])).mapInArrow(run, schema)
