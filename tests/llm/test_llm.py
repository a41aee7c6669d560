"""The training-data operators against plain Python, with null, empty, long, tied and repeated rows."""

import base64
import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import public_tokenizers
import regex
import tiktoken
from pyspark.sql import functions as F

from logquarry.llm import bpe, decontaminate, langid, licenses, linededup, lm, neardup, queries, suffixdedup, topk, warc
from logquarry.llm.eliasfano import EliasFano
from logquarry.llm.mph import MinimalHash
from logquarry.llm.text import splitmix

# Extra columns with names that the operators use themselves.
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, chunk long, row long, score string, shard int"
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
SF_DIR = "/root/testdata/sf0.01"
SPACES = "[\x20\x09-\x0d]+"


def low(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def words(text):
    return [w for w in re.split(SPACES, low(text)) if w]


def corpus(seed=5, n=60):
    """Texts with exact and near copies, shared lines and passages, junk, nulls and a long text."""
    rng = random.Random(seed)
    stock = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 6))) for _ in range(300)]

    def prose(k):
        return " ".join(rng.choice(stock) for _ in range(k))

    line = "A line that MANY documents share, word for word."
    passage = prose(60)
    texts = []
    for i in range(n):
        text = "\n".join(prose(rng.randint(5, 30)) for _ in range(rng.randint(1, 6)))
        if i % 4 == 0:
            text += "\n  " + (line if i % 8 else line.upper()) + "\t\n" + prose(5)
        if i % 7 == 0:
            text = prose(9) + " " + passage + " " + text
        texts.append(text)
    texts += texts[:5]  # exact copies
    for text in texts[10:20]:  # near copies
        cut = text.split(" ")
        cut[len(cut) // 2] = "changed"
        texts.append(" ".join(cut))
    texts += [None, "", "   \t ", "x", "one two three four", "one two three four", "!!! ??? 12", " ".join(["orre"] * 700)]
    texts.append(prose(20_000))
    return [(i, t) for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def rows():
    return corpus()


def frame(spark, rows):
    full = [(i, t, None if t is None else ("aa" if (i or 0) % 2 else "bb"), "s", 1, 7, 7, "x", 7) for i, t in rows]
    return spark.createDataFrame(full, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def docs(spark, rows):
    return frame(spark, rows).cache()


@pytest.fixture(scope="module")
def odd(spark):
    """Repeated rows and rows without an id."""
    text = "this row is here more than once and it has more than five words"
    return frame(spark, [(1, text), (1, text), (None, text), (None, None), (2, "alone")])


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


# Structures


def test_elias_fano_finds_successors():
    rng = np.random.default_rng(3)
    for n, top in ((1, 1), (7, 1 << 62), (1000, 50), (3000, 1 << 40)):
        values = np.sort(rng.integers(0, top, n, dtype=np.uint64))
        kept, _ = EliasFano.at(EliasFano.of(values).tobytes(), 0)
        asked = np.concatenate([values, values + np.uint64(1), rng.integers(0, top, 500, dtype=np.uint64)])
        assert (kept[np.arange(n)] == values).all()
        assert (kept.successor(asked) == np.searchsorted(values, asked)).all()


def test_minimal_hash_numbers_every_key_once():
    for n in (0, 1, 5, 20_000):
        a, b = splitmix(np.arange(n, dtype=np.uint64)), splitmix(np.arange(n, dtype=np.uint64) + np.uint64(n))
        a[: n // 3] = 7  # keys that differ in one half only
        place = MinimalHash(a, b)
        assert sorted(place(a, b).tolist()) == list(range(n))


# 1 decontamination


def brute_hits(text, items, n):
    doc = re.findall(r"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", low(text))
    hit, found = set(), set()
    for item, body in items:
        w = re.findall(r"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", low(body))
        size = min(n, len(w))
        for i in range(len(w) - size + 1 if w else 0):
            for j in range(len(doc) - size + 1):
                if doc[j : j + size] == w[i : i + size]:
                    hit |= set(range(j, j + size))
                    found.add(str(item))
    return len(doc), len(hit), sorted(found)


@pytest.mark.parametrize("limit", [decontaminate.MAX_BROADCAST, 0])
def test_decontamination(spark, docs, rows, limit):
    long_item = " ".join(words(rows[7][1])[9:40])
    items = [(1, long_item), (2, "CHANGED"), (3, None), (4, "..."), (10, long_item), (None, "x"), (5, "one, two THREE"), (5, "one, two THREE")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {r.doc_id: r for r in decontaminate.report(docs, bench, max_broadcast=limit).collect()}
    known = [i for i in items if i[0] is not None]
    for i, text in rows:
        assert (got[i].n_words, got[i].n_hit, got[i]["items"]) == brute_hits(text, known, 10), i
    kept = decontaminate.clean(docs, bench, max_broadcast=limit)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {i for i in got if not got[i].n_hit}
    cut = {r.doc_id: r.text for r in decontaminate.clean(docs, bench, remove="spans", max_broadcast=limit).collect()}
    assert cut.keys() == got.keys()
    assert all((cut[i] == text) == (not got[i].n_hit) for i, text in rows)


@pytest.mark.parametrize("limit", [decontaminate.MAX_BROADCAST, 0])
def test_items_without_an_id(spark, limit):
    docs = frame(spark, [(1, "here the hidden words are"), (2, "none of these"), (3, "the hidden words of one")])
    bench = spark.createDataFrame([(None, "hidden words"), (9, "of one")], "item_id long, text string")
    got = {r.doc_id: r for r in decontaminate.report(docs, bench, max_broadcast=limit, unnamed=True).collect()}
    assert [(got[i].n_hit, got[i]["items"]) for i in (1, 2, 3)] == [(2, []), (0, []), (4, ["9"])]
    assert [r.doc_id for r in decontaminate.clean(docs, bench, max_broadcast=limit, unnamed=True).collect()] == [2]


def test_decontamination_of_nothing(spark, docs, empty, odd):
    bench = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.report(docs, bench).filter("n_hit > 0").count() == 0
    assert decontaminate.report(empty, bench).count() == 0
    assert decontaminate.report(odd, bench).count() == 5


# 2 WARC


def test_warc_round_trip(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "SHARD_BYTES", 20_000)
    big = "é" * 800
    pages = [(i, f"http://h/{i}\r\nx" if i % 2 else None, [big, f"{i}" * 2000, "small", None, ""][i % 5]) for i in range(40)]
    pages += [(None, "u", big), (39, "u", "small"), (36, "v", f"{36}" * 2000)]
    frame = spark.createDataFrame([(*p, "z") for p in pages], "page_id long, url string, html string, kind string")
    made = warc.write(frame.repartition(4), str(tmp_path / "a")).orderBy("file").collect()
    again = warc.write(frame.repartition(3), str(tmp_path / "b")).orderBy("file").collect()
    assert len(made) > 1 and [r.asDict() for r in made] == [r.asDict() for r in again]
    largest = {}
    for i, _, html in pages:
        if i is not None:
            largest[html] = max(i, largest.get(html, -1))
    want = []
    for i, _, html in pages:
        raw = (html or "").encode()
        last = largest[html] if len(raw) >= 1000 else i
        same = last == i or len(raw) < 1000
        want.append((str(i), len(raw), hashlib.sha1(raw).hexdigest(), "response" if same else "revisit", None if same else last))
    got = warc.read(spark, str(tmp_path / "a")).collect()
    assert sorted((str(r.page_id), r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got) == sorted(want, key=lambda r: r[:3])
    assert all(r.payload is None if r.record_type == "revisit" else hashlib.sha1(r.payload).hexdigest() == r.payload_digest for r in got)
    none = warc.write(frame.limit(0), str(tmp_path / "c"))
    assert none.count() == 0 and warc.read(spark, str(tmp_path / "c")).count() == 0


# 3 licences


def test_licences(spark, empty, odd):
    mit = licenses.TEMPLATES["MIT"][0]
    rows = [
        (1, mit), (2, "intro\n\n" + mit.replace("Software", "software") + "\n\nmore"), (3, "x\nReleased under the MIT License.\ny"),
        (4, mit + "".join(f" word{i}" for i in range(100))), (5, None), (6, ""), (7, "All rights reserved."), (8, "nothing of the kind is said here"),
    ]
    got = {r.doc_id: r for r in licenses.scan(frame(spark, rows)).collect()}
    assert [got[i].license for i in range(1, 9)] == ["MIT", "MIT", "MIT", None, None, None, "proprietary", None]
    assert got[1].dice == 1.0 and got[3].n_matches == 1 and got[5].licenses == []
    assert licenses.scan(empty).count() == 0 and licenses.scan(odd).count() == 5
    assert licenses.scan(odd, templates={}).filter("n_matches > 0").count() == 0


def test_licences_in_runs(spark, odd):
    """Published texts of several paragraphs, inside longer documents and without a blank line around."""
    mit, bsd = (licenses.TEMPLATES[n][0] for n in ("MIT", "BSD-3-Clause"))
    for mark in ("The above copyright", "THE SOFTWARE IS PROVIDED"):
        mit = mit.replace("\n", " ").replace(mark, "\n\n" + mark)
    for mark in ("1. Redis", "2. Redis", "3. Neither", "THIS SOFTWARE IS PROVIDED"):
        bsd = bsd.replace("\n", " ").replace(mark, "\n\n" + mark)
    other = "\n".join(" ".join(f"word{i}_{k}" for k in range(9)) for i in range(40))
    wrapped = licenses.TEMPLATES["MIT"][0]
    rows = [(1, f"{other}\n\n{mit}\n\n{other}"), (2, f"{other}\n\n{bsd}\n\n{other}"), (3, f"{other}\n{wrapped}\n{other}"), (4, other), (5, None), (6, "All rights reserved."), (7, mit[:300])]
    got = {r.doc_id: r for r in licenses.scan(frame(spark, rows), runs=True).collect()}
    assert [got[i].license for i in range(1, 8)] == ["MIT", "BSD-3-Clause", "MIT", None, None, "proprietary", None]
    assert got[3].dice == 1.0 and got[3].n_matches == 1 and got[6].n_matches == 1
    assert licenses.scan(odd, runs=True).count() == 5


# 4 language model


def test_lm_is_the_model_of_the_docstring(docs, rows, empty, odd, monkeypatch):
    monkeypatch.setattr(lm.B, "LEAST_SHARDS", 5)
    got = {r.doc_id: r for r in lm.score(docs.withColumn("train", F.col("doc_id") % 3 != 0)).collect()}
    tokens = {i: [*words(t), "\n"] for i, t in rows}
    c, pairs = Counter(), Counter()
    for i, w in tokens.items():
        if i % 3:
            c.update(w)
            pairs.update(zip(["\r", *w], w))
    n, v = sum(c.values()), len(c)
    context, followers = Counter(), Counter()
    for (a, _), k in pairs.items():
        context[a] += k
        followers[a] += 1

    def p1(w):
        return (c[w] + 1) / (n + v + 1)

    def p2(a, w):
        if not context[a]:
            return p1(w)
        d = lm.DISCOUNT
        return max(pairs[a, w] - d, 0) / context[a] + d * followers[a] / context[a] * p1(w)

    total = sum(p2("\r", w) for w in c) + p2("\r", None)
    assert total == pytest.approx(1)
    for i, w in tokens.items():
        r = got[i]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(w), sum(c[x] > 0 for x in w), n)
        assert r.base_score == pytest.approx(sum(math.log10(p1(x)) for x in w))
        assert r.score == pytest.approx(sum(math.log10(p2(a, x)) for a, x in zip(["\r", *w], w)), abs=3e-4 * len(w))
    assert lm.score(empty.withColumn("train", F.lit(True))).count() == 0
    untrained = lm.score(odd.withColumn("train", F.lit(None).cast("boolean"))).collect()
    assert {(r.train_tokens, r.score) for r in untrained} == {(0, 0.0)}


def test_lm_keeps_its_tries(docs, tmp_path):
    lm.score(docs.withColumn("train", F.lit(True)), model_path=str(tmp_path / "m"))
    tries = docs.sparkSession.read.parquet(str(tmp_path / "m")).collect()
    assert sum(lm.Trie.mapped(r.levels).successors.n for r in tries) > 1000


# 5 language ID


def test_language_id(spark, empty, odd):
    rng = random.Random(2)
    parts = {"aa": ["ka", "lo", "mi", "nu"], "bb": ["sch", "ung", "ein", "der"]}
    rows = []
    for i in range(200):
        lang = "aa" if i % 2 else "bb"
        text = " ".join("".join(rng.choice(parts[lang]) for _ in range(rng.randint(1, 3))) for _ in range(30))
        rows.append((i, text, lang))
    data = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.train(data.filter("doc_id % 4 <> 2"))
    unseen = spark.createDataFrame([(1000, "kalomikalominunu lolololololo"), (1001, None), (1002, "12 !!"), (1003, "UNGEINDERSCHUNGUNGUNG")], "doc_id long, text string")
    got = {r.doc_id: r for r in langid.predict(data.select("doc_id", "text").union(unseen), model).collect()}
    assert all(got[i].lang_pred == lang for i, _, lang in rows)
    assert [got[i].lang_pred for i in range(1000, 1004)] == ["aa", "und", "und", "bb"]
    assert all(0 <= r.score <= 1 for r in got.values()) and got[1001].score == 0
    none = langid.train(empty)
    assert none.count() == 0
    assert {(r.lang_pred, r.score) for r in langid.predict(odd, none).collect()} == {("und", 0.0)}
    assert langid.predict(empty, model).count() == 0


def language_by_hand(labelled, texts):
    """(language, score) of each text: words by log frequency, other words by their longest known n-grams."""
    langs = sorted({lang for _, lang in labelled})
    letters = regex.compile(r"\p{L}+(?:['’]\p{L}+)*")
    known, grams = ({lang: Counter() for lang in langs} for _ in range(2))
    for text, lang in labelled:
        for word in letters.findall((text or "").lower()):
            known[lang][word] += 1
            marked = "\x02" + word + "\x03"
            grams[lang].update(marked[a : a + n] for n in range(1, 5) for a in range(len(marked) - n + 1))

    def logs(counts):
        every = set().union(*counts.values())
        return {lang: {f: math.log((c[f] + 0.5) / (c.total() + 0.5 * len(every))) for f in every} for lang, c in counts.items()}

    word_logs, gram_logs = logs(known), logs(grams)
    floor = min(v for logs_ in gram_logs.values() for v in logs_.values())

    def of_word(word, lang):
        if word in word_logs[lang]:
            return word_logs[lang][word]
        rest, total = "\x02" + word + "\x03", 0.0
        while rest:
            n = next((n for n in (4, 3, 2, 1) if len(rest) >= n and rest[:n] in gram_logs[lang]), 0)
            total += gram_logs[lang][rest[:n]] if n else floor
            rest = rest[max(n, 1) :]
        return total

    out = []
    for text in texts:
        found = letters.findall((text or "").lower())
        if not found:
            out.append(("und", 0.0))
            continue
        totals = {lang: sum(of_word(w, lang) for w in found) for lang in langs}
        best = max(totals.values())
        # Of equal totals the first language, but for what rounding does to sums.
        first = next(lang for lang in langs if totals[lang] > best - 1e-9)
        out.append((first, 1 / sum(math.exp((t - best) / len(found) ** 0.5) for t in totals.values())))
    return out


def test_language_by_hand(spark):
    """Three languages, two of which learn the same: known and unseen words, ties, no letters, a very long text."""
    rng = random.Random(9)
    stock = {lang: ["".join(rng.choice(abc) for _ in range(rng.randrange(1, 7))) for _ in range(40)] for lang, abc in (("de", "abcdeü"), ("fr", "cdefghé"))}
    labelled = [(" ".join(rng.choices(stock[lang], k=12)), lang) for lang in stock for _ in range(30)]
    labelled += [(text, "fs") for text, lang in labelled if lang == "fr"] + [(None, "de"), ("", "fr")]
    unseen = ["".join(rng.choice("abcdefghüéz") for _ in range(rng.randrange(1, 9))) for _ in range(60)]
    texts = [" ".join(rng.choices(stock["de"] + stock["fr"] + unseen, k=rng.randrange(1, 9))) for _ in range(150)]
    texts += [None, "", "12 -- 3!", "ÜÉ d'ab zzz", "Ω", " ".join(rng.choices(stock["fr"] + unseen, k=200_000)), texts[0]]
    data = spark.createDataFrame([(i, t, lang) for i, (t, lang) in enumerate(labelled)], "doc_id long, text string, lang string")
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    got = {r.doc_id: r for r in langid.predict(docs, langid.train(data.repartition(3))).collect()}
    assert len(got) == len(texts)
    for i, (lang, score) in enumerate(language_by_hand(labelled, texts)):
        assert got[i].lang_pred == lang, texts[i]
        assert got[i].score == pytest.approx(score, abs=1e-6), texts[i]
    assert {r.lang_pred for r in got.values()} == {"de", "fr", "und"}  # never fs, which ties with fr


def test_languages_of_held_out_documents(spark):
    found = queries.op5_language_id(spark, SF_DIR).filter("held_out").drop("lang")
    true = spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "lang")
    rows = found.join(true, "doc_id").filter("lang is not null and lang_pred <> 'und'").collect()
    assert rows and sum(r.lang == r.lang_pred for r in rows) >= 0.98 * len(rows)


def test_every_language_is_learned(spark):
    """Forty languages, one of them in few rows of the corpus."""
    rng = random.Random(3)
    stock = [["".join(rng.choice("abcdefghijklmnop") for _ in range(6)) for _ in range(30)] for _ in range(40)]
    rows = [(k * 1000 + i, " ".join(rng.choice(stock[k]) for _ in range(20)), f"l{k:02}") for k in range(40) for i in range(3 if k == 39 else 15)]
    data = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.train(data)
    assert model.select("lang").distinct().count() == 40
    assert {(r.doc_id, r.lang_pred) for r in langid.predict(data, model).collect()} == {(i, lang) for i, _, lang in rows}


# 6 BPE


def reference_encoding():
    with open(RANKS, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    return ranks, tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe(docs, rows, empty, odd):
    ranks, encoding = reference_encoding()
    got = {r.doc_id: r for r in bpe.decode(bpe.encode(docs, RANKS, public_tokenizers.PATTERN), RANKS).collect()}
    for i, text in rows:
        assert np.frombuffer(got[i].ids, "<u4").tolist() == encoding.encode_ordinary(text or ""), i
        assert got[i].decoded.decode() == (text or "")
    rng = random.Random(1)
    for n in (1, 5, 65, 400):
        word = bytes(rng.choice("aethnor é日".encode()) for _ in range(n))
        assert bpe.encode_word(word, ranks) == encoding._core_bpe.encode_single_piece(word)
    assert bpe.encode(empty, RANKS, public_tokenizers.PATTERN).count() == 0
    assert bpe.encode(odd, RANKS, public_tokenizers.PATTERN).count() == 5


# 7 top-k


@pytest.mark.parametrize("shard", [10, 4096])
def test_top_k(spark, monkeypatch, shard):
    monkeypatch.setattr(topk, "SHARD_VECTORS", shard)
    monkeypatch.setattr(topk, "SEEDS", 20)
    rng = np.random.default_rng(4)
    rows = [(i, [float(x) for x in rng.normal(size=8) * (rng.random(8) < 0.5)]) for i in range(200)]
    rows += [(200 + i, rows[3][1]) for i in range(10)]  # ties
    rows += [(300, None), (350, [float("nan")] * 8), (400, [1.0, None]), (450, [float("inf")]), (None, rows[1][1]), (250, [1.0]), (500, [])]
    vectors = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<float>, score string")
    got = defaultdict(list)
    for r in topk.search(vectors, vectors.filter("vec_id % 50 = 0")).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    good = {i: [math.floor(256 * np.float32(x).item()) for x in v] for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)}
    for q in [i for i in good if i % 50 == 0]:
        scores = sorted((-sum(a * b for a, b in zip(good[q], v)), i) for i, v in good.items() if i != q)
        assert got[q] == [(i, -s) for s, i in scores[:5]], q
    assert set(got) == {i for i in good if i % 50 == 0}
    assert topk.search(vectors.limit(0), vectors.limit(0)).count() == 0


# 8 line dedup


def test_line_dedup(docs, rows, empty, odd):
    lines = {i: (t or "").split("\n") for i, t in rows}

    def key(line):
        return low(line).strip(" \t\n\r\x0b\x0c")

    holders = defaultdict(set)
    for i, all_lines in lines.items():
        for line in all_lines:
            if len(key(line)) >= 20:
                holders[key(line)].add(i)
    got = {r.doc_id: r for r in linededup.drop_common_lines(docs, keep=("source", "chunk")).collect()}
    for i, all_lines in lines.items():
        kept = [x for x in all_lines if len(holders[key(x)]) < 3 or max(holders[key(x)]) == i]
        assert (got[i].text, got[i].n_lines, got[i].n_dropped) == ("\n".join(kept), len(all_lines), len(all_lines) - len(kept)), i
        assert got[i].chunk == 7
    assert linededup.drop_common_lines(empty).count() == 0
    # The row without id is the smallest, and both rows with the largest id keep the line.
    assert sorted((str(r.doc_id), r.n_dropped) for r in linededup.drop_common_lines(odd).collect()) == [
        ("1", 0), ("1", 0), ("2", 0), ("None", 0), ("None", 1),
    ]


# 9 near duplicates


def brute_components(rows, percent):
    sets = {}
    for i, text in rows:
        w = words(text)
        sets[i] = {tuple(w[j : j + 5]) for j in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return {i: (len(sets[i]), find(i)) for i in sets}


@pytest.mark.parametrize("percent", [80, 85])
def test_near_duplicates(docs, rows, percent):
    want = brute_components(rows, percent)
    got = {r.doc_id: r for r in neardup.near_duplicates(docs, percent, keep=("row", "text")).collect()}
    assert {i: (r.n_shingles, r.component_id) for i, r in got.items()} == want
    assert all(r.kept == (r.component_id == i) == r.first and r.row == 7 for i, r in got.items())


def test_near_duplicate_families(spark):
    """Copies that resemble their source but not each other, chains, and copies of copies."""
    rng = random.Random(9)
    rows = []

    def edited(text, n):
        w = text.split()
        for at in rng.sample(range(len(w)), n):
            w[at] = f"e{rng.random()}"
        return " ".join(w)

    for family in range(6):
        base = " ".join(f"w{rng.randint(0, 10**6)}" for _ in range(300))
        rows.append(base)
        rows += [edited(base, 4 + family % 3) for _ in range(40)]
        chain = base
        for _ in range(6):
            chain = edited(chain, 5)
            rows.append(chain)
    rng.shuffle(rows)
    rows = list(enumerate(rows))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.near_duplicates(frame(spark, rows), 85).collect()}
    assert got == brute_components(rows, 85)


def test_near_duplicates_of_odd_rows(odd, empty):
    got = sorted((str(r.doc_id), str(r.component_id), r.kept, r.first) for r in neardup.near_duplicates(odd).collect())
    assert [g[:3] for g in got] == [
        ("1", "1", True), ("1", "1", True), ("2", "2", True), ("None", "1", False), ("None", "None", True),
    ]
    assert sum(g[3] for g in got) == 3
    assert neardup.near_duplicates(empty).count() == 0


# 10 repeated passages


def test_repeated_passages(spark, docs, rows, empty, odd):
    seen = Counter()
    tokens = {i: words(t) for i, t in rows}
    for w in tokens.values():
        seen.update(tuple(w[j : j + 50]) for j in range(len(w) - 49))
    got = {r.doc_id: r for r in suffixdedup.repeated_passages(docs).collect()}
    for i, w in tokens.items():
        cover = set()
        for j in range(len(w) - 49):
            if seen[tuple(w[j : j + 50])] > 1:
                cover |= set(range(j, j + 50))
        assert got[i].n_words == len(w)
        assert {x for s in got[i].spans for x in range(s.start, s.end)} == cover, i
        assert got[i].n_repeated == len(cover)
    assert suffixdedup.repeated_passages(empty).count() == 0
    assert suffixdedup.repeated_passages(odd).filter("n_repeated > 0").count() == 0


def test_passage_held_by_thousands(spark):
    """Two whole copies of a passage among many holders that each differ from it in one word."""
    rng = random.Random(7)
    # The run of least hash, which decides what is compared, lies in the middle.
    for k in range(1000):
        passage = [f"p{k}_{i}" for i in range(50)]
        words_ = suffixdedup.Words(column=pa.array([" ".join(passage)]), window=43)
        runs = suffixdedup.T.windows(words_.hashes, suffixdedup.ANCHOR)
        if runs.argmin() == 21 and runs.min() < 1 << 57:
            break

    def fresh(n):
        return [f"x{rng.getrandbits(40)}" for _ in range(n)]

    rows = []
    for i in range(3002):
        held = list(passage)
        if i >= 2:
            held[rng.choice([*range(2, 20), *range(30, 48)])] = f"e{i}"
        rows.append((i, " ".join(fresh(60) + held + fresh(60))))
    got = {r.doc_id: r.n_repeated for r in suffixdedup.repeated_passages(frame(spark, rows)).collect()}
    assert got[0] == got[1] == 50
    assert sum(got.values()) == 100


def brute_cover(rows, least):
    """Words of each text in windows that occur at several places."""
    seen = Counter()
    tokens = {i: words(t) for i, t in rows}
    for w in tokens.values():
        seen.update(tuple(w[j : j + least]) for j in range(len(w) - least + 1))
    return {
        i: {x for j in range(len(w) - least + 1) if seen[tuple(w[j : j + least])] > 1 for x in range(j, j + least)}
        for i, w in tokens.items()
    }


@pytest.mark.parametrize("least", [50, 20])
def test_passages_of_few_and_many_holders(spark, least):
    """Passages of 2 to 13 holders, whole, cut or with a word changed: compared or counted, the same words are found."""
    rng = random.Random(least)
    texts = []
    for k in range(2, 14):
        passage = [f"p{k}_{i}" for i in range(least + 25)]
        for h in range(k):
            held = list(passage)
            if h % 3 == 1:
                held[rng.randrange(len(held))] = f"e{k}_{h}"
            if h % 3 == 2:
                held = held[rng.randrange(30) :]
            around = [[f"x{rng.getrandbits(40)}" for _ in range(rng.randrange(40))] for _ in range(2)]
            texts.append(" ".join(around[0] + held + around[1]))
    # The same passage twice within a text, one word over and over, and a passage at both ends of the texts.
    twice = [f"t{i}" for i in range(least)]
    texts += [" ".join(twice + ["between"] + twice), "again " * (3 * least), " ".join(f"w{i}" for i in range(least))] + [
        " ".join(f"w{i}" for i in range(least))
    ]
    rows = list(enumerate(texts))
    want = brute_cover(rows, least)
    docs = frame(spark, rows).repartition(5)
    for row in suffixdedup.repeated_passages(docs, least).collect():
        assert {x for s in row.spans for x in range(s.start, s.end)} == want[row.doc_id], row.doc_id
        assert row.n_repeated == len(want[row.doc_id])


def test_passages_with_more_partitions_than_rows(spark):
    """Runs repeat, no passage does: nothing is compared with itself, however few rows a partition has."""
    shared = " ".join(f"s{i}" for i in range(49))
    rows = [(i, " ".join(f"a{i}_{k}" for k in range(40)) + f" {shared} " + " ".join(f"b{i}_{k}" for k in range(40))) for i in range(6)]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    try:
        found = suffixdedup.repeated_passages(frame(spark, rows))
        assert found.count() == 6 and found.filter("n_repeated > 0").count() == 0
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
