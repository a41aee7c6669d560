"""Periodic runs, hard negatives and SimHash links against plain Python."""

import hashlib
import random
import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
import xxhash
import zlib
from pyspark.sql import functions as F

from logquarry.llm import hardneg, periodic, queries, simhash, topk

SPACES = "[\x20\x09-\x0d]+"
# Extra columns with names that the operators use themselves.
DOCS = "doc_id long, text string, row long, code long, runs string, shard int, rows long, root long"
VECTORS = "vec_id long, label string, embedding array<double>, key long, shard int, terms string, place long"


def split(text):
    return [w for w in re.split(SPACES, text or "") if w]


def low(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def docs_of(spark, rows, parts=3):
    return spark.createDataFrame([(i, t, 7, 7, "x", 7, 7, 7) for i, t in rows], DOCS).repartition(parts)


# 11 periodic runs


def brute_runs(w):
    found = {}
    for q in range(1, len(w) // 4 + 1):
        i = 0
        while i + q < len(w):
            if w[i] != w[i + q]:
                i += 1
                continue
            start = i
            while i + q < len(w) and w[i] == w[i + q]:
                i += 1
            length = i - start + q
            if length >= max(6, 4 * q):
                found.setdefault((start, length), q)
    return sorted((s, n, q) for (s, n), q in found.items())


def brute_row(text):
    w = split(text)
    runs = brute_runs(w)
    runs.sort(key=lambda r: (r[0], r[2]))
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    best = None
    for r in runs:
        if best is None or r[1] * best[2] > best[1] * r[2]:
            best = r
    start, length, period = best or (None, None, None)
    return len(w), runs, start, length, period, " ".join(x for i, x in enumerate(w) if i not in gone)


def periodic_text(rng, long=False):
    out = []
    for _ in range(rng.randint(0, 5)):
        if rng.random() < 0.6:
            base = [rng.choice("abcdefgé") * rng.randint(1, 3) for _ in range(rng.randint(1, 700 if long else 40))]
            out += [base[i % len(base)] for i in range(rng.randint(1, 6 * len(base)))]
        else:
            out += [rng.choice("abcz") for _ in range(rng.randint(0, 60))]
    return "".join(w + rng.choice([" ", "\n", " \t"]) for w in out)


def test_runs_against_brute_force(spark):
    rng = random.Random(3)
    rows = [(i, periodic_text(rng)) for i in range(150)] + [(150 + i, periodic_text(rng, True)) for i in range(6)]
    rows += [(None, None), (900, ""), (901, " \t\n"), (902, "x x x x x"), (903, "x x x x x x"), (904, "x " * 30_000), (904, "x " * 30_000)]
    rows.append((905, "  a  " * 9))  # a no-break space belongs to its word
    got = periodic.periodic_runs(docs_of(spark, rows)).collect()
    found = sorted(((r.doc_id or -1), r.n_words, [tuple(x) for x in r.runs], r.start, r.length, r.period, r.collapsed) for r in got)
    assert found == sorted(((i or -1), *brute_row(t)) for i, t in rows)
    assert all(r.n_runs == len(r.runs) for r in got)
    assert all(r.exponent_milli == (1000 * r.length // r.period if r.n_runs else None) for r in got)


def test_nested_and_touching_runs(spark):
    """A run of runs: the block repeats, and its head is a run of its own."""
    block = ["a"] * 8 + ["b", "c"]
    w = block * 5
    runs = brute_runs(w)
    assert {q for _, _, q in runs} == {1, 10} and len(runs) == 6
    first = np.array([0, len(w)])
    assert [tuple(r) for r in periodic.runs_of(np.unique(w, return_inverse=True)[1], first).tolist()] == sorted(runs, key=lambda r: (r[0], r[2]))


def test_hash_collisions_are_told_apart(monkeypatch):
    class Same:
        def segments(self, data, starts, ends):
            return np.zeros(len(starts), np.uint64)

    monkeypatch.setattr(periodic.T, "hasher", lambda: Same())
    data = np.frombuffer(b"aa bb aa c", np.uint8)
    number = periodic.word_numbers(data, np.array([0, 3, 6, 9]), np.array([2, 5, 8, 10]))
    assert number[0] == number[2] and len(set(number.tolist())) == 3


def test_planted_texts(spark):
    rng = random.Random(4)
    rows = [(i, " ".join(rng.choice("abcdefgh") for _ in range(rng.choice([0, 1, 2, 7, 60])))) for i in range(120)] + [(None, "a b"), (500, None)]
    got = {(r.doc_id, tuple(split(r.text))) for r in queries.planted_runs(docs_of(spark, rows)).collect()}
    want, planted = set(), 0
    for i, text in rows:
        w = split(text)
        h = zlib.crc32(str(i).encode()) if i is not None else 1
        n, g = len(w), h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[j] if j < a else w[a + (j - a) % p] for j in range(n)]
            planted += 1
        want.add((i, tuple(w)))
    assert got == want and planted > 3


def test_runs_of_nothing_and_kept_columns(spark):
    none = docs_of(spark, [])
    assert periodic.periodic_runs(none).count() == 0
    row = periodic.periodic_runs(docs_of(spark, [(1, "b " * 9)]).withColumn("more", F.lit("m")), keep=("more", "row")).first()
    assert (row.more, row.row, row.collapsed) == ("m", 7, "b")


# 12 hard negatives


def whole(vector):
    return [int(np.floor(256 * float(x))) for x in vector]


def brute_negatives(rows, anchors, positives=5, negatives=10):
    def usable(row):
        return row[0] is not None and row[1] is not None and row[2] is not None and all(x is not None and np.isfinite(x) for x in row[2])

    good = [(i, label, whole(v)) for i, label, v in rows if usable((i, label, v))]
    out = []
    for a, label, v in [(i, x, whole(y)) for i, x, y in anchors if usable((i, x, y))]:
        scored = sorted((-sum(p * q for p, q in zip(v, w)), i, l) for i, l, w in good if i != a)
        for s, p, _ in [x for x in scored if x[2] == label][:positives]:
            fits = [(n, t) for t, n, l in scored if l != label and 30 * -s <= 100 * -t <= 90 * -s]
            out += [(a, p, k + 1, n, -s, -t) for k, (n, t) in enumerate(fits[:negatives])]
    return sorted(out)


def vectors_of(spark, rows):
    return spark.createDataFrame([(i, l, v, 7, 7, "x", 7) for i, l, v in rows], VECTORS).repartition(3)


def vector_rows(seed, n, dim, labels, spread):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(labels, dim))
    of = rng.integers(0, labels, n)
    points = (centres[of] + rng.normal(size=(n, dim)) * spread) * rng.choice([0.1, 1.0, 3.0], (n, 1))
    return [(i, str(int(l)), p.tolist()) for i, (l, p) in enumerate(zip((of + (rng.random(n) < 0.3)) % labels, points))]


@pytest.mark.parametrize("spread", [0.2, 2.0])
def test_hard_negatives_against_brute_force(spark, monkeypatch, spread):
    monkeypatch.setattr(hardneg, "SHARD_VECTORS", 60)
    monkeypatch.setattr(hardneg, "SEEDS", 90)
    monkeypatch.setattr(hardneg, "ANCHOR_BLOCK", 7)
    monkeypatch.setattr(hardneg, "TASK_ANCHORS", 20)
    rows = vector_rows(7, 500, 12, 4, spread)
    rows += [rows[30], rows[30], (30, "0", [1.0] * 12)]  # repeated rows, and one id with another vector
    rows += [(1000 + i, str(i % 3), rows[5][2]) for i in range(150)]  # one very common vector
    rows += [(None, "1", [1.0] * 12), (2000, None, [1.0] * 12), (2001, "1", None), (2002, "1", [1.0, None]), (2003, "1", [float("nan")] * 12)]
    rows += [(2004, "2", [0.0] * 12), (2005, "2", []), (2006, "3", [2.0] * 5), (2007, "3", [2.0] * 15), (2008, "2", [float("inf")] * 12)]
    frame = vectors_of(spark, rows)
    chosen = lambda i: i is None or i % 10 == 0 or i >= 2000
    anchors = [r for r in rows if chosen(r[0])]
    got = hardneg.mine(frame, vectors_of(spark, anchors)).collect()
    want = brute_negatives(rows, anchors)
    assert sorted(map(tuple, got)) == want and len(want) > 500


def test_coordinate_ranges_lose_nothing_and_prune():
    rng = np.random.default_rng(5)
    for trial in range(60):
        dim = int(rng.integers(1, 9))
        rows = rng.integers(-300, 300, (200, dim))
        rows[:5] = 0
        table = pa.table({"vec_id": pa.array(range(200)), "label": pa.array(["a"] * 200), "terms": pa.array(rows.tolist(), pa.list_(pa.int64()))})
        held = hardneg.Vectors(table)
        query = rng.integers(-300, 300, dim)
        scores = rows @ query
        for bound in (int(np.sort(scores)[-5]), 0, 1, -1, int(scores.max()) + 1, int(scores.min())):
            at = held.feasible(query, bound)
            assert set(np.flatnonzero(scores >= bound)) <= set(at.tolist())
    assert len(held.feasible(query, 10**9)) == 0


def test_hard_negatives_of_nothing(spark):
    none = vectors_of(spark, [])
    some = vectors_of(spark, [(0, "a", [1.0])])
    assert hardneg.mine(none, none).count() == 0
    assert hardneg.mine(some, some).count() == 0
    assert hardneg.mine(some, none).count() == 0


# 13 SimHash


def fingerprint(text):
    w = split(low(text))
    if not w:
        return 0
    parts = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))]
    hashes = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def classes(ids, codes, bits=2):
    """{place: smallest id reachable}, by comparing all."""
    parent = list(range(len(codes)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(codes)):
        for j in range(i):
            if bin(codes[i] ^ codes[j]).count("1") <= bits:
                parent[find(i)] = find(j)
    least = defaultdict(list)
    for i, name in enumerate(ids):
        if name is not None:
            least[find(i)].append(name)
    return [min(least[find(i)], default=None) for i in range(len(codes))]


def near_copies(seed=9):
    rng = random.Random(seed)
    texts = []
    for _ in range(12):
        w = [rng.choice("abcdefghijklmnop") * rng.randint(1, 3) for _ in range(rng.randint(150, 400))]
        texts.append(" ".join(w))
        for _ in range(12):
            v = list(w)
            for _ in range(rng.randint(0, 2)):
                v[rng.randrange(len(v))] = "Other"
            texts.append("\n".join(v))
    texts += [" ".join(rng.choice("abc") for _ in range(rng.randint(1, 5))) for _ in range(60)]
    texts += [None, "", " \t", "A", "a", "A b", "a B", "é ñ ü 漢字", texts[0], texts[0], "word " * 40_000]
    return [(1000 - i, t) for i, t in enumerate(texts)] + [(None, texts[20]), (None, "quite alone here"), (3, "repeated row"), (3, "repeated row")]


@pytest.mark.parametrize("small", [False, True])
def test_simhash_against_brute_force(spark, monkeypatch, small):
    if small:  # many shards, overfull ones, and small buckets
        monkeypatch.setattr(simhash, "SHARD_CODES", 20)
        monkeypatch.setattr(simhash, "TASK_CODES", 15)
        monkeypatch.setattr(simhash, "BUCKET", 8)
        monkeypatch.setattr(simhash, "HOT_SHARE", 10)
        monkeypatch.setattr(simhash, "PIECE", 100)
    rows = near_copies()
    got = simhash.near_duplicates(docs_of(spark, rows)).collect()
    codes = [fingerprint(t) for _, t in rows]
    roots = classes([i for i, _ in rows], codes)
    want = sorted((str(i), f"{c:016x}", str(r)) for (i, _), c, r in zip(rows, codes, roots))
    assert sorted((str(r.doc_id), r.fingerprint, str(r.component_id)) for r in got) == want
    assert len(set(roots)) < len(set(codes)) < len(rows)


def test_tree_lets_linked_codes_meet():
    rng = random.Random(6)
    for trial in range(8):
        base = [rng.getrandbits(64) for _ in range(rng.choice([1, 40]))]
        codes = set()
        for _ in range(1200):
            code = rng.choice(base)
            for _ in range(rng.randint(0, 5)):
                code ^= 1 << rng.randrange(64)
            codes.add(code)
        codes = np.array(sorted(codes), np.uint64)
        near = np.argwhere(np.triu(np.bitwise_count(codes[:, None] ^ codes[None, :]) <= 2, 1))
        tree = simhash.Tree(codes[::5], 16, 2)
        place, shard = tree.route(codes)
        homes = defaultdict(set)
        for p, s in zip(place.tolist(), shard.tolist()):
            homes[p].add(s)
        assert set(homes) == set(range(len(codes))) and tree.shards <= 16
        assert all(homes[a] & homes[b] for a, b in near.tolist())


def test_simhash_of_nothing_and_kept_columns(spark):
    assert simhash.near_duplicates(docs_of(spark, [])).count() == 0
    found = simhash.near_duplicates(docs_of(spark, [(4, "x y"), (2, "X  Y")]), keep=("code", "rows", "root")).collect()
    assert [(r.component_id, r.code, r.rows, r.root) for r in found] == [(2, 7, 7, 7)] * 2


def test_query_digests(spark):
    """op11's digests are those of the contract."""
    sf_dir = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in queries.planted_runs(queries.table(spark, sf_dir, "documents")).collect()}
    for r in queries.op11_periodic_runs(spark, sf_dir).collect():
        _, runs, start, length, period, collapsed = brute_row(texts[r.doc_id])
        said = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
        assert (r.n_runs, r.start, r.length, r.period) == (len(runs), start, length, period)
        assert r.runs_sha256 == hashlib.sha256(said.encode()).hexdigest()
        assert r.collapsed_sha256 == hashlib.sha256(collapsed.encode()).hexdigest()


# 7 exact top-k: repeated queries, and a threshold that rises


def test_repeated_queries_are_queries_each(spark):
    rows = [(50, [1.0, 0.0]), (50, [0.0, 1.0]), (1, [3.0, 1.0]), (2, [1.0, 3.0]), (2, [1.0, 3.0])]
    for order in (rows, rows[::-1]):
        vectors = spark.createDataFrame(order, "vec_id long, embedding array<double>").repartition(3)
        got = sorted(map(tuple, topk.search(vectors, vectors.filter("vec_id = 50")).collect()))
        assert got == sorted([
            (50, 1, 1, 3 * 65536), (50, 2, 2, 65536), (50, 3, 2, 65536),
            (50, 1, 2, 3 * 65536), (50, 2, 2, 3 * 65536), (50, 3, 1, 65536),
        ])


def test_rising_threshold_loses_nothing():
    rng = np.random.default_rng(8)
    for trial in range(200):
        n, dim, k = int(rng.integers(1, 300)), int(rng.integers(1, 12)), int(rng.integers(1, 7))
        weights = rng.integers(-50, 300, (n, dim)) * (rng.random((n, dim)) < 0.6)
        ids = rng.integers(0, 100, n)
        query = rng.integers(-20, 100, dim)
        scores = weights @ query
        usable = np.flatnonzero(ids != 7)
        best = usable[np.lexsort((ids[usable], -scores[usable]))[:k]]
        floor = int(np.sort(scores[usable])[-k:].min()) if len(usable) >= k else None
        for threshold in {None, floor, floor and floor - 40}:
            found, points = topk.Shard(ids, weights).top(query, 7, k, threshold)
            assert points.tolist() == scores[best].tolist() and found.tolist() == ids[best].tolist()
