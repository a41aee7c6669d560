import random
import re

import pytest
from pyspark.sql import functions as F

from conftest import NOW, ago
from logquarry.functions import text as text_fns
from logquarry.functions.text import words
from logquarry.operators import features, search, stats, terms
from logquarry.plans import queries

ROWS = [
    ("1", "2026-03-01 10:00:00", "error", "api-server", "Connection timeout to database"),
    ("2", "2026-03-01 11:00:00", "info", "auth-service", "User logged in successfully"),
    ("3", "2026-03-01 12:00:00", "debug", "cache-service", "Cache miss for key user:123"),
    ("4", "2026-03-01 13:00:00", "warn", "api-server", "High memory usage detected"),
    ("5", "2026-03-01 14:00:00", "info", "api-server", "Database connection restored"),
]


@pytest.mark.parametrize(
    ("arguments", "total"),
    [
        ({}, 5),
        ({"level": "info"}, 2),
        ({"level": "INFO"}, 0),
        ({"source": "api-server"}, 3),
        ({"start": "2026-03-01T12:00:00.000Z"}, 3),
        ({"end": "2026-03-01T12:00:00.000Z"}, 3),
        ({"start": "2026-03-01T11:00:00Z", "end": "2026-03-01T13:00:00Z"}, 3),
        ({"q": "database"}, 2),
        ({"q": "database", "level": "error"}, 1),
        ({"q": "nonexistentterm"}, 0),
        ({"q": 'timeout "to"'}, 1),
        ({"q": "OR AND NOT"}, 0),
        ({"q": "data*"}, 0),
        ({"q": "***"}, 0),
        ({"q": ""}, 5),
        ({"q": "api server"}, 3),
        ({"q": "database api"}, 0),
        ({"q": "user 123"}, 1),
        ({"q": "onnection"}, 0),
    ],
)
def test_search_totals(make_logs, arguments, total):
    page = search.search(make_logs(ROWS), **arguments)
    assert page.total().first().total == total
    assert page.rows.count() == total


def test_search_pages(make_logs):
    logs = make_logs(ROWS)
    assert [r.id for r in search.search(logs).rows.collect()] == ["5", "4", "3", "2", "1"]
    page = search.search(logs, limit=2)
    assert page.rows.count() == 2 and page.total().first().total == 5
    assert [r.id for r in search.search(logs, offset=2).rows.collect()] == ["3", "2", "1"]
    assert search.search(logs, limit=0).rows.count() == 5


@pytest.mark.parametrize(
    ("arguments", "page"),
    [
        ((None, None), (50, 0)),
        ((0, 0), (50, 0)),
        (("12abc", "7"), (12, 7)),
        (("abc", "x"), (50, 0)),
        ((-5, -5), (1, 0)),
        ((5000, 10), (1000, 10)),
    ],
)
def test_page_arguments(arguments, page):
    assert search.page_arguments(*arguments) == page


@pytest.mark.parametrize("skip", [0, 1, 39, 40, 41, 119, 120, 150, 200])
def test_deep_pages(make_logs, skip):
    """Rows crowd in one second, one hour and several months."""
    times = ["2026-02-01 00:00:05"] * 40 + [f"2026-02-01 00:{m:02d}:00" for m in range(40)] + [f"2025-{m:02d}-28 23:59:59.5" for m in range(1, 13)] * 4
    logs = make_logs([(f"{i:03d}", t, "info", "s", "m") for i, t in enumerate(times)])
    ordered = [r.id for r in logs.orderBy(F.desc("timestamp"), "id").collect()]
    rest, left = search.skip_ahead(logs, skip)
    assert left <= 40 or skip >= len(ordered)
    page = rest.orderBy(F.desc("timestamp"), "id").offset(left).limit(7)
    assert [r.id for r in page.collect()] == ordered[skip : skip + 7]


def test_phrase_folds_case_and_accents(make_logs):
    logs = make_logs([("1", ago(), "info", "s", "Le CAFÉ́ est fermé_ici"), ("2", ago(), "info", "s", "cafetière")])
    for phrase in ("cafe est", "Café EST", "ferme ici"):
        assert [r.id for r in search.phrase_filter(logs, phrase).collect()] == ["1"]


def test_index_and_stored_tokens_find_the_same_as_the_scan(make_logs, spark):
    rng = random.Random(7)
    vocabulary = ["la", "le", "elle", "là", "x-y", "user:1", "42"]
    rows = [(str(i), ago(minutes=i), "info", rng.choice(["la le", "svc"]), " ".join(rng.choices(vocabulary, k=9))) for i in range(80)]
    logs = make_logs(rows)
    index = terms.term_index(logs).cache()
    for phrase in ("la la", "la le", "elle la elle", "x", "user 1 42", "la", "nope", "la la la"):
        scan = {r.id for r in search.phrase_filter(logs, phrase).collect()}
        found = {r.id for r in terms.indexed_phrase_search(logs, index, phrase).collect()}
        assert found == scan, phrase
    assert terms.phrase_hits(index, "!").count() == 0


def test_reads(make_logs):
    logs = make_logs([(f"log-{i}", ago(minutes=i), "info", "app", "m") for i in range(10)])
    assert [r.id for r in search.fetch_since(logs, "log-4", 10).collect()] == [f"log-{i}" for i in range(5, 10)]
    assert search.fetch_since(logs, None, 5).count() == 5
    assert [r.id for r in search.recent(logs, 2).collect()] == ["log-0", "log-1"]
    assert [r.id for r in search.fetch_recent(logs, hours=0.05, as_of=NOW).collect()] == ["log-3", "log-2", "log-1", "log-0"]
    assert search.by_id(logs, "log-3").count() == 1
    assert search.by_id(logs, "none").count() == 0


def test_counts(make_logs):
    levels = ["info", "info", "error", "warn", "info", "error"]
    logs = make_logs([(str(i), ago(minutes=i), level, "app", "m") for i, level in enumerate(levels)])
    assert {r.level: r["count"] for r in stats.count_by_level(logs, ago(hours=1)).collect()} == {"info": 3, "error": 2, "warn": 1}
    assert stats.error_count(logs, ago(minutes=3)).first()["count"] == 1
    assert stats.total_count(logs).first()["count"] == 6


def test_log_stats(make_logs):
    rows = [("svc-a", "error"), ("svc-a", "error"), ("svc-a", "info"), ("svc-b", "warn"), ("svc-c", "debug")]
    logs = make_logs([(str(i), ago(hours=i), level, source, "m") for i, (source, level) in enumerate(rows)])
    record = stats.stats_record(stats.log_stats(logs, 24, NOW)).first()
    assert record.total == 5
    assert record.byLevel == {"error": 2, "info": 1, "warn": 1, "debug": 1}
    assert record.bySource == {"svc-a": 3, "svc-b": 1, "svc-c": 1}
    assert stats.stats_record(stats.log_stats(logs, 1, NOW)).first().total == 2
    assert stats.stats_record(stats.log_stats(logs, 3, "2026-03-01 10:30:00")).first().total == 3
    with pytest.raises(ValueError):
        stats.log_stats(logs, 0, NOW)
    many = make_logs([(str(i), ago(), "info", f"s{i:03d}", "m") for i in range(120)])
    assert len(stats.stats_record(stats.log_stats(many, 24, NOW)).first().bySource) == 100


def test_volume_stats(make_logs):
    one = make_logs([("1", ago(), "info", "s", "m")])
    assert tuple(stats.volume_stats(one, 24, NOW).first()) == (1.0, 0.0, 1, 1)
    assert tuple(stats.volume_stats(one.limit(0), 24, NOW).first()) == (0.0, 0.0, 0, 0)
    two = make_logs([("1", ago(), "info", "s", "m"), ("2", ago(hours=5), "info", "s", "m"), ("3", ago(hours=5), "info", "s", "m")])
    mean, std, top, low = stats.volume_stats(two, 24, NOW).first()
    assert (mean, round(std, 6), top, low) == (1.5, 0.707107, 2, 1)


def test_dashboard_numbers(make_logs):
    logs = make_logs([(str(i), ago(), "error" if i < 1 else "info", "s", "m") for i in range(8)])
    assert [(r.level, r["count"]) for r in stats.level_cards(logs).orderBy("position").collect()] == [
        ("debug", 0),
        ("info", 7),
        ("warn", 0),
        ("error", 1),
    ]
    assert stats.error_rate_pct(logs).first().error_rate_pct == 13
    assert stats.error_rate_pct(logs.limit(0)).first().error_rate_pct == 0
    bars = stats.scaled_series(stats.level_cards(logs)).orderBy("position").collect()
    assert [round(r.scaled, 4) for r in bars] == [0, 1, 0, 0.1429]
    assert [round(r.bar_height, 2) for r in bars] == [12, 100, 12, 14.29]


def test_features(make_logs):
    logs = make_logs(
        [
            ("a", "2026-03-01 09:00:00", "ERROR", "s", "Request FAILED  slow failed"),
            ("b", "2026-03-01 18:00:00", "odd", "s", " \t "),
            ("c", None, "debug", "s", "\U0001f600 x\x1cx"),
        ]
    )
    rows = {r.log_id: tuple(r)[2:] for r in features.features(logs).collect()}
    assert rows["a"] == (3, 27, 9, True, 4, 3, True, True)
    assert rows["b"] == (1, 3, 18, False, 0, 0, False, False)
    assert rows["c"] == (0, 5, 12, True, 3, 2, False, False)
    assert features.features(logs, include_text=False).columns[2:] == list(features.STATISTICAL)
    vector = features.feature_vectors(logs).filter("log_id = 'a'").first().vector
    assert vector == [3, 27, 9, 1, 4, 3, 1, 1]


def test_word_split_matches_python(spark):
    texts = ["".join(random.Random(i).choices("ab \t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\xa0     　​À", k=30)) for i in range(50)]
    df = spark.createDataFrame([(t, t.lower().split()) for t in texts], "t string, want array<string>")
    assert df.filter(words(F.lower("t")) != F.col("want")).count() == 0


def test_plain_texts_are_folded_without_a_table(spark):
    """Postings are sorted by term first, and only texts with characters of several bytes lose diacritics."""
    texts = ["", "Plain ABC", "\u00c9T\u00c9 Plain", "e\u0301", "\u0130x", "\u212aelvin", None]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    folded = [r.f for r in rows.select(text_fns.fold(F.col("t")).alias("f")).collect()]
    whole = F.translate(F.lower("t"), text_fns._ACCENTED, text_fns._PLAIN)
    assert folded == [r.f for r in rows.select(whole.alias("f")).collect()]
    assert folded[:4] == ["", "plain abc", "ete plain", "e"]
    plan = queries.all_queries()["term_index"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"Sort \[term#\d+ ASC", plan)
