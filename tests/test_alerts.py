import random
import re

import pytest
from pyspark.sql import functions as F

from conftest import NOW, ago
from logquarry.operators import alerts as ops
from logquarry.operators import dedup
from logquarry.operators.dedup import deduplicate
from logquarry.schema import ALERT, ANOMALY
from logquarry.sources.alerts import AlertTable

COLUMNS = "id string, log_id string, severity string, message string, details string, at string, acknowledged boolean"


@pytest.fixture
def make_alerts(spark):
    """Alerts from (id, severity, message, time text, acknowledged) rows."""

    def make(rows):
        full = [(i, "log-1", severity, message, '{"key":"value"}', at, acked) for i, severity, message, at, acked in rows]
        df = spark.createDataFrame(full, COLUMNS)
        return df.withColumn("created_at", F.col("at").cast("timestamp")).select(*ALERT.fieldNames())

    return make


FIVE = [
    ("a", "high", "m", ago(minutes=1), False),
    ("b", "high", "m", ago(minutes=2), True),
    ("c", "low", "m", ago(minutes=3), False),
    ("d", "critical", "m", ago(minutes=4), False),
    ("e", "medium", "m", ago(minutes=5), True),
]


def test_listing(make_alerts):
    alerts = make_alerts(FIVE)
    assert [r.id for r in ops.list_alerts(alerts).rows.collect()] == ["a", "b", "c", "d", "e"]
    assert ops.list_alerts(alerts, severity="high").total().first().total == 2
    assert ops.list_alerts(alerts, acknowledged=False).total().first().total == 3
    assert ops.list_alerts(alerts, "high", True).rows.first().id == "b"
    page = ops.list_alerts(alerts, limit=2, offset=1)
    assert [r.id for r in page.rows.collect()] == ["b", "c"] and page.total().first().total == 5
    assert ops.by_id(alerts, "d").count() == 1 and ops.by_id(alerts, "x").count() == 0
    assert [r.id for r in ops.recent_alerts(alerts, 0.05, 100, NOW).collect()] == ["a", "b", "c"]
    assert ops.recent_alerts(alerts, 1, 3, NOW).count() == 3


def test_counts(make_alerts):
    alerts = make_alerts(FIVE)
    rows = {(r.section, r.name): r["count"] for r in ops.alert_stats(alerts).collect()}
    assert rows == {
        ("total", "all"): 5,
        ("unacknowledged", "all"): 3,
        ("severity", "high"): 2,
        ("severity", "low"): 1,
        ("severity", "critical"): 1,
        ("severity", "medium"): 1,
    }
    assert ops.count_unacknowledged(alerts).first()["count"] == 3
    assert ops.count_unacknowledged(alerts, "high").first()["count"] == 1
    assert tuple(ops.latest_counts(alerts, 3).first()) == (3, 0)
    assert tuple(ops.latest_counts(alerts).first()) == (5, 1)


@pytest.mark.parametrize(
    ("row", "pattern", "found"),
    [
        (("high", "High error_rate detected", ago(), False), "error_rate", True),
        (("high", "High ERROR_rate detected", ago(), False), "error_RATE", True),
        (("high", "High error_rate detected", ago(), True), "error_rate", False),
        (("low", "High error_rate detected", ago(), False), "error_rate", False),
        (("high", "High error_rate detected", ago(hours=2), False), "error_rate", False),
        (("high", "Pattern with 100% match_rate", ago(), False), "100%", True),
        (("high", "Pattern with 1000 match", ago(), False), "100%", False),
        (("high", "a\\b", ago(), False), "a\\b", True),
    ],
)
def test_similar(make_alerts, row, pattern, found):
    severity, message, at, acked = row
    alerts = make_alerts([("x", severity, message, at, acked)])
    assert ops.similar_alert(alerts, pattern, "high", 1, NOW).count() == int(found)


def test_details(make_alerts, spark):
    alerts = make_alerts(FIVE[:3]).withColumn(
        "details", F.when(F.col("id") == "a", F.col("details")).when(F.col("id") == "b", "").otherwise("{x")
    )
    rows = {r.id: r.d for r in ops.with_details(alerts).select("id", F.col("details").isNull().alias("d")).collect()}
    assert rows == {"a": False, "b": True, "c": True}


def test_orphans(make_alerts, make_logs):
    alerts = make_alerts(FIVE[:2]).withColumn("log_id", F.when(F.col("id") == "a", "system").otherwise("gone"))
    logs = make_logs([("log-1", ago(), "info", "s", "m")])
    assert [r.id for r in ops.orphans(alerts, logs).collect()] == ["b"]


def test_alert_table(spark, tmp_path):
    table = AlertTable(spark, str(tmp_path))
    rows = [("log-1", "t", "high", "Test alert", '{"key":"value"}'), ("log-2", "t", "low", "Other", "{}")]
    anomalies = spark.createDataFrame(rows, ANOMALY)
    created = table.create(anomalies, ago(days=40))
    assert created.count() == 2
    assert table.append(created).count() == 0
    stored = {r.log_id: r for r in table.read().collect()}
    assert stored["log-1"].details == '{"key":"value"}' and stored["log-2"].details is None
    assert not stored["log-1"].acknowledged
    with pytest.raises(ValueError, match="invalid severity"):
        table.create(anomalies.withColumn("severity", F.lit("invalid")))
    ids = spark.createDataFrame([(stored["log-1"].id,), ("nonexistent",)], "id string")
    for _ in range(2):
        assert {r.id: r.found for r in table.acknowledge(ids).collect()} == {stored["log-1"].id: True, "nonexistent": False}
    assert {r.log_id: r.acknowledged for r in table.read().collect()} == {"log-1": True, "log-2": False}
    with pytest.raises(ValueError, match="positive"):
        table.delete_old(0)
    assert table.delete_old(50, NOW) == 0
    assert table.delete_old(30, NOW) == 1
    assert [r.log_id for r in table.read().collect()] == ["log-2"]
    table.create(spark.createDataFrame([("log-3", "t", "low", "Third", None)], ANOMALY), NOW)
    table.acknowledge(table.read().filter("log_id = 'log-3'"))
    assert table.delete_acknowledged() == 1
    assert [r.log_id for r in table.read().collect()] == ["log-2"]


def one_by_one(anomalies, stored):
    """The rule itself: take anomalies in order, compare with everything kept so far."""
    table = [(severity, message.lower()) for severity, message in stored]
    kept = []
    for log_id, severity, message in anomalies:
        pattern = message[:50].lower()
        if not any(s == severity and pattern in m for s, m in table):
            table.append((severity, message.lower()))
            kept.append(log_id)
    return kept


@pytest.mark.parametrize("seed", range(4))
def test_dedup_matches_taking_anomalies_one_by_one(spark, make_alerts, seed):
    rng = random.Random(seed)

    def text():
        return "".join(rng.choices("aAbB_%", k=rng.choice([0, 1, 2, 3, 4, 6])))

    long = "x" * 48
    messages = [text() for _ in range(40)] + [long + text() for _ in range(20)] + [text() + long + text() for _ in range(20)]
    rng.shuffle(messages)
    anomalies = [(f"{i:03d}", rng.choice(["low", "high"]), m) for i, m in enumerate(messages)]
    stored = [("low", text() + "zz" + text()) for _ in range(3)]
    df = spark.createDataFrame([(i, "t", s, m, None, 0) for i, s, m in anomalies], "log_id string, anomaly_type string, severity string, message string, details string, detector_seq int")
    open_alerts = make_alerts([(str(i), s, m, ago(), False) for i, (s, m) in enumerate(stored)])
    kept = sorted(r.log_id for r in deduplicate(df.repartition(3), open_alerts).collect())
    assert kept == one_by_one(anomalies, stored)


ANOMALIES = "log_id string, anomaly_type string, severity string, message string, details string, detector_seq int"


def anomalies_of(spark, rows):
    return spark.createDataFrame([(i, "t", s, m, None, 0) for i, s, m in rows], ANOMALIES).repartition(3)


@pytest.mark.parametrize("seed", range(2))
def test_outcomes_account_for_every_anomaly(spark, make_alerts, seed):
    rng = random.Random(100 + seed)
    text = lambda: "".join(rng.choices("ab", k=rng.randint(0, 5)))
    rows = [(f"{i:03d}", rng.choice(["low", "high"]), text()) for i in range(80)]
    stored = [("low", "zz" + text() + "zz")]
    open_alerts = make_alerts([(str(i), s, m, ago(), False) for i, (s, m) in enumerate(stored)])
    found = {r.log_id: r.outcome for r in dedup.outcomes(anomalies_of(spark, rows), open_alerts).collect()}
    kept = one_by_one(rows, stored)
    assert len(found) == 80 and sorted(i for i, outcome in found.items() if outcome == "alert") == kept
    for i, severity, message in rows:
        opened = any(s == severity and message in m for s, m in stored)
        before = {(s, m) for j, s, m in rows if j < i}
        if i not in kept:
            assert opened == (found[i] == "open_alert"), (i, message)
            if found[i] == "same_pattern":
                assert (severity, message) in before
            if found[i] == "earlier_anomaly":
                assert any(j in kept and j < i and s == severity and message in m for j, s, m in rows)


def test_outcomes_of_nulls_and_of_nothing(spark, make_alerts):
    none = make_alerts([])
    assert dedup.outcomes(anomalies_of(spark, []), none).count() == 0
    rows = [("1", None, "m"), ("2", None, "m"), ("3", "low", None), ("4", "low", "")]
    found = {r.log_id: r.outcome for r in dedup.outcomes(anomalies_of(spark, rows), none).collect()}
    assert found == {"1": "alert", "2": "same_pattern", "3": "alert", "4": "alert"}


def test_anchors_are_rare(spark):
    """A beginning that all patterns share anchors none of them, and a short pattern shortens no other."""
    preamble = "ml detected unusual log pattern: "
    rows = [("medium", (preamble + f"{i:05d} of the same")[:50]) for i in range(400)] + [("medium", "x"), ("medium", "")]
    patterns = spark.createDataFrame(rows, "severity string, pattern string")
    anchors = dedup._anchored(patterns).collect()
    assert len(anchors) == 401 and {r.k for r in anchors} == {1, 32}
    assert max(sum(1 for _ in g) for g in by_gram(anchors)) == 1
    texts = patterns.select("severity", F.concat("pattern", F.lit(" and so on")).alias("text"))
    found = dedup._contained(texts, patterns)
    assert sorted(r.pattern for r in found.collect()) == sorted(p for _, p in rows)


def by_gram(anchors):
    groups = {}
    for r in anchors:
        groups.setdefault((r.k, r.gram), []).append(r)
    return groups.values()


def test_key_behind_the_preamble(spark, make_alerts):
    preamble = "ML detected unusual log pattern: "
    same = "a common beginning, "
    rows = [(str(i), "medium", preamble + same + f"case {i // 2}") for i in range(6)] + [("7", "medium", "case 1")]
    none = make_alerts([])
    usual = deduplicate(anomalies_of(spark, rows), none).collect()
    assert sorted(r.log_id for r in usual) == ["0", "7"]
    keyed = deduplicate(anomalies_of(spark, rows), none, dedup_key=dedup.after(preamble)).collect()
    assert sorted(r.log_id for r in keyed) == ["0", "2", "4"]
    held = make_alerts([("al", "medium", preamble + same + "CASE 1", ago(), False)])
    assert sorted(r.log_id for r in deduplicate(anomalies_of(spark, rows), held, dedup_key=dedup.after(preamble)).collect()) == ["0", "4"]


def test_written_tables_are_not_broadcast(spark):
    """A small file may hold many positions of texts: neither side of the join by part is broadcast."""
    rows = [("low", f"{i:04d} is a message") for i in range(50)]
    texts = dedup.materialise(spark.createDataFrame(rows, "severity string, text string"))
    patterns = dedup.materialise(texts.select("severity", F.substr("text", F.lit(2)).alias("pattern")))
    found = dedup._contained(texts, patterns)
    assert not re.search(r"BroadcastHashJoin[^\n]*gram", found._jdf.queryExecution().executedPlan().toString())
    assert found.count() == 50


def test_positions_carry_no_texts(spark):
    """A position of a text is shuffled as two numbers; the whole text is compared, however long the pattern."""
    long = "".join(chr(97 + i * i % 23) for i in range(130))
    texts = spark.createDataFrame([("low", "x" * 80 + long + "y"), ("low", long[:-1])], "severity string, text string")
    patterns = spark.createDataFrame([("low", long), ("low", long + "z"), ("high", long)], "severity string, pattern string")
    assert [tuple(r) for r in dedup._contained(texts, patterns).collect()] == [("low", long)]
    parts = dedup._parts_of(texts.withColumn("text_id", F.lit(1)), patterns)
    assert parts.columns == ["text_id", "gram"] and parts.count() == 211 - 31 + 129 - 31


def test_ids_of_first_anomalies_are_in_order(spark):
    """Ids stand for the order, nulls first, also where many anomalies share a log and a long beginning."""
    rng = random.Random(7)
    rows = [(rng.choice([None, "a", "b"]), "t", "low", f"{'m' * rng.choice([1, 60])}{i}", None, rng.choice([None, 0, 1])) for i in range(300)]
    firsts = dedup.first_per_pattern(spark.createDataFrame(rows, ANOMALIES).repartition(5), dedup.ORDER, lambda message: message)
    found = [r.row for r in dedup._in_order(firsts, dedup.ORDER).orderBy("id").collect()]
    place = lambda r: (r.detector_seq is not None, r.detector_seq or 0, r.log_id or "", r.message)
    assert len(found) == 300 and found == sorted(found, key=place)


def test_pairs_are_shuffled_only_with_earlier_texts(spark):
    """Pairs are resolved by ids alone: later texts are left out by the join by part, no join fetches the order."""
    rows = [(i, "low", f"{i:02d} is a message", f"{'' if i % 2 else 'so '}{i - i % 2:02d} is a message") for i in range(40)]
    firsts = dedup.materialise(spark.createDataFrame(rows, "id long, severity string, pattern string, message string"))
    blocks = dedup._blocks(firsts)
    assert blocks.isEmpty()
    back = dedup._blocks(firsts.withColumn("id", 39 - F.col("id")))
    assert sorted(tuple(r) for r in back.collect()) == [(i, i - 1) for i in range(1, 40, 2)]
    plan = blocks._jdf.queryExecution().optimizedPlan().toString()
    joins = [line for line in plan.splitlines() if "Join Inner" in line and "gram#" in line]
    assert any(re.search(r"text_id#\d+L < pattern_id#\d+L", line) for line in joins), plan


def test_first_anomalies_hold_each_column_once(spark):
    rows = [("2", "t", "low", "M", "x", 0), ("1", "u", "low", "m", "x", 0), ("1", "t", "low", "m", "y", 0), ("0", "t", None, None, None, 1)]
    firsts = dedup.first_per_pattern(spark.createDataFrame(rows, ANOMALIES), ("log_id", "message"))
    assert sorted((r.pattern or "", tuple(r.row)) for r in firsts.collect()) == [("", rows[3]), ("m", rows[1])]
    held = firsts._jdf.queryExecution().optimizedPlan().toString()
    assert "min_by" not in held and held.count("message, message") == 1, held


def test_few_ids_are_broadcast(spark, monkeypatch):
    ids = dedup.materialise(spark.range(20))
    joined = lambda: spark.range(30).join(dedup._counted(ids), "id", "left_anti")
    assert "BroadcastHashJoin" in joined()._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(dedup, "FEW_IDS", 19)
    assert "SortMergeJoin" in joined()._jdf.queryExecution().executedPlan().toString()
    assert joined().count() == 10
