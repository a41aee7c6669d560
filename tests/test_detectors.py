import json
from datetime import timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import NOW, ago
from logquarry.operators.detectors import forest, registry, rules
from logquarry.functions.timerange import with_log_date
from logquarry.operators.detectors.base import Detector
from logquarry.operators.detectors.cells import count_cells
from logquarry.operators.quantile import exact_quantile
from logquarry.schema import ALERT, ANOMALY
from logquarry.session import materialise


def details(df):
    return json.loads(df.first().details)


def test_error_burst(mixed_logs, error_logs):
    assert rules.error_burst(error_logs.limit(0), 5.0, as_of=NOW).count() == 0
    assert rules.error_burst(mixed_logs, 100.0, as_of=NOW).count() == 0
    found = rules.error_burst(error_logs, 1.0, 5, NOW)
    row = found.first()
    assert (row.log_id, row.anomaly_type, row.severity) == ("system", "error_burst", "high")
    assert row.message == "High error rate detected: 4.00 errors/minute (20 errors in 5 minutes)"
    assert details(found) == {
        "error_count": 20,
        "total_count": 20,
        "errors_per_minute": 4.0,
        "threshold": 1.0,
        "window_minutes": 5,
    }
    assert rules.error_burst(error_logs, 4.0, 5, NOW).count() == 0


def test_volume_spike(make_logs, mixed_logs):
    assert rules.volume_spike(mixed_logs.limit(5), as_of=NOW).count() == 0
    assert rules.volume_spike(mixed_logs, 10.0, as_of=NOW).count() == 0
    rows = [(f"{h}-{i}", ago(hours=h), "info", "s", "m") for h in range(12) for i in range(40 if h == 0 else 2)]
    logs = make_logs([*rows, ("odd", None, "info", "s", "m")])
    counts = [40] + [2] * 11
    z = (40 - np.mean(counts)) / np.std(counts, ddof=1)
    found = details(rules.volume_spike(logs, 3.0, as_of=NOW))
    assert found["current_count"] == 40
    assert found["z_score"] == pytest.approx(z)
    assert rules.volume_spike(logs, 3.0, baseline_hours=3, as_of=NOW).count() == 0
    live = rules.VolumeSpike(3.0, history=lambda: logs)
    assert live.baseline_hours == 24 and live.detect(logs.limit(1), NOW).count() == 1
    even = make_logs([(f"{h}-{i}", ago(hours=h), "info", "s", "m") for h in range(5) for i in range(3)])
    assert rules.volume_spike(even, -5.0, as_of=NOW).count() == 0


def test_source_anomaly(make_logs):
    def logs(dominant, other):
        names = ["dominant-source"] * dominant + ["other"] * other
        return make_logs([(str(i), ago(), "info", name, "m") for i, name in enumerate(names)])

    found = rules.source_anomaly(logs(90, 10), 5)
    assert found.first().severity == "low"
    assert found.first().message == "Unusual source distribution: 'dominant-source' accounts for 90.0% of logs"
    assert details(found) == {"source": "dominant-source", "count": 90, "ratio": 0.9, "total_logs": 100}
    assert rules.source_anomaly(logs(80, 20), 5).count() == 0
    assert rules.source_anomaly(logs(10, 0), 100).count() == 0
    assert rules.source_anomaly(logs(0, 0)).count() == 0


def test_error_rate_rule(spark, make_logs):
    def errors(n):
        return make_logs([(str(i), ago(seconds=i), "error", "s", "m") for i in range(n)])

    found = rules.error_rate_rule(errors(60), as_of=NOW)
    assert details(found)["errorsPerMinute"] == 12.0 and details(found)["type"] == "error_rate"
    assert rules.error_rate_rule(errors(40), as_of=NOW).count() == 0
    assert rules.error_rate_rule(errors(60), window_minutes=0, as_of=NOW).count() == 0
    none = spark.createDataFrame([], ALERT)
    made = rules.error_rate_alerts(errors(60), none, as_of=NOW)
    assert made.count() == 1
    assert rules.error_rate_alerts(errors(59), made, as_of=NOW).count() == 0
    later = NOW + timedelta(hours=2)
    assert rules.error_rate_alerts(errors(59), made, window_minutes=130, threshold=0.1, as_of=later).count() == 1


class Fixed(Detector):
    def __init__(self, rows):
        super().__init__("fixed")
        self.rows = rows

    def detect(self, logs, as_of=None):
        return logs.sparkSession.createDataFrame(self.rows, ANOMALY)


class Failing(Detector):
    def detect(self, logs, as_of=None):
        return logs.select(F.raise_error(F.lit("broken")).alias("log_id"), *[F.lit("x").alias(n) for n in ANOMALY.fieldNames()[1:]])


def test_failing_detector_does_not_stop_others(spark, mixed_logs):
    off = rules.SourceAnomaly()
    off.enabled = False
    row = ("log-1", "mock", "medium", "Mock anomaly detected", None)
    found = registry.run_detectors(mixed_logs, [Failing("failing"), off, Fixed([row])], NOW)
    assert [tuple(r)[:5] for r in found.anomalies.collect()] == [row]
    stats = {r.name: r for r in registry.detector_stats(found.runs_frame(spark)).collect()}
    assert set(stats) == {"failing", "fixed"}
    assert (stats["failing"].alerts_created, stats["fixed"].alerts_created) == (0, 1)
    errors = {r.name: r.error for r in found.runs_frame(spark).collect()}
    assert "broken" in errors["failing"] and errors["fixed"] is None


def test_rules_share_one_scan(spark, mixed_logs, tmp_path, monkeypatch):
    """The logs are read once for all rules and the number of logs; history is another source."""
    mixed_logs.write.parquet(str(tmp_path / "given"))
    mixed_logs.write.parquet(str(tmp_path / "stored"))
    logs, stored = (spark.read.parquet(str(tmp_path / name)) for name in ("given", "stored"))
    plans = []

    def recorded(frame):
        plans.append(frame._jdf.queryExecution().executedPlan().toString())
        return materialise(frame)

    monkeypatch.setattr(registry, "materialise", recorded)
    history = lambda: stored
    detectors = [
        rules.ErrorBurst(1.0, 30),
        rules.ErrorBurst(0.1, 50),
        rules.VolumeSpike(0.1),
        rules.SourceAnomaly(5),
        rules.VolumeSpike(0.1, 5, history),
        rules.ErrorBurst(0.1, 20, history),
    ]
    found, processed = registry.analyze(logs, detectors, as_of=NOW)
    assert processed == 50
    for name in ("given", "stored"):
        assert [plan.count("FileScan") for plan in plans if f"{tmp_path}/{name}" in plan] == [1]
    alone = [d.detect(logs, NOW).select(*ANOMALY.fieldNames()).collect() for d in detectors]
    want = sorted((seq, *row) for seq, rows_ in enumerate(alone) for row in rows_)
    assert sorted((r.detector_seq, *list(r)[:-1]) for r in found.anomalies.collect()) == want and want
    assert [r[3] for r in found.runs] == [len(rows_) for rows_ in alone]


def test_days_outside_the_windows_are_not_read(spark, mixed_logs, tmp_path):
    with_log_date(mixed_logs).write.partitionBy("log_date").parquet(str(tmp_path / "dated"))
    logs = spark.read.parquet(str(tmp_path / "dated"))
    for frame in (rules.error_burst(logs, as_of=NOW), count_cells(logs, [d.interval(NOW) for d in (rules.ErrorBurst(), rules.VolumeSpike(baseline_hours=3))])):
        plan = frame._jdf.queryExecution().executedPlan().toString()
        assert "log_date" in plan.split("PartitionFilters: [")[1].split("]")[0]


def test_cells_of_nothing_and_of_null_times(spark, make_logs):
    none = make_logs([])
    found = registry.run_detectors(none, [rules.ErrorBurst(), rules.VolumeSpike(), rules.SourceAnomaly()], NOW)
    assert (found.anomalies.count(), found.logs) == (0, 0) and not any(r[4] for r in found.runs)
    timeless = make_logs([(str(i), None, "error", "s", "m") for i in range(20)])
    found = registry.run_detectors(timeless, [rules.ErrorBurst(), rules.VolumeSpike(), rules.SourceAnomaly()], NOW)
    assert [r.anomaly_type for r in found.anomalies.collect()] == ["source_anomaly"] and found.logs == 20


def test_failing_history_stops_its_detectors_only(mixed_logs):
    def broken():
        raise OSError("gone")

    found = registry.run_detectors(mixed_logs, [rules.ErrorBurst(history=broken), rules.SourceAnomaly(5)], NOW)
    assert [bool(r[4]) for r in found.runs] == [True, False]


def test_analyze_chooses_detectors(mixed_logs):
    rows = [("system", "a", "low", "m", None)]
    found, processed = registry.analyze(mixed_logs, [Fixed(rows)], include_statistical=False, as_of=NOW)
    assert (found.anomalies.count(), processed) == (0, 50)
    found, _ = registry.analyze(mixed_logs, [Fixed(rows)], ml=Fixed(rows), as_of=NOW)
    assert found.anomalies.count() == 1


def test_alerts_from_findings_skip_unknown_severities(spark, mixed_logs):
    rows = [("1", "a", "urgent", "same text", None), ("2", "a", "low", "same text", "{}"), ("3", "a", "low", "same text again", None)]
    found = registry.run_detectors(mixed_logs, [Fixed(rows)], NOW)
    made = registry.alerts_from(found, spark.createDataFrame([], ALERT), as_of=NOW)
    assert sorted((r.log_id, r.details, r.acknowledged) for r in made.collect()) == [("2", None, False), ("3", None, False)]


# --- isolation forest ---------------------------------------------------------------------------


@pytest.fixture(scope="module")
def training_logs(spark):
    return spark.range(600).select(
        F.concat(F.lit("t-"), "id").alias("id"),
        (F.lit("2026-03-01 00:00:00").cast("timestamp") + F.make_dt_interval(mins=F.col("id").cast("int"))).alias("timestamp"),
        F.when(F.col("id") % 4 == 0, "error").otherwise("info").alias("level"),
        F.when(F.col("id") % 3 == 0, "app").otherwise("api").alias("source"),
        F.concat(F.lit("Test log message with some content "), F.repeat(F.lit("ab "), (F.col("id") % 7).cast("int"))).alias("message"),
        F.lit(None).cast("string").alias("raw"),
    )


@pytest.fixture(scope="module")
def model(training_logs):
    return forest.train(training_logs, contamination=0.1)


def test_training_needs_enough_logs(training_logs, tmp_path, spark):
    assert forest.train(training_logs.limit(10)) is None
    detector = forest.IsolationForest(spark, str(tmp_path / "model"))
    assert detector.train_on_recent(training_logs, as_of="2026-02-01")[0:2] == (False, 0)
    assert detector.detect(training_logs).count() == 0
    assert detector.describe()["model_loaded"] is False


def test_model_survives_saving(training_logs, model, tmp_path, spark):
    path = str(tmp_path / "model")
    forest.save_model(model, path)
    loaded = forest.load_model(spark, path)
    assert loaded.samples_trained == 600
    before = {r.log_id: r.score for r in forest.scores(training_logs, model).collect()}
    after = {r.log_id: r.score for r in forest.scores(training_logs, loaded).collect()}
    assert before == after
    detector = forest.IsolationForest(spark, path, contamination=0.1)
    assert detector.describe()["samples_trained"] == 600
    assert detector.train_on_recent(training_logs, as_of="2026-03-02")[0] is False
    assert forest.load_model(spark, str(tmp_path / "none")) is None
    (tmp_path / "broken").mkdir()
    (tmp_path / "broken" / "part-0.parquet").write_text("no parquet")
    assert forest.load_model(spark, str(tmp_path / "broken")) is None


def test_training_does_not_depend_on_partitions(training_logs, model):
    again = forest.train(training_logs.repartition(7), contamination=0.1)
    assert again.threshold == model.threshold
    assert sorted(again.nodes.collect()) == sorted(model.nodes.collect())


def test_forest_properties(training_logs, model, make_logs):
    scored = [r.score for r in forest.scores(training_logs, model).collect()]
    assert model.threshold == pytest.approx(np.percentile(scored, 10))
    flagged = forest.detect(training_logs, model)
    assert 0 < flagged.count() <= 60
    assert model.nodes.select("tree").distinct().count() == forest.TREES
    odd = make_logs([("odd", "2026-03-01 23:00:00", "error", "x", "CRITICAL ERROR EXCEPTION FAILED TIMEOUT CRASH " * 9)])
    assert forest.scores(odd, model).first().score < np.median(scored)
    found = flagged.first()
    assert (found.anomaly_type, found.severity) == ("unusual_pattern", "medium")
    assert found.message.startswith("ML detected unusual log pattern: Test") and found.message.endswith("...")
    assert json.loads(found.details)["anomaly_score"] < model.threshold
    assert json.loads(found.details)["log_source"] in ("app", "api")


def test_scores_match_a_recursive_walk(training_logs, model):
    nodes = {}
    for n in model.nodes.collect():
        nodes.setdefault(n.tree, {})[n.node] = n

    def path(tree, point, node=0):
        n = nodes[tree][node]
        if n.left == node:
            return n.depth + float(forest.average_path(n.size))
        return path(tree, point, n.left if point[n.feature] <= n.split else n.right)

    from logquarry.operators.features import feature_vectors

    vectors = {r.log_id: r.vector for r in feature_vectors(training_logs.limit(20)).collect()}
    scale = float(forest.average_path(256))
    for row in forest.scores(training_logs.limit(20), model).collect():
        depth = np.mean([path(t, vectors[row.log_id]) for t in nodes])
        assert row.score == pytest.approx(-(2 ** (-depth / scale)))


def test_one_broadcast_per_forest(training_logs, model):
    held = model.held()
    forest.scores(training_logs, model).count()
    assert model.held() is held
    again = forest.train(training_logs, contamination=0.1)
    assert again.held() is not held
    again.release()
    assert not again._held


def test_a_model_too_large_is_refused(spark, model):
    many = spark.range(100 * 511 + 1).select(*[F.lit(0).cast(f.dataType).alias(f.name) for f in forest.NODE.fields])
    with pytest.raises(ValueError, match="at most 51100 nodes"):
        forest.Forest(many, 600, 0.1, 256, 0.0).held()


def test_draws_are_even(training_logs):
    """Every log is drawn about as often, and trees draw different logs."""
    vectors = training_logs.select(F.col("id").alias("log_id"), F.array(*[F.hash("id", F.lit(i)).cast("double") for i in range(8)]).alias("vector"))
    drawn = forest._drawn(vectors, 600, 256).groupBy("vector").count().collect()
    assert len(drawn) == 600 and all(15 < r["count"] < 75 for r in drawn)


def test_pool_sampling_fills_every_tree(spark):
    vectors = spark.range(150_000).select(
        F.col("id").cast("string").alias("log_id"),
        F.array(*[F.rand(i) for i in range(8)]).alias("vector"),
    )
    nodes = forest.grow_forest(vectors, 150_000, 256)
    roots = nodes.filter("node = 0").collect()
    assert len(roots) == forest.TREES and {r["size"] for r in roots} == {256}
    assert nodes.agg(F.max("depth")).first()[0] == 8


@pytest.mark.parametrize("p", [0.0, 0.05, 0.3337, 0.5, 1.0])
def test_exact_quantile(spark, p):
    rng = np.random.default_rng(1)
    values = np.concatenate([rng.normal(size=30_000), np.full(9_000, 0.25), [1e6]])
    weights = rng.integers(1, 4, size=len(values))
    df = spark.createDataFrame([(float(v), int(w)) for v, w in zip(values, weights)], "v double, w long").repartition(4).cache()
    assert exact_quantile(df, "v", "w", p) == pytest.approx(np.percentile(np.repeat(values, weights), 100 * p), rel=1e-12)


def test_quantile_of_nothing(spark):
    assert exact_quantile(spark.createDataFrame([], "v double, w long"), "v", "w", 0.5) is None
