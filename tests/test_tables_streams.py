import json
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from conftest import NOW, ago
from logquarry.operators import inbox as inbox_ops
from logquarry.operators import search
from logquarry.operators.detectors import registry, rules
from logquarry.schema import INBOX, PROCESSED
from logquarry.sources import lines
from logquarry.sources.alerts import AlertTable
from logquarry.sources.inbox import Inbox
from logquarry.sources.logs import DuplicateIds, LogTable
from logquarry.streaming import alerts as stream_alerts
from logquarry.streaming import ingest, rates


def some_logs(make_logs, ids, **amount):
    return make_logs([(i, ago(**amount), "info", "app", f"Message {i}") for i in ids])


def test_log_table_refuses_known_ids(spark, make_logs, tmp_path):
    table = LogTable(spark, str(tmp_path / "logs"))
    assert table.scan().count() == 0
    assert table.append_batch(some_logs(make_logs, [])) == 0
    assert table.append_batch(some_logs(make_logs, ["a", "b"])) == 2
    for batch in (["c", "a"], ["c", "c"]):
        with pytest.raises(DuplicateIds):
            table.append_batch(some_logs(make_logs, batch))
    assert table.scan().count() == 2
    assert table.append(some_logs(make_logs, ["c"])) == 1
    assert table.append_new(some_logs(make_logs, ["c", "d", "d"])) == 1
    # An id is known whatever day it comes under.
    assert table.append_new(some_logs(make_logs, ["d", "a"], days=1)) == 0
    assert sorted(r.id for r in table.scan().collect()) == ["a", "b", "c", "d"]


def test_token_lines_are_stored_with_the_log(spark, make_logs, tmp_path):
    table = LogTable(spark, str(tmp_path / "logs"), token_lines=True)
    table.append_batch(some_logs(make_logs, ["a"]))
    assert search.search(table.scan(), q="message A").rows.count() == 1
    assert search.search(table.scan(), q="essage").rows.count() == 0
    assert LogTable(spark, str(tmp_path / "logs")).scan().columns[-1] == "log_date"


def test_log_retention(spark, make_logs, tmp_path):
    table = LogTable(spark, str(tmp_path / "logs"))
    table.append_batch(make_logs([
        ("old", ago(days=40), "info", "s", "m"),
        ("edge-before", ago(days=30, seconds=1), "info", "s", "m"),
        ("edge", ago(days=30), "info", "s", "m"),
        ("new", ago(), "info", "s", "m"),
    ]))
    with pytest.raises(ValueError, match="positive"):
        table.delete_old(0)
    assert table.delete_old(30, NOW) == 2
    assert sorted(r.id for r in table.scan().collect()) == ["edge", "new"]
    assert table.delete_old(30, NOW) == 0
    assert table.delete_old(29, NOW) == 1
    assert [r.id for r in table.scan().collect()] == ["new"]


def test_inbox(spark, tmp_path):
    box = Inbox(spark, str(tmp_path))
    given = spark.range(2500).select(F.col("id").alias("seq"), F.concat(F.lit('say "'), "id", F.lit('"\\')).alias("content"))
    assert box.enqueue(given.limit(0), ago(hours=3)) is False
    assert box.enqueue(given, ago(hours=3)) is True
    assert box.enqueue(given.limit(1), ago(hours=2)) is True
    assert tuple(box.stats().first()) == (4, 4)
    taken = box.take(3, ago(hours=1))
    assert [r.id for r in taken.collect()] == [0, 1, 2]
    assert [len(json.loads(r.data)) for r in taken.collect()] == [1000, 1000, 500]
    exploded = inbox_ops.explode_batches(taken).orderBy("inbox_id", "pos").collect()
    assert [r.content for r in exploded] == [f'say "{i}"\\' for i in range(2500)]
    assert tuple(box.stats().first()) == (1, 4)
    assert [r.id for r in box.take(100, NOW).collect()] == [3]
    assert box.take(10, NOW).count() == 0
    box.clean_up(0.5, NOW)
    assert tuple(box.stats().first()) == (0, 1)
    box.enqueue(given.limit(1), NOW)
    assert [r.id for r in box.take(1, NOW).collect()] == [4]
    with pytest.raises(ValueError, match="batch size"):
        box.enqueue(given, NOW, size=1001)


def test_inbox_bodies(spark):
    bodies = {
        '["a","b"]': ("accepted", '["a","b"]'),
        '["a",1,null,{"b":1},true,"c"]': ("accepted", '["a","c"]'),
        "[1]": ("nothing_to_store", None),
        "[]": ("nothing_to_store", None),
        '{"a":1}': ("not_an_array", None),
        "nope": ("invalid_json", None),
        json.dumps(["x"] * 1000): ("accepted", json.dumps(["x"] * 1000, separators=(",", ":"))),
        json.dumps([1] * 1001): ("too_many_items", None),
    }
    df = spark.createDataFrame([(b,) for b in bodies], "body string")
    found = {r.body: (r.status, r.data) for r in inbox_ops.accept_bodies(df, keep=("body",)).collect()}
    assert found == bodies


def test_next_batches_limits(spark):
    inbox = spark.range(150).select("id", F.lit("[]").alias("data"), F.lit(ago()).cast("timestamp").alias("created_at"))
    none = spark.createDataFrame([], PROCESSED)
    assert inbox.schema.fieldNames() == INBOX.fieldNames()
    assert [inbox_ops.next_batches(inbox, none, n).count() for n in (7, 1000)] == [7, 150]
    for n in (0, 1001):
        with pytest.raises(ValueError):
            inbox_ops.next_batches(inbox, none, n)


def test_text_lines(spark, tmp_path):
    (tmp_path / "a.log").write_text("one\r\n\r\ntwo\nlast")
    rows = lines.read_lines(spark, str(tmp_path)).orderBy("seq").collect()
    assert [r.value for r in rows] == ["one", "", "two", "last"]
    assert all(r.path.endswith("a.log") for r in rows)
    stream = lines.stream_lines(spark, str(tmp_path))
    query = stream.writeStream.format("memory").queryName("lines").trigger(availableNow=True).start()
    query.awaitTermination()
    assert spark.table("lines").count() == 4


def write_messages(spark, folder, numbered):
    df = spark.createDataFrame(numbered, "id long, content string")
    df.coalesce(1).write.mode("append").parquet(folder)


def test_ingest_stream_restarts_without_loss_or_copies(spark, tmp_path):
    folder, dead, state = (str(tmp_path / n) for n in ("in", "dead", "state"))
    table = LogTable(spark, str(tmp_path / "logs"))

    def run(checkpoint):
        source = ingest.read_stream(spark, folder, "id long, content string", max_files=1)
        ingest.start_ingest(source, table, dead, checkpoint, interval=None).awaitTermination()

    write_messages(spark, folder, [(1, "bad json"), (2, '{"message":"ok","level":"err"}')])
    run(state)
    write_messages(spark, folder, [(1, "bad json"), (3, '{"message":"new","timestamp":1709290800}')])
    run(state)
    assert sorted((r.level, r.message) for r in table.scan().collect()) == [("error", "ok"), ("info", "new")]
    failed = ingest.dead_letter_table(spark, dead)
    assert [r.reason for r in failed.collect()] == ["invalid_json", "invalid_json"]
    # A lost checkpoint replays everything; what has its own timestamp is recognised.
    run(str(tmp_path / "other"))
    assert table.scan().filter("message = 'new'").count() == 1


def test_ingest_stream_can_skip_the_look_up(spark, tmp_path):
    folder, dead, state = (str(tmp_path / n) for n in ("in", "dead", "state"))
    table = LogTable(spark, str(tmp_path / "logs"))
    for i in range(3):
        write_messages(spark, folder, [(i, json.dumps({"message": f"m{i}", "timestamp": 1709290800 + i}))])
    source = ingest.read_stream(spark, folder, "id long, content string", max_files=1)
    ingest.start_ingest(source, table, dead, state, interval=None, recheck=False).awaitTermination()
    assert sorted(r.message for r in table.scan().collect()) == ["m0", "m1", "m2"]


def test_detection_stream_deduplicates(spark, tmp_path, mixed_logs):
    folder = str(tmp_path / "logs")
    schema = mixed_logs.schema
    alerts = AlertTable(spark, str(tmp_path / "alerts"))
    runs = str(tmp_path / "runs")

    def run(checkpoint):
        mixed_logs.coalesce(1).write.mode("append").parquet(folder)
        stream_alerts.start_detection(
            ingest.read_stream(spark, folder, schema, max_files=1),
            [rules.ErrorBurst(0.1), rules.VolumeSpike(-5.0)],
            alerts,
            runs,
            checkpoint,
            interval=None,
            as_of=NOW,
        ).awaitTermination()

    run(str(tmp_path / "c"))
    assert alerts.read().count() == 2
    run(str(tmp_path / "c"))
    assert alerts.read().count() == 2
    totals = registry.poll_stats(stream_alerts.poll_runs(spark, runs)).first()
    assert (totals.polls_count, totals.logs_processed, totals.alerts_created) == (2, 100, 2)
    stats = {r.name: (r.runs_count, r.alerts_created) for r in registry.detector_stats(stream_alerts.detector_runs(spark, runs)).collect()}
    assert stats == {"error_burst": (2, 2), "volume_spike": (2, 2)}


def test_sliding_rate_matches_batch(spark, tmp_path, error_logs, mixed_logs):
    folder = str(tmp_path / "logs")
    logs = error_logs.unionByName(mixed_logs)
    logs.repartition(3).write.parquet(folder)
    stream = ingest.read_stream(spark, folder, logs.schema, max_files=1)
    windows = rates.error_rate_windows(stream, lateness="2 hours")
    rates.start_updates(windows, str(tmp_path / "out"), str(tmp_path / "c"), "rate_test", None).awaitTermination()
    live = rates.latest(spark, str(tmp_path / "out"), "window_start")
    assert sorted(live.collect()) == sorted(rates.error_rate_windows(logs).collect())


def test_rates_count_late_rows(spark, tmp_path):
    """Five files, newest first, one per micro-batch: every row is in its windows."""
    start = datetime(2026, 3, 1)
    rows = [(start + timedelta(hours=5 - k, minutes=m), "error" if m % 2 else "info") for k in range(5) for m in range(60)]
    folder = str(tmp_path / "in")
    for k in range(5):
        one = spark.createDataFrame(rows[60 * k : 60 * k + 60], "timestamp timestamp, level string")
        one.coalesce(1).write.mode("append").parquet(folder)
    logs = spark.read.parquet(folder)
    stream = ingest.read_stream(spark, folder, logs.schema, max_files=1)
    for name, key, counted in (("late_rate", "window_start", rates.error_rate_windows), ("late_volume", "hour", rates.hourly_volume)):
        out = str(tmp_path / name)
        rates.start_updates(counted(stream), out, f"{out}_c", name, None).awaitTermination()
        assert sorted(rates.latest(spark, out, key).collect()) == sorted(counted(logs).collect())
