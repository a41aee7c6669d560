"""The id ledger of a log table: no shuffle of stored ids, replays, retention and recovery."""

import pytest
from pyspark.sql import functions as F

from conftest import NOW, ago
from logquarry.operators.conflicts import append_conflicts, new_rows
from logquarry.sources.logs import DuplicateIds, LogTable


def logs_of(make_logs, ids, **amount):
    return make_logs([(i, ago(**amount), "info", "app", f"Message {i}") for i in ids])


def known(table):
    return sorted(r.id for r in table.ledger.ids().collect())


def above_ledger(frame):
    """Operators of the physical plan between the scan of the ledger and the join above it."""
    frame.collect()
    lines = frame._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0].splitlines()
    at = next(i for i, line in enumerate(lines) if "ledger_" in line)
    depth, found = len(lines[at]), []
    for line in reversed(lines[: at + 1]):
        start = next(i for i, c in enumerate(line) if c.isalpha() or c == "*")
        if start < depth:
            depth = start
            found.append(line.strip(" :+-*()0123456789"))
            if "Join" in line:
                return found
    raise AssertionError("no join above the ledger")


@pytest.mark.parametrize("threshold", ["-1", "10m"])
@pytest.mark.parametrize("partitions", ["4", "9"])
def test_stored_ids_are_not_shuffled(spark, make_logs, tmp_path, threshold, partitions):
    """A ledger below the threshold may be broadcast; it is never dealt out again."""
    table = LogTable(spark, str(tmp_path / "logs"))
    table.append_batch(logs_of(make_logs, [f"a{i}" for i in range(50)]))
    settings = {"spark.sql.autoBroadcastJoinThreshold": threshold, "spark.sql.shuffle.partitions": partitions}
    before = {key: spark.conf.get(key) for key in settings}
    try:
        for key, value in settings.items():
            spark.conf.set(key, value)  # also when the session deals into other numbers than the ledger
        batch = logs_of(make_logs, [f"a{i}" for i in range(40, 90)])
        fresh = new_rows(batch, table.ledger.ids(), table.ledger.dealt)
        conflicts = append_conflicts(batch, table.ledger.ids(), table.ledger.dealt)
        assert fresh.count() == 40 and conflicts.count() == 10
        for frame in (fresh, conflicts):
            path = above_ledger(frame)
            assert path[0].startswith("FileScan") and not any(step.startswith(("Exchange", "Shuffle")) for step in path)
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)


def test_replays_on_another_day_add_nothing(spark, make_logs, tmp_path):
    path = str(tmp_path / "logs")
    assert LogTable(spark, path).append_new(logs_of(make_logs, ["a", "b", "b"])) == 2
    # By another writer, on other days.
    for days in (1, 400):
        assert LogTable(spark, path).append_new(logs_of(make_logs, ["a", "b"], days=days)) == 0
    with pytest.raises(DuplicateIds):
        LogTable(spark, path).append_batch(logs_of(make_logs, ["b", "c"], days=3))
    assert known(LogTable(spark, path)) == ["a", "b"]


def test_deleted_logs_are_forgotten(spark, make_logs, tmp_path):
    table = LogTable(spark, str(tmp_path / "logs"))
    table.append_new(logs_of(make_logs, ["old"], days=40))
    table.append_new(logs_of(make_logs, ["edge"], days=30, seconds=1))
    table.append_new(logs_of(make_logs, ["same-day"], days=30))
    table.append_new(logs_of(make_logs, ["new"]))
    assert table.delete_old(30, NOW) == 2
    assert known(table) == ["new", "same-day"]
    assert table.append_new(logs_of(make_logs, ["old", "new"])) == 1


def test_a_run_that_stopped_halfway_is_made_good(spark, make_logs, tmp_path, monkeypatch):
    path = str(tmp_path / "logs")
    table = LogTable(spark, path)
    table.append_new(logs_of(make_logs, ["a"]))
    with monkeypatch.context() as patched:
        # Logs are written, their ids are not.
        patched.setattr(type(table.ledger), "add", lambda self, rows: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            table.append_new(logs_of(make_logs, ["b"]))
    assert known(table) == ["a"]
    again = LogTable(spark, path)
    assert again.append_new(logs_of(make_logs, ["a", "b", "c"], days=2)) == 1
    assert known(again) == ["a", "b", "c"]
    with monkeypatch.context() as patched:
        # Nothing is written at all.
        patched.setattr(LogTable, "_write", lambda *a: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            again.append_new(logs_of(make_logs, ["d"]))
    assert LogTable(spark, path).append_new(logs_of(make_logs, ["d"])) == 1


def test_logs_without_a_ledger_get_one(spark, make_logs, tmp_path):
    path = str(tmp_path / "logs")
    table = LogTable(spark, path)
    table._write(table._prepared(logs_of(make_logs, ["a", "b"])), path, "append")
    assert LogTable(spark, path).append_new(logs_of(make_logs, ["b", "c"])) == 1
    assert known(table) == ["a", "b", "c"]


def test_buckets_stay_when_the_session_changes(spark, make_logs, tmp_path):
    path = str(tmp_path / "logs")
    LogTable(spark, path).append_new(logs_of(make_logs, ["a"]))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    try:
        table = LogTable(spark, path)
        assert table.ledger.buckets == int(before)
        assert table.append_new(logs_of(make_logs, ["a", "b"])) == 1
        table.ledger.rebuild(table.ledger.ids(), buckets=3)
        assert table.ledger.buckets == 3 and known(table) == ["a", "b"]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_rows_without_a_time_keep_their_ids(spark, make_logs, tmp_path):
    table = LogTable(spark, str(tmp_path / "logs"))
    logs = logs_of(make_logs, ["a", "b"]).withColumn("timestamp", F.when(F.col("id") == "a", F.col("timestamp")))
    assert table.append_new(logs) == 2
    table.append_new(logs_of(make_logs, ["old"], days=60))
    table.delete_old(30, NOW)
    assert known(table) == ["a", "b"]
