"""Rollups kept up by a stream: order, replays, folds, deletions, and statistics read from them."""

from datetime import timedelta

import pytest
from pyspark.sql import functions as F

from conftest import NOW, ago
from logquarry.operators import stats
from logquarry.sources.rollup import Rollup, time_cells
from logquarry.streaming import rates

SCHEMA = "id string, timestamp timestamp, level string, source string, message string, raw string"


def logs_at(make_logs, *times):
    return make_logs([(f"l{i}", t, "ERROR" if i % 3 == 0 else "info", f"s{i % 2}", "m") for i, t in enumerate(times)])


def as_rows(frame):
    return sorted(map(tuple, frame.collect()))


def many(make_logs):
    return logs_at(make_logs, *[ago(minutes=7 * i, seconds=i) for i in range(300)], ago(minutes=30), ago(hours=2))


def test_a_repeated_batch_replaces_itself(spark, make_logs, tmp_path):
    rollup = Rollup(spark, str(tmp_path / "r"))
    assert rollup.read().count() == 0
    first, second = logs_at(make_logs, ago(hours=1), ago(hours=1)), logs_at(make_logs, ago(hours=1), ago(hours=900))
    rollup.add(first, "stream", 0)
    rollup.add(second, "stream", 1)
    rollup.add(second, "stream", 1)
    want = as_rows(time_cells(first.union(second), "hour", ("level", "source")))
    assert as_rows(rollup.read()) == want
    rollup.fold()
    rollup.add(second, "stream", 1)  # run again after it was folded
    assert as_rows(rollup.read()) == want
    rollup.fold()
    rollup.fold()
    rollup.add(second, "stream", 1)
    assert as_rows(rollup.read()) == want
    rollup.add(second, "stream", 2)
    rollup.add(second, "other", 0)
    assert rollup.read().agg(F.sum("count")).first()[0] == 8


def test_a_fold_that_stopped_changes_nothing(spark, make_logs, tmp_path, monkeypatch):
    rollup = Rollup(spark, str(tmp_path / "r"))
    rollup.add(many(make_logs), "a", 0)
    before = as_rows(rollup.read())
    with monkeypatch.context() as patched:
        patched.setattr("logquarry.sources.rollup.delete_folder", lambda *a: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            rollup.fold()  # the fold is complete, what it replaced is still there
    assert as_rows(rollup.read()) == before
    cells = rollup.read()
    cells.write.parquet(f"{rollup.path}/folds/v7/cells")  # a fold without its list is not complete
    assert as_rows(rollup.read()) == before
    rollup.fold()
    assert as_rows(rollup.read()) == before


@pytest.mark.parametrize("hours,as_of", [(24, NOW), (5, NOW - timedelta(minutes=17, seconds=3)), (0.25, NOW), (1, NOW.replace(minute=0)), (900, NOW)])
def test_statistics_equal_those_of_a_scan(spark, make_logs, tmp_path, hours, as_of):
    logs = many(make_logs)
    rollup = Rollup(spark, str(tmp_path / "r"))
    rollup.add(logs, "a", 0)
    cells = rollup.read()
    assert as_rows(stats.volume_stats_rolled(cells, logs, hours, as_of)) == as_rows(stats.volume_stats(logs, hours, as_of))
    since = as_of - timedelta(hours=hours)
    for column in ("level", "source"):
        assert as_rows(stats.count_by_rolled(cells, logs, column, since, as_of)) == as_rows(stats.count_by(logs, column, since, as_of))


def test_deletion_forgets_the_same_logs(spark, make_logs, tmp_path):
    logs = many(make_logs)
    rollup = Rollup(spark, str(tmp_path / "r"))
    rollup.add(logs, "a", 0)
    boundary = NOW - timedelta(hours=7, minutes=11)
    left = logs.filter(F.col("timestamp") >= F.lit(ago(hours=7, minutes=11)).cast("timestamp"))
    rollup.drop_before(boundary, left)
    assert as_rows(rollup.read()) == as_rows(time_cells(left, "hour", ("level", "source")))
    rollup.add(logs_at(make_logs, ago(hours=1)), "a", 1)
    assert rollup.read().agg(F.sum("count")).first()[0] == left.count() + 1


def test_a_stream_out_of_order_keeps_no_state(spark, make_logs, tmp_path):
    logs = many(make_logs).union(make_logs([("odd", None, "info", "s", "m")])).select(*[f.split()[0] for f in SCHEMA.split(", ")])
    folder, rollup = str(tmp_path / "in"), Rollup(spark, str(tmp_path / "r"), "minute", ("level",))
    # The newest come first, days before the rest.
    for part in range(4):
        logs.filter(F.pmod(F.hash("id"), F.lit(4)) == part).coalesce(1).write.mode("append").parquet(folder)
        stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(folder)
        run = rates.start_rollup(stream, rollup, str(tmp_path / "check"), interval=None)
        run.awaitTermination()
        assert run.lastProgress.stateOperators == []
        if part == 2:
            rollup.fold()
    got = as_rows(rates.windows_of_minutes(rollup.read()))
    assert got == as_rows(rates.error_rate_windows(logs.filter("timestamp IS NOT NULL"))) and len(got) > 1000


def test_units_are_checked(spark, tmp_path):
    with pytest.raises(ValueError, match="minute, hour, day"):
        Rollup(spark, str(tmp_path), "week")
