"""The alert table by day: what a deletion leaves alone, what a read opens, and runs that stop halfway."""

import os
from datetime import datetime, timedelta

import pytest

from logquarry.schema import ALERT
from logquarry.sources.alerts import AlertTable

START = datetime(2026, 3, 1, 12)


def alert(spark, *rows):
    """(id, day, acknowledged) as alerts."""
    full = [(i, "log", "high", f"message {i}", None, START + timedelta(days=day), acked) for i, day, acked in rows]
    return spark.createDataFrame(full, ALERT)


def ids(df):
    return sorted(r.id for r in df.collect())


def files(path):
    return {
        os.path.join(folder, name): os.stat(os.path.join(folder, name)).st_mtime_ns
        for folder, _, names in os.walk(path)
        for name in names
        if name.endswith(".parquet")
    }


@pytest.fixture
def table(spark, tmp_path):
    table = AlertTable(spark, str(tmp_path / "t"))
    rows = [("a", 0, False), ("b", 0, True), ("c", 1, True), ("d", 2, False), ("e", 2, False), ("f", 3, False)]
    assert table.append(alert(spark, *rows)).count() == 6
    return table


def test_only_touched_days_are_written_anew(spark, table):
    table.acknowledge(spark.createDataFrame([("e",), ("f",)], "id string"))
    before = files(f"{table.path}/alerts")
    assert table.delete_old(1.5, START + timedelta(days=4)) == 3  # b and c, and e by its acknowledgement
    after = files(f"{table.path}/alerts")
    assert {os.path.basename(os.path.dirname(f)) for f in after} == {f"alert_date=2026-03-0{d}" for d in (1, 3, 4)}
    kept = {f for f in before if "2026-03-04" in f}
    assert kept and all(after.get(f) == before[f] for f in kept)
    assert not {f for f in before if "2026-03-04" not in f} & set(after)
    assert ids(table.read()) == ["a", "d", "f"]
    assert {r.id: r.acknowledged for r in table.read().collect()} == {"a": False, "d": False, "f": True}
    # The acknowledgements of the day that was written anew are gone, the others stay.
    assert os.listdir(f"{table.path}/acks") and not os.path.exists(f"{table.path}/acks/alert_date=2026-03-03")
    assert table.delete_old(1.5, START + timedelta(days=4)) == 0


def test_acknowledgements_are_folded_in(spark, table):
    table.acknowledge(spark.createDataFrame([("a",), ("d",), ("nobody",), (None,)], "id string"))
    state = sorted((r.id, r.acknowledged) for r in table.read().collect())
    untouched = {f: t for f, t in files(f"{table.path}/alerts").items() if "2026-03-04" in f}
    assert table.fold_acks() == 2
    assert sorted((r.id, r.acknowledged) for r in table.read().collect()) == state
    assert not files(f"{table.path}/acks")
    assert untouched.items() <= files(f"{table.path}/alerts").items()
    assert table.fold_acks() == 0


def test_reads_open_only_the_days_asked_for(spark, table):
    recent = table.open_since(24, START + timedelta(days=3))
    assert ids(recent) == ["d", "e", "f"]
    plan = recent._jdf.queryExecution().executedPlan().toString()
    scans = [line for line in plan.splitlines() if "PartitionFilters" in line]
    assert scans and all("alert_date" in line.split("PartitionFilters")[1].split("]")[0] for line in scans)
    assert ids(table.open_since(1, START + timedelta(days=9))) == []


def test_append_looks_only_at_the_days_of_the_new_alerts(spark, table):
    again = alert(spark, ("d", 2, False), ("g", 2, False), ("g", 2, False))
    assert ids(table.append(again)) == ["g"]
    assert ids(table.read()) == list("abcdefg")
    assert table.append(alert(spark).limit(0)).count() == 0


def test_a_stopped_deletion_is_completed_by_the_next_writer(spark, table, monkeypatch):
    staged = AlertTable._finish_staged
    calls = []

    def stop(self):
        calls.append(1)
        if len(calls) == 2:
            raise RuntimeError("driver lost")
        staged(self)

    table.acknowledge(spark.createDataFrame([("e",)], "id string"))
    monkeypatch.setattr(AlertTable, "_finish_staged", stop)
    with pytest.raises(RuntimeError):
        table.delete_acknowledged()
    monkeypatch.undo()
    # The staged days were complete; an alert of such a day that comes now is not lost.
    assert ids(table.append(alert(spark, ("h", 2, False)))) == ["h"]
    assert ids(table.read()) == ["a", "c", "d", "f", "h"]
    assert table.delete_acknowledged() == 1
    assert ids(table.read()) == ["a", "d", "f", "h"]


def test_empty_table(spark, tmp_path):
    table = AlertTable(spark, str(tmp_path / "none"))
    assert table.read().count() == 0 and table.delete_acknowledged() == 0 and table.fold_acks() == 0
    assert table.acknowledge(spark.createDataFrame([("x",)], "id string")).first().found is False
