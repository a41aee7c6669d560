"""Pages far down, also among logs of one instant."""

import random

import pytest

from conftest import ago
from logquarry.operators import search


def expected(rows, limit, offset):
    """Newest first, no time last; then by id, no id first."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or ""))
    dated = sorted((r for r in rows if r[1] is not None), key=lambda r: r[1], reverse=True)
    ordered = dated + [r for r in rows if r[1] is None]
    return [r[0] for r in ordered[offset : offset + limit]]


@pytest.mark.parametrize("kept,borders", [(3, 2), (0, 5), (20, 64)])
def test_deep_pages_against_sorting(make_logs, monkeypatch, kept, borders):
    monkeypatch.setattr(search, "KEPT", kept)
    monkeypatch.setattr(search, "BORDERS", borders)
    rng = random.Random(kept)
    instants = [ago(days=2)[:19] + ".123456", ago(days=2)[:19] + ".123457", ago(days=2)[:19] + ".9", ago(days=70)[:19], None]
    rows = [(f"{rng.randrange(10**6):06d}", rng.choice([*instants[:1] * 6, *instants])) for _ in range(250)]
    rows = list({i: (i, t) for i, t in rows}.values())
    rows += [(None, instants[0])]
    logs = make_logs([(i, t, "info", "s", "m") for i, t in rows]).repartition(4).cache()
    for offset in (0, 1, 7, 40, 130, 200, len(rows) - 1, len(rows), len(rows) + 5):
        found = search.deep_search(logs, limit=6, offset=offset).rows.collect()
        assert [r.id for r in found] == expected(rows, 6, offset), offset


def test_a_page_holds_few_rows(make_logs, monkeypatch):
    monkeypatch.setattr(search, "KEPT", 10)
    logs = make_logs([(f"{i:05d}", ago(hours=1), "info", "s", "m") for i in range(3000)])
    rows, skip = search.skip_ahead(logs, 2500)
    assert skip <= 10 and rows.count() == 3000 - 2500 + skip


def test_repeated_ids_end_the_search(make_logs, monkeypatch):
    monkeypatch.setattr(search, "KEPT", 2)
    logs = make_logs([(i, ago(hours=1), "info", "s", "m") for i in ["a"] * 5 + ["b"] * 50 + ["c"] * 5])
    found = [[r.id for r in search.deep_search(logs, limit=4, offset=offset).rows.collect()] for offset in (3, 20, 53, 58)]
    assert found == [["a", "a", "b", "b"], ["b"] * 4, ["b", "b", "c", "c"], ["c", "c"]]


@pytest.mark.parametrize("kept,borders,picked", [(3, 2, 0), (0, 5, 0), (3, 3, 40)])
def test_ranges_of_ids_against_sorting(make_logs, monkeypatch, kept, borders, picked):
    for name, value in (("KEPT", kept), ("BORDERS", borders), ("PICKED", picked)):
        monkeypatch.setattr(search, name, value)
    instant = ago(days=2)[:19] + ".123456"
    ids = [f"{i:03d}" for i in random.Random(borders).sample(range(1000), 200)] + [None, "x'", "\u00e9"]
    logs = make_logs([(i, instant, "info", "s", "m") for i in ids]).repartition(3).cache()
    for offset in (0, 5, 60, 150, len(ids) - 1, len(ids)):
        found = search.deep_search(logs, limit=6, offset=offset).rows.collect()
        assert [r.id for r in found] == expected([(i, instant) for i in ids], 6, offset), offset


def test_one_instant_takes_few_jobs(make_logs, monkeypatch):
    monkeypatch.setattr(search, "KEPT", 10)
    monkeypatch.setattr(search, "BORDERS", 4)
    monkeypatch.setattr(search, "PICKED", 300, raising=False)
    logs = make_logs([(f"{i:05d}", ago(hours=1), "info", "s", "m") for i in range(3000)])
    runs = []
    collect = type(logs).collect
    monkeypatch.setattr(type(logs), "collect", lambda df: runs.append(1) or collect(df))
    rows, skip = search.skip_ahead(logs, 2500)
    assert len(runs) <= 7  # one for the time, a draw, counts, and the last range
    monkeypatch.undo()
    assert skip <= 10 and rows.count() == 3000 - 2500 + skip
