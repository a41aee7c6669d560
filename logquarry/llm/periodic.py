"""Periodic runs of words: stretches that repeat with a period, at least four times over.

A run is a stretch of consecutive words whose smallest period q makes it at least max(6, 4 q) words long
and that no neighbouring word extends with that period. Periods up to SHORT are found by direct lag
scans: words equal to the word q further on, in stretches. Longer ones are found by minimizers at
doubling scales. Scale w serves the periods from w/2 + 1 to w: every window of w words is hashed (from
two hashes of the scale below), and a window start is a minimizer if it is the least of some w/2
neighbouring starts. Inside a run of such a period equal windows lie whole periods apart and nowhere
else, so the minima of one period come back one period later, and the next equal minimizer is exactly q
words away. Each such pair is a seed, extended to both sides by comparing words. A run of 4 q words holds
at least one pair, so none is missed; a stretch found with several periods goes by the smallest.

Words are told apart by their bytes: equal 64-bit hashes are compared, and renumbered if they lie.

Defined results: null and empty texts and texts of white space have no words, no runs and collapse to
the empty text. Texts of any length are handled whole, one text within one task: memory is about 200
bytes per word of the longest one. Rows are independent: repeated rows give repeated results, and a null
``doc_id`` is kept. Other columns are not looked at; those named in ``keep`` are passed on and must not
have the name of a result. An empty table gives an empty table.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logquarry.llm import blocks as B
from logquarry.llm import text as T

SHORT = 8
LEAST, TIMES = 6, 4
BLOCK = 2 << 20
# Words compared at first when a seed is extended; doubled while they agree.
STEP = 64
RESULT = (
    "doc_id long, n_words long, n_runs long, start long, length long, period long, exponent_milli long, "
    "runs array<struct<start: long, length: long, period: long>>, collapsed string"
)


def word_numbers(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Equal numbers for equal words, and for no others."""
    hashes = T.hasher().segments(data, starts, ends)
    _, first, number = np.unique(hashes, return_index=True, return_inverse=True)
    likeness, lengths = first[number], ends - starts
    same = bool((lengths == lengths[likeness]).all())
    if same and not (data[T.ranges(starts, lengths)] == data[T.ranges(starts[likeness], lengths)]).all():
        same = False
    if same:
        return number
    seen: dict[bytes, int] = {}
    words = (data[a:b].tobytes() for a, b in zip(starts.tolist(), ends.tolist()))
    return np.array([seen.setdefault(word, len(seen)) for word in words], np.int64)


def _stretches(equal: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edges = np.flatnonzero(np.diff(equal.astype(np.int8), prepend=0, append=0))
    return edges[::2], edges[1::2]


def _short_runs(words: np.ndarray, doc: np.ndarray) -> list[np.ndarray]:
    found = []
    for q in range(1, min(SHORT, len(words) - 1) + 1):
        first, last = _stretches((words[:-q] == words[q:]) & (doc[:-q] == doc[q:]))
        length = last - first + q
        good = length >= max(LEAST, TIMES * q)
        found.append(np.stack([first[good], length[good], np.full(int(good.sum()), q)], axis=1))
    return found


def _over_windows(values: np.ndarray, size: int, pick, fill: int) -> np.ndarray:
    """pick (minimum or maximum) of values[i : i + size] for every i; size is a power of two."""
    out, step = values.copy(), 1
    while step < size:
        out[: len(out) - step] = pick(out[: len(out) - step], out[step:])
        out[len(out) - step :] = pick(out[len(out) - step :], np.uint64(fill))
        step *= 2
    return out


def _minimizers(windows: np.ndarray, size: int) -> np.ndarray:
    """Positions that hold the minimum of some ``size`` consecutive positions."""
    least = _over_windows(windows, size, np.minimum, T.MASK)
    # The largest minimum among the windows that hold a position: those that start up to size - 1 before it.
    padded = np.concatenate([np.zeros(size - 1, np.uint64), least])
    most = _over_windows(padded, size, np.maximum, 0)[: len(windows)]
    return np.flatnonzero((most == windows) & (windows != np.uint64(T.MASK)))


def _extended(words: np.ndarray, at: int, lag: int, low: int, high: int) -> tuple[int, int]:
    """The stretch [a, b) around ``at`` in which every word equals that ``lag`` further on, inside [low, high)."""
    end, step = at, STEP
    while end + lag < high:
        stop = min(end + step, high - lag)
        differ = np.flatnonzero(words[end:stop] != words[end + lag : stop + lag])
        if len(differ):
            end += int(differ[0])
            break
        end, step = stop, step * 2
    start, step = at, STEP
    while start > low:
        stop = max(start - step, low)
        differ = np.flatnonzero(words[stop:start] != words[stop + lag : start + lag])
        if len(differ):
            start = stop + int(differ[-1]) + 1
            break
        start, step = stop, step * 2
    return start, end


def _long_runs(words: np.ndarray, first: np.ndarray) -> list[tuple[int, int, int]]:
    """Runs of periods above SHORT; ``first`` holds the number of words before each text, and all words."""
    found = []
    scale = 2 * SHORT
    lengths = np.diff(first)
    hashes = T.windows(words.astype(np.uint64), SHORT)
    hashes = np.concatenate([hashes, np.zeros(len(words) - len(hashes), np.uint64)])
    # Positions of the texts that are long enough, as they get fewer.
    place, width = np.arange(len(words)), SHORT
    while True:
        enough = lengths >= TIMES * (scale // 2 + 1)
        if not enough.any():
            return found
        inside = np.repeat(enough, lengths)
        place, hashes, lengths, first = place[inside], hashes[inside], lengths[enough], first[:-1][enough]
        bounds = np.concatenate([[0], np.cumsum(lengths)])
        doc = np.repeat(np.arange(len(lengths)), lengths)
        later = np.concatenate([hashes[width:], np.zeros(width, np.uint64)])
        hashes = T.splitmix(hashes * np.uint64(0x2545F4914F6CDD1D) + T.splitmix(later + np.uint64(scale)))
        width = scale
        whole = np.arange(len(doc)) + width <= bounds[doc + 1]
        at = _minimizers(np.where(whole, np.minimum(hashes, np.uint64(T.MASK - 1)), np.uint64(T.MASK)), scale // 2)
        order = at[np.lexsort((at, hashes[at]))]
        a, b = order[:-1], order[1:]
        lag = b - a
        seed = (hashes[a] == hashes[b]) & (doc[a] == doc[b]) & (lag > scale // 2) & (lag <= scale)
        a, lag = a[seed], lag[seed]
        by_lag = np.lexsort((a, lag))
        done = (0, -1)  # lag and end of the stretch found last
        for i in by_lag.tolist():
            position, q = int(place[a[i]]), int(lag[i])
            if done[0] == q and position < done[1]:
                continue
            of = int(doc[a[i]])
            low, high = int(first[of]), int(first[of] + lengths[of])
            start, end = _extended(words, position, q, low, high)
            done = (q, end)
            if end - start + q >= TIMES * q:
                found.append((start, end - start + q, q))
        first = np.concatenate([first, [0]])
        scale *= 2


def runs_of(words: np.ndarray, first: np.ndarray) -> np.ndarray:
    """(start, length, period) of all runs, by start and period, for texts laid end to end."""
    if not len(words):
        return np.empty((0, 3), np.int64)
    doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
    found = _short_runs(words, doc)
    found.append(np.array(_long_runs(words, first), np.int64).reshape(-1, 3))
    runs = np.concatenate(found)
    runs = runs[np.lexsort((runs[:, 2], runs[:, 1], runs[:, 0]))]
    # The same stretch with another period: that is a multiple of the smallest.
    repeated = np.zeros(len(runs), bool)
    repeated[1:] = (runs[1:, :2] == runs[:-1, :2]).all(axis=1)
    runs = runs[~repeated]
    return runs[np.lexsort((runs[:, 2], runs[:, 0]))]


def _joined(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, doc: np.ndarray, docs: int) -> pa.Array:
    """Words of each text with one space between them."""
    last = np.ones(len(doc), bool)
    last[:-1] = doc[1:] != doc[:-1]
    lengths = ends - starts + ~last
    flat = np.append(data, np.uint8(32))[T.ranges(starts, lengths)]
    flat[(np.cumsum(lengths) - 1)[~last]] = 32  # white space after the word, whichever
    sizes = np.bincount(doc, lengths, docs).astype(np.int64)
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
    text = pa.LargeStringArray.from_buffers(docs, pa.py_buffer(offsets.tobytes()), pa.py_buffer(flat.tobytes()))
    return text.cast(pa.string())


def _of_block(block: pa.Table) -> dict[str, pa.Array]:
    data, offsets = T.text_bytes(block.column("text"))
    starts, ends, first = T.spans(data, offsets, T.NOT_SPACE)
    docs = len(block)
    doc = np.repeat(np.arange(docs), np.diff(first))
    words = word_numbers(data, starts, ends)
    runs = runs_of(words, first)
    dropped = np.zeros(len(words) + 1, np.int64)
    np.add.at(dropped, runs[:, 0] + runs[:, 2], 1)
    np.add.at(dropped, runs[:, 0] + runs[:, 1], -1)
    kept = np.cumsum(dropped)[:-1] == 0
    of = doc[runs[:, 0]] if len(runs) else np.empty(0, np.int64)
    best: list[tuple | None] = [None] * docs
    for i, (start, length, period) in zip(of.tolist(), runs.tolist()):
        # By start, then period: only a greater exponent takes the place.
        if best[i] is None or length * best[i][2] > best[i][1] * period:
            best[i] = (start - int(first[i]), length, period)
    cuts = np.searchsorted(of, np.arange(docs + 1))
    columns = (runs[:, 0] - first[of], runs[:, 1], runs[:, 2])
    parts = pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in columns], ["start", "length", "period"])
    return {
        "n_words": pa.array(np.diff(first), pa.int64()),
        "n_runs": pa.array(np.diff(cuts), pa.int64()),
        **{name: pa.array([b and b[k] for b in best], pa.int64()) for k, name in enumerate(("start", "length", "period"))},
        "exponent_milli": pa.array([b and 1000 * b[1] // b[2] for b in best], pa.int64()),
        "runs": pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), parts),
        "collapsed": _joined(data, starts[kept], ends[kept], doc[kept], docs),
    }


def periodic_runs(docs: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per document: its runs, and its text with every run cut to its first period.

    ``start``, ``length``, ``period`` and ``exponent_milli`` (thousandths, rounded down) are those of the
    run with the greatest length / period; ties go to the smallest start, then period; null without a run.
    """
    B.prepare(docs.sparkSession)

    def run(batches):
        for block in T.blocks(batches, "text", BLOCK):
            out = _of_block(block)
            table = pa.table({"doc_id": block.column("doc_id"), **out, **{f"keep_{c}": block.column(f"keep_{c}") for c in keep}})
            yield from table.to_batches()

    kept = [F.col(c).alias(f"keep_{c}") for c in keep]
    asked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *kept)
    found = asked.mapInArrow(run, T.schema(RESULT, docs.select(*kept)))
    return found.select(*(c for c in found.columns if not c.startswith("keep_")), *(F.col(f"keep_{c}").alias(c) for c in keep))
