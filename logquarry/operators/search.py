"""Filtered and phrase search over logs, pages, look-ups and keyset reads."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logquarry.functions import text
from logquarry.functions.timerange import Instant, before, in_range, instant
from logquarry.schema import LOG_FIELDS

# Page size when none is given, and its bounds.
DEFAULT_LIMIT = 50
MAX_LIMIT = 1000

# Columns a LogTable may store beside the text so that a search needs no tokenising.
TOKEN_LINES = {"message": "message_tokens", "source": "source_tokens"}


def int_argument(value: object, default: int, low: int, high: int | None = None) -> int:
    """A page argument as an integer within its bounds; text is read up to its first non-digit."""
    if value is None or value == "":
        return default
    if isinstance(value, str):
        head = value.strip()
        sign = head[:1] if head[:1] in "+-" else ""
        digits = ""
        for ch in head[len(sign) :]:
            if ch not in "0123456789":
                break
            digits += ch
        if not digits:
            return default
        value = int(sign + digits)
    number = max(low, int(value))
    return number if high is None else min(number, high)


def page_arguments(limit: object = None, offset: object = None) -> tuple[int, int]:
    """Limit (missing or 0 means 50, then clamped to 1..1000) and offset (at least 0)."""
    size = int_argument(limit, DEFAULT_LIMIT, -MAX_LIMIT, MAX_LIMIT) or DEFAULT_LIMIT
    return max(size, 1), int_argument(offset, 0, 0)


@dataclass(frozen=True)
class Page:
    """A page of rows plus the filtered rows it was cut from."""

    rows: DataFrame
    matches: DataFrame

    def total(self) -> DataFrame:
        """Count of all matches, before paging."""
        return self.matches.agg(F.count(F.lit(1)).alias("total"))


def phrase_filter(df: DataFrame, phrase: str, columns: tuple[str, ...] = ("message", "source")) -> DataFrame:
    """Rows holding the phrase inside one of the columns, never across two of them."""
    words = text.phrase_tokens(phrase)
    hit = F.lit(False)
    if words:
        for column in columns:
            stored = TOKEN_LINES.get(column)
            if stored in df.columns:
                hit = hit | text.line_has_phrase(F.col(stored), words)
            else:
                hit = hit | text.has_phrase(F.col(column), words)
    return df.filter(hit)


def matching(
    df: DataFrame,
    q: str | None = None,
    level: str | None = None,
    source: str | None = None,
    start: Instant = None,
    end: Instant = None,
) -> DataFrame:
    """Conjunction of the filters that are given; cheap column filters come before the phrase."""
    df = in_range(df, start if start != "" else None, end if end != "" else None)
    if level:
        df = df.filter(F.col("level") == level)
    if source:
        df = df.filter(F.col("source") == source)
    if q:
        df = phrase_filter(df, q)
    return df


def search(
    df: DataFrame,
    q: str | None = None,
    level: str | None = None,
    source: str | None = None,
    start: Instant = None,
    end: Instant = None,
    limit: object = None,
    offset: object = None,
) -> Page:
    """Newest matching logs first; equal timestamps are ordered by id.

    ``limit`` and ``offset`` are page arguments (see ``page_arguments``). The page is lazy; its
    top-k holds offset + limit rows per task, so use ``deep_search`` for pages far down.
    """
    size, skip = page_arguments(limit, offset)
    matches = matching(df, q, level, source, start, end)
    return Page(_page(matches, size, skip), matches)


def _page(matches: DataFrame, size: int, skip: int) -> DataFrame:
    return matches.select(*LOG_FIELDS).orderBy(F.desc("timestamp"), "id").offset(skip).limit(size)


def deep_search(
    df: DataFrame,
    q: str | None = None,
    level: str | None = None,
    source: str | None = None,
    start: Instant = None,
    end: Instant = None,
    limit: object = None,
    offset: object = None,
) -> Page:
    """The same page as ``search``, found by counting first (see ``skip_ahead``).

    Runs a few small jobs right away: up to five for the time, one when a month holds one instant only, and
    three for every factor of about 4,000 among the rows of one instant.
    """
    size, skip = page_arguments(limit, offset)
    matches = matching(df, q, level, source, start, end)
    rows, skip = skip_ahead(matches, skip)
    return Page(_page(rows, size, skip), matches)


# Rows that a page may skip in one place, and ids that divide those of one instant.
KEPT = 1000
BORDERS = 64
# Ids (alone, without their rows) that may be put in order in one place.
PICKED = 100_000
_UNITS = (
    ("month", "1 month"),
    ("hour", "1 hour"),
    ("second", "1 second"),
    ("millisecond", "0.001 seconds"),
    ("microsecond", "0.000001 seconds"),
)


def skip_ahead(matches: DataFrame, skip: int) -> tuple[DataFrame, int]:
    """Leave out the newest rows that an offset would skip anyway: the rest, and what to skip in it.

    A top-k keeps offset + limit rows per task and merges them in one place. Counting the matches
    per month, then per hour of the month reached, then down to the microsecond tells how many
    rows lie above each boundary; among the rows of one instant, ids are counted in ranges. Below the
    second it ends when no more than KEPT rows remain to be skipped. Rows of one instant go on to the ids at once.
    """
    inside = matches
    for unit, width in _UNITS:
        if skip <= KEPT and unit in ("millisecond", "microsecond"):
            return matches, skip
        counts = (
            inside.filter(F.col("timestamp").isNotNull())
            .groupBy(F.date_trunc(unit, "timestamp").alias("begin"))
            .agg(F.count(F.lit(1)).alias("n"), F.min("timestamp").alias("oldest"), F.max("timestamp").alias("newest"))
            .orderBy(F.desc("begin"))
            .select(F.col("begin").cast("string"), "n", F.col("oldest").cast("string"), F.col("oldest") == F.col("newest"))
            .collect()
        )
        for begin, n, oldest, instant_only in counts:
            if n > skip:
                break
            skip -= n
        else:
            # Every dated row is skipped.
            undated = matches.filter(F.col("timestamp").isNull())
            first, skip = _skip_ids(undated, skip)
            return undated.filter(first), skip
        if instant_only:
            begin, width = oldest, _UNITS[-1][1]
        low = F.lit(begin).cast("timestamp")
        below = F.col("timestamp") < low + F.expr(f"INTERVAL {width}")
        matches = matches.filter(below)
        inside = matches.filter(F.col("timestamp") >= low)
        if instant_only:
            break
    first, skip = _skip_ids(inside, skip, n)
    return matches.filter((F.col("timestamp") < low) | first), skip


def _skip_ids(rows: DataFrame, skip: int, n: int | None = None) -> tuple[Column, int]:
    """Of ``n`` rows with one timestamp those from some id on, and what remains to be skipped among them.

    BORDERS squared ids are drawn by hash. Every round counts the rows between and at BORDERS of them (at most 129
    counts) and goes on inside the range reached, with the drawn ids that lie in it. Ids of a range of PICKED rows
    are put in order instead. Rows that share an id are not told apart.
    """
    first = F.lit(True)
    inside: list[str] = []
    while skip > KEPT:
        if n is not None and n <= PICKED:
            ahead = rows.select("id").orderBy("id").limit(skip + 1).groupBy("id").agg(F.count(F.lit(1)).alias("n"))
            border, held = ahead.agg(F.max("id"), F.max_by("n", "id")).first()
            return (first, skip) if border is None else (F.col("id") >= border, held - 1)
        if not inside:
            drawn = rows.filter(F.col("id").isNotNull()).orderBy(F.xxhash64("id"), "id").select("id").limit(BORDERS**2)
            inside = sorted({row["id"] for row in drawn.collect()})
        if not inside:
            break
        borders = inside[:: -(-len(inside) // BORDERS)]
        counts = dict(_places(rows, borders).groupBy("range").agg(F.count(F.lit(1)).alias("n")).collect())
        for place in range(2 * len(borders) + 1):
            n = counts.get(place, 0)
            if n > skip:
                break
            skip -= n
        else:
            return F.lit(False), skip
        j, at_border = divmod(place, 2)
        if at_border:
            return F.col("id") >= borders[j], skip
        if j:
            first = F.col("id") > borders[j - 1]
            rows = rows.filter(first)
            inside = [drawn_id for drawn_id in inside if drawn_id > borders[j - 1]]
        if j < len(borders):
            rows = rows.filter(F.col("id").isNull() | (F.col("id") < borders[j]))
            inside = inside[: inside.index(borders[j])]
    return first, skip


def _places(rows: DataFrame, borders: list[str]) -> DataFrame:
    """The ``range`` of every id: even between two borders, odd at a border; a null id comes before all.

    The number of borders below an id is found by halving, a step per column.
    """
    listed = F.array(*map(F.lit, borders))
    places = rows.select("id", F.lit(0).alias("below"))
    step = 1 << (len(borders).bit_length() - 1)
    while step:
        # Beyond the last border there is null.
        further = F.get(listed, F.col("below") + (step - 1)) < F.col("id")
        places = places.select("id", (F.col("below") + F.when(further, step).otherwise(0)).alias("below"))
        step //= 2
    at = F.coalesce(F.col("id").isin(borders).cast("int"), F.lit(0))
    return places.select((2 * F.col("below") + at).alias("range"))


def recent(df: DataFrame, n: int) -> DataFrame:
    """The newest ``n`` logs."""
    return df.select(*LOG_FIELDS).orderBy(F.desc("timestamp"), "id").limit(n)


def by_id(df: DataFrame, log_id: str) -> DataFrame:
    """The log with this id, or no row."""
    return df.select(*LOG_FIELDS).filter(F.col("id") == log_id).limit(1)


def fetch_since(df: DataFrame, last_id: str | None = None, limit: int = 1000) -> DataFrame:
    """Keyset page: the next logs in id order after ``last_id``."""
    if last_id:
        df = df.filter(F.col("id") > last_id)
    return df.select(*LOG_FIELDS).orderBy("id").limit(limit)


def fetch_range(df: DataFrame, start: Instant, end: Instant, limit: int | None = None) -> DataFrame:
    """Oldest logs first within a closed time range; all of them unless ``limit`` is given."""
    found = in_range(df, start, end).select(*LOG_FIELDS).orderBy("timestamp", "id")
    return found if limit is None else found.limit(limit)


def fetch_recent(df: DataFrame, hours: float = 1.0, limit: int | None = None, as_of: Instant = None) -> DataFrame:
    """The same for the last ``hours``."""
    return fetch_range(df, before(as_of, hours=hours), instant(as_of), limit)
