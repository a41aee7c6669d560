"""Alert de-duplication: which anomalies become alerts.

An anomaly is dropped when an open alert of the same severity contains the first 50 characters of
its message (ASCII case ignored). Anomalies are taken one by one, so an anomaly that was kept
earlier in the same batch counts as an open alert too.

"Contains" is turned into equality. A pattern is looked for by one part of it, its anchor: as long as the
longest of ANCHORS that fits, and of these parts one that few other patterns hold. So a
beginning that many messages share anchors none of them, and one short pattern does not shorten the anchors
of others. Every position of a text gives one hash per anchor length in use, with no more than the number of
the text; hashes that meet are verified on the texts, which join by number. Both
sides are reduced to distinct values first, however many alerts share a message.

Tables that were written and read back compress so well that their file size says little about the rows
they hold, and Spark would broadcast them. Joins with them are merge joins unless the size was counted.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logquarry.functions.text import ascii_lower
from logquarry.session import materialise

PREFIX_CHARS = 50
ANCHORS = (1, 2, 4, 8, 16, 32)
# Texts of so many characters in all are few: their parts are broadcast.
FEW_CHARS = 50_000
# So many ids are few: they are broadcast.
FEW_IDS = 100_000
# Columns that anomalies are ordered by behind the order asked for.
LAST = ("message", "details")

# Gives the pattern of an anomaly from its message, in the spelling of the message.
DedupKey = Callable[[Column], Column]


def beginning(message: Column) -> Column:
    """The usual key: the first characters of the message."""
    return F.left(message, F.lit(PREFIX_CHARS))


def after(preamble: str) -> DedupKey:
    """A key for messages that all begin alike: as many characters from behind the preamble."""

    def key(message: Column) -> Column:
        rest = F.substring(message, len(preamble) + 1, PREFIX_CHARS)
        return F.when(F.startswith(message, F.lit(preamble)), rest).otherwise(beginning(message))

    return key


def _part(text: str, at: str) -> Column:
    """Hash of the k characters of ``text`` at a position, of one severity."""
    return F.expr(f"xxhash64(severity, k, substr({text}, {at}, k))")


def _with_length(patterns: DataFrame) -> DataFrame:
    """Patterns that are not empty, with the length of their anchor."""
    lengths = "CASE " + " ".join(f"WHEN length(pattern) >= {k} THEN {k}" for k in reversed(ANCHORS)) + " END"
    return patterns.filter(F.length("pattern") > 0).withColumn("k", F.expr(lengths))


def _anchored(patterns: DataFrame) -> DataFrame:
    """Distinct patterns that are not empty, each with (k, gram): a rare part of k characters.

    Parts begin a quarter of k apart, and one ends the pattern, so that any 3/4 k characters lie in one of them.
    """
    named = patterns.columns
    parts = (
        _with_length(patterns)
        .selectExpr("*", "length(pattern) - k + 1 AS last")
        .selectExpr("*", "explode(array_union(sequence(1, last, greatest(k div 4, 1)), array(last))) AS offset")
        .withColumn("gram", _part("pattern", "offset"))
    )
    holders = parts.groupBy("gram").agg(F.count(F.lit(1)).alias("holders"))
    met = parts.join(holders.hint("merge"), "gram")
    # Of equally rare parts the last one. One number, as Spark aggregates structs by sorting.
    best = met.groupBy(*named, "k").agg(F.expr(f"min(holders * {1 << 20} - least(offset, {(1 << 20) - 1}))").alias("best"))
    offset = f"{1 << 20} - pmod(best - 1, {1 << 20}) - 1"
    return best.withColumn("gram", _part("pattern", f"cast({offset} AS int)")).select(*named, "k", "gram")


def _parts_of(texts: DataFrame, patterns: DataFrame) -> DataFrame:
    """(text_id, gram) of every position of a text, for the anchor lengths that patterns have."""
    used = _with_length(patterns).agg(F.collect_set("k").alias("k"))
    return (
        texts.withColumn("k", F.explode(used.scalar()))
        .filter(F.length("text") >= F.col("k"))
        .selectExpr("*", "explode(sequence(1, length(text) - k + 1)) AS i")
        .select("text_id", _part("text", "i").alias("gram"))
    )


def _links(texts: DataFrame, patterns: DataFrame, earlier: bool = False) -> DataFrame:
    """(pattern_id, text_id) where a text of (text_id, severity, text) contains a pattern of (pattern_id, severity, pattern).

    With ``earlier`` only texts of a smaller id than the pattern's; others are left out before they are shuffled.
    """
    other = F.col("text_id") < F.col("pattern_id") if earlier else F.lit(True)
    anchors = _anchored(patterns).select("gram", "pattern_id", "pattern")
    met = _parts_of(texts, patterns).join(anchors.hint("merge"), "gram").filter(other)
    held = texts.select("text_id", "text").hint("merge")
    found = met.join(held, "text_id").filter(F.contains("text", "pattern")).select("pattern_id", "text_id").distinct()
    # The empty pattern, one per severity at most, is contained in every text.
    empty = patterns.filter(F.col("pattern") == "").select("pattern_id", "severity")
    every = texts.filter("text IS NOT NULL").join(F.broadcast(empty), "severity").filter(other)
    return found.unionByName(every.select("pattern_id", "text_id"))


def _numbered(df: DataFrame, name: str) -> DataFrame:
    """Written out with a number for each row."""
    return materialise(df.withColumn(name, F.monotonically_increasing_id()))


def _in_order(firsts: DataFrame, order: tuple[str, ...]) -> DataFrame:
    """The first anomalies, written out with an ``id`` that grows with their place in the order.

    Ranges go by the beginnings of messages, since a sample of what they go by is sent to the driver.
    """
    row = F.col("row")
    ranges = firsts.repartitionByRange(*[row[name] for name in order], beginning(row["message"]))
    return _numbered(ranges.sortWithinPartitions(*[row[name] for name in (*order, *LAST)]), "id")


def _counted(ids: DataFrame) -> DataFrame:
    """Written ids as the smaller side of a join: broadcast when they were counted and are few."""
    return F.broadcast(ids) if ids.count() <= FEW_IDS else ids.hint("merge")


def _contained(texts: DataFrame, patterns: DataFrame) -> DataFrame:
    """(severity, pattern) of every pattern that a text of its severity contains."""
    patterns = _numbered(patterns.select("severity", "pattern").distinct(), "pattern_id")
    links = _links(_numbered(texts.select("severity", "text"), "text_id"), patterns)
    return patterns.join(links.hint("merge"), "pattern_id", "left_semi").select("severity", "pattern")


def first_per_pattern(anomalies: DataFrame, order: tuple[str, ...], key: DedupKey = beginning) -> DataFrame:
    """The first anomaly of each (severity, pattern), as ``row``, with the pattern.

    Partial aggregation keeps one candidate per map task, so a pattern shared by a third of all
    anomalies is no hot group (a ranking window would be). The candidate is the least struct that begins
    with the order, which holds every column once.
    """
    placed = list(dict.fromkeys((*order, *LAST)))
    others = [name for name in anomalies.columns if name not in placed]
    rows = anomalies.select(
        F.struct(*placed, *others).alias("least"),
        F.col("severity"),
        ascii_lower(key(F.col("message"))).alias("pattern"),
    )
    row = F.struct(*[F.col("least")[name].alias(name) for name in anomalies.columns])
    least = rows.groupBy("severity", "pattern").agg(F.min("least").alias("least"))
    return least.select("severity", "pattern", row.alias("row"))


def _seq(order: tuple[str, ...]) -> Column:
    """The place of a first anomaly in the order."""
    return F.struct(*[F.col("row")[name].alias(name) for name in (*order, *LAST)])


def _known(firsts: DataFrame, open_alerts: DataFrame) -> DataFrame:
    """Ids of the patterns that an open alert of the same severity contains."""
    texts = open_alerts.select("severity", ascii_lower(F.col("message")).alias("text")).distinct()
    texts = _numbered(texts, "text_id")
    patterns = firsts.select(F.col("id").alias("pattern_id"), "severity", "pattern")
    chars = texts.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    if chars <= FEW_CHARS:
        # Patterns of which the first part is in no text need no anchor.
        grams = F.broadcast(_parts_of(texts, patterns).select("gram").distinct())
        begun = _with_length(patterns).withColumn("gram", _part("pattern", "1")).join(grams, "gram", "left_semi")
        begun = begun.select(*patterns.columns)
        patterns = materialise(begun.unionByName(patterns.filter(F.col("pattern") == "")))
    return materialise(_links(texts, patterns).select(F.col("pattern_id").alias("id")).distinct())


def _blocks(firsts: DataFrame) -> DataFrame:
    """(key, by): the pattern of the anomaly ``key`` is contained in the earlier anomaly ``by``.

    Ids are in order. A pattern is unique per severity, so there is at most one row per substring of a message.
    """
    texts = firsts.select(F.col("id").alias("text_id"), "severity", ascii_lower(F.col("message")).alias("text"))
    patterns = firsts.select(F.col("id").alias("pattern_id"), "severity", "pattern")
    found = _links(texts, patterns, earlier=True)
    return found.select(F.col("pattern_id").alias("key"), F.col("text_id").alias("by"))


def _covered(firsts: DataFrame) -> DataFrame | None:
    """Ids of what an earlier kept anomaly of the same batch contains; None when there is nothing to resolve.

    First anomalies come as (id, severity, pattern, message), with ids in order.

    Whether an anomaly is kept depends on the fate of the earlier ones, so the blocking pairs are
    resolved in rounds: blocked by a kept one means dropped, blocked only by dropped ones means
    kept. Messages that contain each other's beginnings are rare, so there is usually nothing to
    resolve and no round at all. A round needs the verdicts of the last one only: pairs whose ``by`` was
    dropped go with it, and those whose ``by`` was kept go with their key.
    """
    open_pairs = materialise(_blocks(firsts))
    if open_pairs.isEmpty():
        return None
    blocked = open_pairs.select(F.col("key").alias("node")).distinct()
    free = open_pairs.select(F.col("by").alias("node")).distinct().join(blocked.hint("merge"), "node", "left_anti")
    verdict = materialise(free.withColumn("kept", F.lit(True)))
    dropped = []
    while not open_pairs.isEmpty():
        seen = open_pairs.join(verdict.withColumnRenamed("node", "by").hint("merge"), "by", "left")
        verdict = materialise(
            seen.groupBy(F.col("key").alias("node"))
            .agg(F.max("kept").alias("by_kept"), F.count_if(F.col("kept").isNull()).alias("waiting"))
            .filter(F.col("by_kept") | (F.col("waiting") == 0))
            .select("node", (~F.col("by_kept")).alias("kept"))
        )
        dropped.append(verdict.filter(~F.col("kept")).select(F.col("node").alias("id")))
        decided = verdict.select(F.col("node").alias("key")).hint("merge")
        waiting = seen.filter(F.col("kept").isNull()).select("key", "by")
        open_pairs = materialise(waiting.join(decided, "key", "left_anti"))
    return reduce(DataFrame.unionByName, dropped)


ORDER = ("detector_seq", "log_id")


def deduplicate(
    anomalies: DataFrame,
    open_alerts: DataFrame,
    order: tuple[str, ...] = ORDER,
    dedup_key: DedupKey = beginning,
) -> DataFrame:
    """The anomalies that become alerts, given the open alerts of the look-back window."""
    firsts = _in_order(first_per_pattern(anomalies, order, dedup_key), order)
    fresh = materialise(firsts.join(_counted(_known(firsts, open_alerts)), "id", "left_anti"))
    covered = _covered(fresh.select("id", "severity", "pattern", "row.message"))
    kept = fresh if covered is None else fresh.join(_counted(covered), "id", "left_anti")
    return kept.select("row.*")


def outcomes(
    anomalies: DataFrame,
    open_alerts: DataFrame,
    order: tuple[str, ...] = ORDER,
    dedup_key: DedupKey = beginning,
) -> DataFrame:
    """The anomalies with their ``outcome``, so that what was dropped can be accounted for.

    ``alert``: becomes one; ``open_alert``: an open alert contains its pattern; ``earlier_anomaly``: one
    that was kept before it in this batch does; ``same_pattern``: it shares the pattern of an anomaly
    before it, which became an alert. Anomalies that agree in everything share their outcome.
    """
    needed = list(dict.fromkeys(("severity", *order, *LAST)))
    firsts = _in_order(first_per_pattern(anomalies.select(*needed), order, dedup_key), order)
    known = _known(firsts, open_alerts)
    fresh = firsts.select("id", "severity", "pattern", "row.message").join(_counted(known), "id", "left_anti")
    covered = _covered(materialise(fresh))
    lost = known.withColumn("_lost", F.lit("open_alert"))
    if covered is not None:
        lost = lost.unionByName(covered.withColumn("_lost", F.lit("earlier_anomaly")))
    fate = firsts.join(_counted(lost), "id", "left").select(
        F.col("severity").alias("_severity"),
        F.col("pattern").alias("_pattern"),
        _seq(order).alias("_first"),
        F.coalesce("_lost", F.lit("alert")).alias("_fate"),
    )
    rows = anomalies.withColumn("_own", ascii_lower(dedup_key(F.col("message"))))
    same = F.col("severity").eqNullSafe(F.col("_severity")) & F.col("_own").eqNullSafe(F.col("_pattern"))
    met = rows.join(fate.hint("merge"), same)
    repeated = (F.col("_fate") == "alert") & ~F.struct(*order, *LAST).eqNullSafe(F.col("_first"))
    return met.select(*anomalies.columns, F.when(repeated, "same_pattern").otherwise(F.col("_fate")).alias("outcome"))
