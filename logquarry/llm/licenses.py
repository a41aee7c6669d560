"""Licence scans: normalised text against licence templates by the Dice coefficient of word bigrams.

Parts of a text are compared: the whole text, its paragraphs (between blank lines) and its lines. A part
or template is lower-cased, everything but letters and digits separates words, and its set of word
bigrams is taken. Dice is 2 * shared / (bigrams of the part + bigrams of the template). A coefficient of
``least`` needs sizes within least / (2 - least) of each other, so only templates whose size fits are
compared; most parts fit none.

With ``runs`` a licence that no part matches is looked for in runs of consecutive lines as well, so also
in runs of paragraphs: a published text of several paragraphs inside a longer document, or one with other
text directly before or after it. A run can only match when the whole text holds least / (2 - least) of
the bigrams of the template, so the runs of few texts are looked at. Runs have as many words as the bounds
allow for the words of the template; lines without words do not count.

All of it is one projection of DataFrame functions: no shuffle, no join and no Python. Templates are a
constant of the expression; MAX_TEMPLATES and MAX_BIGRAMS bound it. Bigrams are compared by 64-bit
hash, of word hashes.

Defined results: null and empty texts and parts of less than two words match nothing. Of equal best
coefficients the licence that is last in alphabetical order is named. Repeated rows and repeated parts
are looked at each by itself; a part that is paragraph and line and whole text counts once. A null
``doc_id`` is kept, other columns are not looked at, an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logquarry.llm import blocks as B
from logquarry.llm.license_texts import TEMPLATES

LEAST = 0.9
MAX_TEMPLATES = 500
MAX_BIGRAMS = 100_000
# Words of a run per distinct bigram: texts say some pairs of words twice.
REPEATED = 1.5


def bigrams(text: Column) -> Column:
    """Distinct word bigrams of a text, as hashes."""
    words = F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    # The words pass a one-element array, so that they are split once.
    pairs = F.transform(
        F.array(words),
        lambda w: F.zip_with(
            F.slice(w, 1, F.greatest(F.size(w) - 1, F.lit(0))), F.slice(w, 2, F.greatest(F.size(w) - 1, F.lit(0))), lambda a, b: F.xxhash64(a, b)
        ),
    )
    return F.array_distinct(F.element_at(pairs, 1))


def template_bigrams(spark, templates: dict[str, list[str]]) -> list[tuple[str, list[int]]]:
    """(name, bigram hashes) of every template with at least one bigram."""
    rows = [(name, text) for name, texts in sorted(templates.items()) for text in texts]
    if len(rows) > MAX_TEMPLATES:
        raise ValueError(f"more than {MAX_TEMPLATES} templates")
    found = spark.createDataFrame(rows, "name string, text string").select("name", bigrams(F.col("text")).alias("grams")).collect()
    if sum(len(row.grams) for row in found) > MAX_BIGRAMS:
        raise ValueError(f"more than {MAX_BIGRAMS} template bigrams")
    return [(row.name, row.grams) for row in found if row.grams]


def run_matches(text: Column, grams: Column, names: Column, known: list[tuple[str, list[int]]], least: float) -> Column:
    """(dice, name) of every template with another name than ``names`` that a run of lines matches best."""
    templates = F.array(
        *(
            F.struct(F.lit(name).alias("name"), F.array(*map(F.lit, own)).alias("grams"), F.lit(len(own) * least / (2 - least)).alias("low"), F.lit(int((len(own) + 1) * (2 - least) / least * REPEATED)).alias("high"))
            for name, own in known
        )
    )
    shared = F.array_intersect(grams, F.array(*map(F.lit, sorted({g for _, own in known for g in own}))))
    likely = F.transform(
        F.array(shared),
        lambda s: F.filter(templates, lambda t: ~F.array_contains(names, t["name"]) & (F.size(F.array_intersect(t["grams"], s)) >= t["low"])),
    )[0]
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[\p{L}\p{N}]"))
    counted = F.transform(lines, lambda x: F.struct(x.alias("line"), F.size(F.filter(F.split(x, r"[^\p{L}\p{N}]+"), lambda w: w != "")).alias("n")))

    def best(rows: Column, t: Column) -> Column:
        def lengths(i: Column) -> Column:
            """Numbers of lines from line i on whose words are within the bounds."""
            none = F.struct(F.lit(0).alias("k"), F.lit(0).alias("words"), F.array().cast("array<int>").alias("fit"))

            def step(state: Column, row: Column) -> Column:
                k, words = state["k"] + 1, state["words"] + row["n"]
                fits = (words > t["low"]) & (words <= t["high"])
                return F.struct(k.alias("k"), words.alias("words"), F.when(fits, F.concat(state["fit"], F.array(k))).otherwise(state["fit"]).alias("fit"))

            return F.aggregate(F.slice(rows, i, t["high"]), none, step)["fit"]

        def dice(i: Column, k: Column) -> Column:
            own = bigrams(F.array_join(F.transform(F.slice(rows, i, k), lambda r: r["line"]), "\n"))
            return F.transform(F.array(own), lambda g: 2.0 * F.size(F.array_intersect(g, t["grams"])) / (F.size(g) + F.size(t["grams"])))[0]

        return F.array_max(F.flatten(F.transform(F.sequence(F.lit(1), F.size(rows)), lambda i: F.transform(lengths(i), lambda k: dice(i, k)))))

    found = F.transform(F.array(counted), lambda rows: F.transform(likely, lambda t: F.struct(best(rows, t).alias("dice"), t["name"].alias("name"))))[0]
    none = F.array().cast("array<struct<dice:double,name:string>>")
    return F.when(F.size(likely) > 0, F.filter(found, lambda m: m["dice"] >= least)).otherwise(none)


def scan(docs: DataFrame, templates: dict[str, list[str]] | None = None, least: float = LEAST, runs: bool = False) -> DataFrame:
    """(doc_id, n_matches, licenses, license, dice) of every document.

    ``n_matches`` parts match a template by ``least`` or more, ``licenses`` are the names they match,
    ``license`` and ``dice`` the best of all. With ``runs`` a template that only a run of lines matches
    counts as one more match.
    """
    spark = B.prepare(docs.sparkSession)
    known = template_bigrams(spark, TEMPLATES if templates is None else templates)
    lowest = min((len(grams) for _, grams in known), default=1) * least / (2 - least)
    highest = max((len(grams) for _, grams in known), default=0) * (2 - least) / least
    text = F.coalesce("text", F.lit(""))
    parts = F.array_distinct(F.concat(F.array(text), F.split(text, r"\n[ \t\r]*\n"), F.split(text, "\n")))
    sets = F.filter("grams", lambda g: F.size(g).between(lowest, highest))

    def matches(grams: Column) -> Column:
        """(dice, name) of every template whose size fits, null where it is too different."""
        found = []
        for name, own in known:
            n = len(own)
            dice = 2.0 * F.size(F.array_intersect(grams, F.array(*map(F.lit, own)))) / (F.size(grams) + n)
            fits = F.size(grams).between(n * least / (2 - least), n * (2 - least) / least)
            found.append(F.when(fits, F.struct(dice.alias("dice"), F.lit(name).alias("name"))))
        return F.filter(F.array(*found), lambda m: m.isNotNull() & (m["dice"] >= least))

    if not known:
        hits = F.array().cast("array<array<struct<dice:double,name:string>>>")
    else:
        hits = F.filter(F.transform("sets", matches), lambda m: F.size(m) > 0)
    # The whole text is the first part.
    found = docs.select("doc_id", text.alias("text"), F.transform(parts, bigrams).alias("grams"))
    found = found.select("doc_id", "text", F.col("grams")[0].alias("whole"), sets.alias("sets")).select("doc_id", "text", "whole", hits.alias("hits"))
    named = found.select("doc_id", "text", "whole", F.size("hits").cast("long").alias("n_matches"), F.flatten("hits").alias("all"))
    if runs and known:
        more = run_matches(F.col("text"), F.col("whole"), F.transform("all", lambda m: m["name"]), known, least)
        named = named.select("doc_id", "n_matches", "all", more.alias("more"))
        named = named.select("doc_id", (F.col("n_matches") + F.size("more")).alias("n_matches"), F.concat("all", "more").alias("all"))
    best = F.array_max("all")
    return named.select(
        "doc_id",
        "n_matches",
        F.array_sort(F.array_distinct(F.transform("all", lambda m: m["name"]))).alias("licenses"),
        best["name"].alias("license"),
        best["dice"].alias("dice"),
    )
