"""A training corpus from ``documents``: five stages, each on what the one before kept.

Every stage takes (spark, docs, sf_dir). All but the last return the columns of ``documents``; the
last returns the token ids. ``run`` writes each stage to the shared scratch folder and reads it again.

In every stage an empty table gives an empty table, extra columns go whatever their names, and texts are
taken whole, however long. Rows without an id, without a language, source or length, and rows that repeat
are rows like others, but for what the stages say.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logquarry.llm import blocks, bpe, decontaminate, langid, linededup, neardup

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
# Least probability of the predicted language for a document to stay.
LEAST_SCORE = 0.5
SIMILARITY = 80


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that is told with LEAST_SCORE or more; those without letters go.

    The classifier learns from a bounded sample of the rows that have a ``lang``. If there is none,
    nothing can be told and only texts without letters go. Null and empty texts have no letters.
    """
    model = langid.train(docs)
    if model.isEmpty():
        return docs.select(*COLUMNS).filter(F.col("text").rlike(r"\p{L}"))
    found = langid.predict(docs, model, keep=COLUMNS)
    return found.filter((F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= LEAST_SCORE)).select(*COLUMNS)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that three or more of them share; ``n_chars`` follows.

    Rows that repeat are documents of their own, and all that have the largest id keep a shared line. A
    row without an id comes before all others. A null text becomes an empty one.
    """
    found = linededup.drop_common_lines(docs, keep=("lang", "source"))
    return found.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: a row with the smallest id.

    Of rows that repeat it one stays; a row without an id stays only in a group without ids. Texts without
    words, null ones too, are near nothing, not even each other, and all stay.
    """
    found = neardup.near_duplicates(docs, SIMILARITY, keep=("text", "lang", "source", "n_chars"))
    return found.filter("first").select(*COLUMNS)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no window of a benchmark item occurs; null and empty texts hold none.

    Items without an id count like others.
    """
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontaminate.clean(docs.select(*COLUMNS), items, remove="documents", unnamed=True)


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids, decoded_sha256): ids as little-endian 32-bit integers, and their decoding.

    One row per document; a null text is encoded like an empty one.
    """
    import public_tokenizers

    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    decoded = bpe.decode(bpe.encode(docs, ranks, public_tokenizers.PATTERN), ranks)
    return decoded.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        "ids",
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("tokenise", tokenise),
]

# The classifier and the merges have no SQL form; tests hold the stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``."""
    docs = blocks.prepare(spark).read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = blocks.written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
