"""The pipeline, and the registered queries against DuckDB."""

import hashlib

import duckdb
import pytest
from pyspark.sql import functions as F

import check
import corpus_pipeline
from logquarry.llm import queries

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    connection = duckdb.connect()
    for table in ("documents", "benchmark", "pages", "embeddings"):
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF_DIR}/{table}.parquet'")
    return connection


@pytest.mark.parametrize("name", sorted(queries.all_sql()))
def test_query_matches_sql(spark, db, name):
    outcome = check.compare(spark, db, name, SF_DIR)
    assert not outcome.startswith("FAIL"), outcome


def test_stages_keep_the_columns(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").withColumn("score", F.lit(1)).withColumn("chunk", F.lit("c"))
    rows = docs.count()
    for _, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, docs, SF_DIR)
        assert tuple(kept.columns) == corpus_pipeline.COLUMNS
        assert 0 < kept.count() <= rows


def test_stages_take_effect(spark):
    line = "the very same line in three documents"
    prose = " ".join(f"word{i}" for i in range(200))
    item = spark.read.parquet(f"{SF_DIR}/benchmark.parquet").orderBy("item_id").first().text
    texts = {1: f"one {line}", 2: f"{line}\nb", 3: f"{line}\nc", 4: f"{line}\nd", 5: prose, 6: prose + " x", 7: f"so {item} there", 8: "12 34", 9: None}
    rows = [(i, t, "en", "s", len(t or "")) for i, t in texts.items()]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    stages = dict(corpus_pipeline.STAGES)
    assert {r.doc_id for r in stages["language_id"](spark, docs, SF_DIR).collect()} == set(range(1, 8))
    assert {r.doc_id: r.text for r in stages["line_dedup"](spark, docs, SF_DIR).collect()}[2] == "b"
    assert {r.doc_id for r in stages["near_dedup"](spark, docs, SF_DIR).collect()} == {1, 2, 3, 4, 5, 7, 8, 9}
    assert {r.doc_id for r in stages["decontamination"](spark, docs, SF_DIR).collect()} == set(texts) - {7}


LINE = "the very same line in several documents"
PROSE = " ".join(f"word{i}" for i in range(60))
LONG = "solo " * 200_000


@pytest.fixture(scope="module")
def odd(spark):
    """Repeated rows, rows without an id, nulls, an empty and a long text, and columns named like those of operators."""
    item = spark.read.parquet(f"{SF_DIR}/benchmark.parquet").orderBy("item_id").first().text
    rows = [(1, f"a\n{LINE}", "en", "s", 1)] * 2 + [(2, f"b\n{LINE}", None, None, None)] + [(None, f"c\n{LINE}", "en", "s", 1)] * 2
    rows += [(3, PROSE, "en", "s", 1)] * 2 + [(None, PROSE, "en", None, 1)] + [(4, None, None, None, None)] * 2
    rows += [(5, "", None, "s", 0), (None, item, None, None, None), (6, LONG, "en", "s", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    for name in ("score", "lang_pred", "kept", "first", "component_id", "chunk", "n_lines", "ids", "decoded"):
        df = df.withColumn(name, F.lit("x"))
    return df.cache()


def texts(df):
    return sorted(((r.doc_id, r.text) for r in df.collect()), key=repr)


def test_stages_on_odd_rows(spark, odd):
    stages = dict(corpus_pipeline.STAGES)
    given = texts(odd)
    assert texts(stages["language_id"](spark, odd, SF_DIR)) == [(i, t) for i, t in given if t]
    without = {f"a\n{LINE}": "a", f"c\n{LINE}": "c", None: ""}
    want = [(i, without.get(t, t)) for i, t in given]
    item = next(t for i, t in given if t and i is None and t != PROSE and LINE not in t)
    # The lines of the item are in one row only; the row of the largest id, 2, keeps the shared line.
    lines = texts(stages["line_dedup"](spark, odd, SF_DIR))
    assert [x for x in lines if x[1] != item and x[0] is not None] == sorted([x for x in want if x[0] is not None], key=repr)
    assert [x[1] for x in lines if x[0] is None].count("c") == 2
    # PROSE stands in three rows as well, so only the one with an id keeps it.
    assert (None, "") in lines and lines.count((3, PROSE)) == 2
    near = texts(stages["near_dedup"](spark, odd, SF_DIR))
    assert near == sorted([*{x for x in given if x[1] and x != (None, PROSE)}, (4, None), (4, None), (5, "")], key=repr)
    clean = texts(stages["decontamination"](spark, odd, SF_DIR))
    assert clean == [x for x in given if x[1] != item]
    tokens = stages["tokenise"](spark, odd, SF_DIR).collect()
    hashes = sorted(hashlib.sha256((t or "").encode()).hexdigest() for _, t in given)
    assert sorted(r.decoded_sha256 for r in tokens) == hashes
    assert {r.n_tokens for r in tokens if r.doc_id in (4, 5)} == {0}


def test_stages_on_an_empty_table(spark, odd):
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, odd.limit(0), SF_DIR).count() == 0, name


def test_languages_without_labels(spark, odd):
    """Nothing can be told, so all texts with letters stay."""
    kept = corpus_pipeline.language_id(spark, odd.withColumn("lang", F.lit(None).cast("string")), SF_DIR)
    assert texts(kept) == [x for x in texts(odd) if x[1]]


def test_pipeline_runs(spark):
    rows = corpus_pipeline.run(spark, SF_DIR).collect()
    assert rows and all(len(r.ids) == 4 * r.n_tokens for r in rows)
    assert corpus_pipeline.run(spark, SF_DIR).count() == len(rows)
