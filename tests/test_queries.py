import duckdb
import pytest

import __spark_entry__ as entry
import check
from logquarry.plans import oracle, queries

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    connection = duckdb.connect()
    for table in ("events", "documents"):
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF_DIR}/{table}.parquet'")
    return connection


def test_flagship(spark):
    assert entry.entry(spark).count() > 0


def test_every_query_has_sql():
    assert set(queries.all_queries()) == set(oracle.all_sql())
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_look_back_ends_at_as_of(spark):
    """Five errors lie in the five minutes; hundreds come after them."""
    row = queries.all_queries()["error_burst"](spark, "/root/testdata/sf0.01").first()
    assert (row.error_count, row.errors_per_minute) == (5, 1.0)


@pytest.mark.parametrize("name", sorted(queries.all_queries()))
def test_query_matches_sql(spark, db, name):
    outcome = check.compare(spark, db, name, SF_DIR)
    assert not outcome.startswith("FAIL"), outcome
