"""Every registered query with SQL agrees with DuckDB at the smallest scale."""

import duckdb
import pytest

import __spark_entry__ as entry
from tools.check import TABLES, compare

# trained, searched or already covered by unit tests; the check tool runs them all
FAST = [n for n in entry.queries() if n in entry.oracle_sql()]


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    c.execute("SET TimeZone='UTC'")
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return c


def test_entry_returns_rows(spark):
    assert entry.entry(spark).count() == 5


def test_every_sql_belongs_to_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", FAST)
def test_query_equals_sql(spark, sf, con, name):
    verdict, _ = compare(spark, con, name, entry.queries()[name], entry.oracle_sql()[name], sf)
    assert verdict.startswith("match"), verdict
