"""Every query with SQL, against that SQL, at the smallest scale."""

import duckdb
import pytest

import __spark_entry__ as entry
from compare import SMALLEST, TABLES, rows


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{SMALLEST}/{table}.parquet')")
    return con


@pytest.mark.parametrize("name", list(entry.oracle_sql()))
def test_query_matches_sql(spark, db, name):
    df = entry.queries()[name](spark, SMALLEST)
    result = db.execute(entry.oracle_sql()[name])
    columns = [c[0] for c in result.description]
    assert sorted(columns) == sorted(df.columns)
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == rows(columns, result.fetchall())


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0
