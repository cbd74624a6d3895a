"""Every registered query against DuckDB on the same files."""

import duckdb
import pytest

import __spark_entry__ as contract
from tallyspark.sources.tables import SCHEMAS

SF_DIR = "/root/testdata/sf0.01"


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(repr(tuple(r[i] for i in order)) for r in rows)


@pytest.mark.parametrize("name", sorted(n for n in contract.oracle_sql() if n != "pipeline" and not n.startswith("op")))
def test_matches_sql(spark, name):
    con = duckdb.connect()
    for table in SCHEMAS:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF_DIR}/{table}.parquet'")
    want = con.execute(contract.oracle_sql()[name])
    want_columns = [d[0] for d in want.description]
    got = contract.queries()[name](spark, SF_DIR)
    assert sorted(got.columns) == sorted(want_columns)
    assert _rows(got.columns, got.collect()) == _rows(want_columns, want.fetchall())


def test_entry(spark):
    assert contract.entry(spark).count() > 0
