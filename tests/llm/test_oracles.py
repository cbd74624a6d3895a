"""The SQL of this package's queries on the same files, values and types alike."""

import duckdb
import pytest

from tallyspark.llm.oracles import ORACLE_SQL
from tallyspark.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"
TYPES = {"bigint": "BIGINT", "string": "VARCHAR", "boolean": "BOOLEAN", "double": "DOUBLE", "int": "INTEGER"}


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_matches_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "embeddings", "pages"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    want = con.execute(ORACLE_SQL[name])
    columns = [d[0] for d in want.description]
    kinds = dict(zip(columns, [str(d[1]) for d in want.description]))
    got = QUERIES[name](spark, SF).select(*columns)
    assert {c: TYPES[t] for c, t in got.dtypes} == kinds
    rows = want.fetchall()
    assert sorted(map(repr, rows)) == sorted(repr(tuple(r)) for r in got.collect()) and rows
