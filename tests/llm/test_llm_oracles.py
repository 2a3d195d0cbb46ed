"""The training-data queries that SQL can express, against DuckDB on the smallest tables."""

import duckdb
import pytest

from delvegraph.llm import queries as Q

TABLES = "documents embeddings benchmark".split()


@pytest.mark.parametrize("name", sorted(Q.oracle_sql()))
def test_query_equals_oracle(spark, sf, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    df = Q.queries()[name](spark, sf)
    cols = sorted(df.columns)
    want = con.sql(Q.oracle_sql()[name])
    assert sorted(want.columns) == cols
    norm = lambda rows: sorted(tuple(repr(x) for x in r) for r in rows)
    assert norm(tuple(r) for r in df.select(*cols).collect()) == norm(want.project(", ".join(cols)).fetchall())
