"""Every registered reference query against its SQL oracle on the smallest tables."""

import duckdb
import pytest

from delvegraph import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return c


def norm(rows):
    return sorted(tuple(repr(x) for x in r) for r in rows)


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_equals_oracle(spark, sf, con, name):
    df = catalog.queries()[name](spark, sf)
    cols = sorted(df.columns)
    want = con.sql(catalog.oracle_sql()[name])
    assert sorted(want.columns) == cols
    got = norm(tuple(r) for r in df.select(*cols).collect())
    assert got == norm(want.project(", ".join(f'"{c}"' for c in cols)).fetchall())


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql())))
def test_query_without_oracle_runs(spark, sf, name):
    assert catalog.queries()[name](spark, sf).columns


def test_entry_has_rows(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() >= 0
