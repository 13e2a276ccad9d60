"""Every named query against its SQL on the smallest tables."""

import glob
import os

import duckdb
import pytest

from tessera.plans import registry

QUERIES, SQL = registry()


@pytest.fixture(scope="module")
def oracle(tiny):
    c = duckdb.connect()
    for path in glob.glob(f"{tiny}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM read_parquet('{path}')")
    return c


def rows(df):
    def cell(x):
        x = x.item() if hasattr(x, "item") else x
        return None if x is None or x != x else x

    return sorted((tuple(cell(x) for x in r) for r in df[sorted(df.columns)].itertuples(index=False)), key=repr)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query(spark, tiny, oracle, name):
    got, want = QUERIES[name](spark, tiny).toPandas(), oracle.execute(SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_every_query_runs(spark, tiny):
    for name in set(QUERIES) - set(SQL):
        assert QUERIES[name](spark, tiny).count() > 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0 and set(entry.oracle_sql()) <= set(entry.queries())
