"""Every query with SQL against DuckDB on the smallest tables, and that the others run."""

import os

import duckdb
import pytest

from scriptora import registry

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in os.listdir(SF):
        if f.endswith(".parquet"):
            c.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{SF}/{f}'")
    return c


def plain(v):
    return round(v, 6) if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, duck, name):
    df = registry.queries()[name](spark, SF)
    rows = df.collect()
    if name not in registry.oracle_sql():
        assert rows
        return
    want = duck.sql(registry.oracle_sql()[name])
    cols = sorted(want.columns)
    assert sorted(df.columns) == cols
    at = [want.columns.index(c) for c in cols]
    key = lambda r: tuple(map(str, r))
    assert sorted((tuple(plain(r[c]) for c in cols) for r in rows), key=key) == sorted((tuple(plain(r[i]) for i in at) for r in want.fetchall()), key=key)


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
