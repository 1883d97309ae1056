"""Every query runs on the smallest tables, and agrees with its SQL there."""

import glob
import os

import pytest

import __spark_entry__ as entry

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="the tables are not here")


@pytest.fixture(scope="module")
def sql():
    duckdb = pytest.importorskip("duckdb")
    c = duckdb.connect()
    for f in glob.glob(f"{FOLDER}/*.parquet"):
        c.sql(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return c


def _plain(v):
    return repr(round(v, 6)) if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query(spark, sql, name):
    df = entry.queries()[name](spark, FOLDER)
    cols = sorted(df.columns)
    got = sorted(tuple(_plain(r[c]) for c in cols) for r in df.collect())
    if name in entry.oracle_sql():
        rel = sql.sql(entry.oracle_sql()[name])
        names = rel.columns
        assert sorted(names) == cols
        at = [names.index(c) for c in cols]
        assert got == sorted(tuple(_plain(r[k]) for k in at) for r in rel.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
