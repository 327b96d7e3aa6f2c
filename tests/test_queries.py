"""Every registered query on the smallest data, against its SQL where it has one."""

import glob
import math
import os

import duckdb
import pytest

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data here")


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return ""
    return f"{v:.9g}" if isinstance(v, float) else str(v)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        c.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query(spark, con, name):
    df = entry.queries()[name](spark, DATA)
    columns = sorted(df.columns)
    rows = sorted(tuple(plain(r[c]) for c in columns) for r in df.collect())
    if sql := entry.oracle_sql().get(name):
        want = con.sql(sql)
        assert sorted(want.columns) == columns
        at = [want.columns.index(c) for c in columns]
        assert rows == sorted(tuple(plain(r[i]) for i in at) for r in want.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_core_does_not_import_the_subpackage():
    root = os.path.dirname(entry.__file__)
    for path in glob.glob(f"{root}/proofmill/**/*.py", recursive=True):
        if "/llm/" not in path:
            assert "proofmill.llm" not in open(path).read(), path
