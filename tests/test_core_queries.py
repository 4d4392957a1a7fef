import glob
import math
import os
import re

import duckdb
import pytest

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
CORE = [n for n in entry.oracle_sql() if not re.match(r"p(?!5_)\d+_", n)]


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    if hasattr(v, "isoformat"):
        return v.isoformat()
    return round(v, 9) if isinstance(v, float) else tuple(map(plain, v)) if isinstance(v, list | tuple) else v


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for f in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


@pytest.mark.parametrize("name", CORE)
def test_query_equals_sql(spark, duck, name):
    df = entry.queries()[name](spark, DATA)
    columns = sorted(df.columns)
    ours = sorted(repr(tuple(plain(r[c]) for c in columns)) for r in df.collect())
    got = duck.execute(entry.oracle_sql()[name])
    names = [d[0] for d in got.description]
    assert sorted(names) == columns
    theirs = sorted(repr(tuple(plain(r[names.index(c)]) for c in columns)) for r in got.fetchall())
    assert ours == theirs


def test_entry(spark):
    assert entry.entry(spark).count() >= 0
