import glob
import os
import re

import duckdb
import pytest

from corpusloom.llm import queries as Q

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
COLUMNS = {
    "p1_found": ["group_id", "scan_row_id"], "p2_found": ["conv_id"], "p3_found": ["conv_a", "conv_b"], "p4_found": ["defect", "rec_id", "src"],
    "p6_found": ["conv_id"], "p8_ids": ["doc_id", "ids"], "p10_found": ["doc_id"],
}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for f in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


@pytest.mark.parametrize("name", sorted(Q.SQL))
def test_query_equals_sql(spark, duck, name):
    df = Q.QUERIES[name](spark, DATA)
    got = duck.execute(Q.SQL[name])
    names = [d[0] for d in got.description]
    assert sorted(map(tuple, df.select(*names).collect())) == sorted(got.fetchall())


@pytest.mark.parametrize("name", sorted(set(Q.QUERIES) - set(Q.SQL)))
def test_query_runs_over_its_table(spark, name):
    df = Q.QUERIES[name](spark, DATA)
    if name in COLUMNS:
        assert sorted(df.columns) == COLUMNS[name]
    rows = df.collect()
    assert rows
    if name.endswith("_found"):
        assert len(set(rows)) == len(rows)
    if name == "p8_ids":
        assert len(rows) == spark.read.parquet(f"{DATA}/documents.parquet").count()


def test_every_problem_of_the_subpackage_has_a_query():
    assert {re.match(r"p(\d+)_", n)[1] for n in Q.QUERIES} == {"1", "2", "3", "4", "6", "7", "8", "9", "10"}
