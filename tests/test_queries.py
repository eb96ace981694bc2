import glob
import math
import os

import pytest

import __spark_entry__

SF = "/root/testdata/sf0.001"


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return "NULL"
    return repr(round(v, 5) + 0.0) if isinstance(v, float) else str(v)


def table(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(plain(r[i]) for i in order) for r in rows)


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM read_parquet('{f}')")
    return con


OWN = [k for k in __spark_entry__.catalogue.QUERIES if k in __spark_entry__.catalogue.ORACLE_SQL]


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")
@pytest.mark.parametrize("name", OWN)
def test_query_agrees_with_sql(spark, duck, name):
    df = __spark_entry__.queries()[name](spark, SF)
    found = duck.execute(__spark_entry__.oracle_sql()[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == sorted(df.columns)
    assert table(df.columns, [tuple(r) for r in df.collect()]) == table(names, found.fetchall())


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")
def test_entry(spark):
    assert __spark_entry__.entry(spark).limit(1).count() == 1
