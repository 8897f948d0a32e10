"""Every registered query of the reference's operators against its SQL on the smallest tables."""

import glob
import os

import duckdb
import pytest

from tidewheel.plans import queries as Q
from tidewheel.plans import sql_queries as S

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return con


def cell(v):
    if v is None or (isinstance(v, float) and v != v):
        return None
    if isinstance(v, float):
        return float(f"{v:.9g}")
    return float(v) if type(v).__name__ == "Decimal" else v


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(cell(r[i]) for i in order) for r in data), key=lambda r: tuple((v is not None, str(v)) for v in r))


@pytest.mark.parametrize("name", sorted(Q.QUERIES))
def test_same_rows(spark, duck, name):
    df = Q.QUERIES[name](spark, DATA)
    got = rows(df.columns, df.collect())
    if name in Q.SQL:
        cur = duck.execute(Q.SQL[name])
        names = [d[0] for d in cur.description]
        assert sorted(df.columns) == sorted(names)
        assert got == rows(names, cur.fetchall())


@pytest.mark.parametrize("name", sorted(S.QUERIES))
def test_statements_give_the_same_rows(spark, duck, name):
    df = S.QUERIES[name](spark, DATA)
    got = rows(df.columns, df.collect())
    cur = duck.execute(S.SQL[name])
    names = [d[0] for d in cur.description]
    assert sorted(df.columns) == sorted(names)
    assert got == rows(names, cur.fetchall())
