"""Every query with SQL gives the rows of that SQL."""

import glob
import os

import duckdb
import pytest

from meshframe import registry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return con


def _rows(rows):
    return sorted(tuple(f"{x + 0.0:.5f}" if isinstance(x, float) else str(x) for x in r) for r in rows)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query(spark, duck, name):
    df = registry.queries()[name](spark, SF)
    cols = sorted(df.columns)
    got = [tuple(r) for r in df.select(*cols).collect()]
    want = duck.sql(registry.oracle_sql()[name])
    names = want.columns
    assert sorted(names) == cols
    assert _rows(got) == _rows([tuple(r[names.index(c)] for c in cols) for r in want.fetchall()])
