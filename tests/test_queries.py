"""Every query with SQL gives the same rows in both engines."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from claimlens.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.execute(f"create view {f[:-8]} as select * from '{SF}/{f}'")
    return c


def same(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    return round(v, 6) if isinstance(v, float) else int(v) if isinstance(v, (bool, int)) else str(v)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_rows_match(spark, con, name):
    df = QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted((tuple(map(same, r)) for r in df.select(cols).collect()), key=str)
    r = con.execute(ORACLES[name])
    names = [c[0] for c in r.description]
    assert sorted(names) == cols
    at = [names.index(c) for c in cols]
    assert got == sorted((tuple(same(row[i]) for i in at) for row in r.fetchall()), key=str)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(ORACLES) <= set(entry.queries())
