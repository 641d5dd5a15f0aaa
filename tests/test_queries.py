"""Every registered query against its DuckDB counterpart, at the smallest scale."""

import os
from numbers import Number

import duckdb
import pandas as pd
import pytest

from tempograph.queries import FLAGSHIP, ORACLES, QUERIES

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="the test tables are not here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{DIR}/{t}.parquet'")
    return con


def plain(x):
    if x is None or x is pd.NaT or x is pd.NA or (isinstance(x, float) and x != x):
        return None
    return round(float(x), 5) + 0.0 if isinstance(x, Number) and not isinstance(x, bool) else x


def rows(frame):
    names = sorted(frame.columns)
    return names, sorted((tuple(map(plain, r)) for r in frame[names].itertuples(index=False, name=None)), key=str)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    got = QUERIES[name](spark, DIR).toPandas()
    if name not in ORACLES:
        assert len(got)
        return
    assert rows(got) == rows(duck.sql(ORACLES[name]).df())


def test_flagship_is_registered():
    assert FLAGSHIP in QUERIES and len(ORACLES) >= 80
