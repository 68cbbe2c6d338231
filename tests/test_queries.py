"""Registered queries of the engine against their SQL, where the test tables are there."""

import os

import duckdb
import pytest

from marlstone import queries as q

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def _rows(df):
    df = df[sorted(df.columns)]
    value = lambda v: None if v is None or v != v else f"{v:.6g}" if isinstance(v, float) else str(v).removesuffix(" 00:00:00")
    return sorted((tuple(map(value, r)) for r in df.itertuples(index=False)), key=str)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    return c


@pytest.mark.parametrize("name", [n for n in q.QUERIES if n in q.ORACLES])
def test_query(spark, duck, name):
    assert _rows(q.QUERIES[name](spark, SF).toPandas()) == _rows(duck.sql(q.ORACLES[name]).df())


@pytest.mark.parametrize("name", [n for n in q.QUERIES if n not in q.ORACLES])
def test_runs(spark, name):
    assert q.QUERIES[name](spark, SF).count() > 0
