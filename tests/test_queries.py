"""Every registered query against its SQL, on the smallest tables."""

import math
import os

import numpy as np
import pytest

from framesift import image_queries, queries

duckdb = pytest.importorskip("duckdb")
DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables here")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for f in os.listdir(DATA):
        c.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{f}'")
    return c


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "null"
    if isinstance(v, (bool, np.bool_)):
        return str(bool(v))
    if isinstance(v, (int, float, np.integer, np.floating)):
        return repr(round(float(v), 6) + 0.0)
    return str(list(v)) if isinstance(v, (list, np.ndarray)) else str(v)


def test_image_queries_are_registered():
    assert queries.QUERIES["salient_box"] is image_queries.salient_box


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_matches_sql(spark, con, name):
    got = queries.QUERIES[name](spark, DATA)
    cur = con.execute(queries.ORACLE_SQL[name])
    columns = [c[0] for c in cur.description]
    assert sorted(got.columns) == sorted(columns)
    order = sorted(columns)
    mine = sorted(tuple(plain(r[c]) for c in order) for r in got.collect())
    theirs = sorted(tuple(plain(dict(zip(columns, r))[c]) for c in order) for r in cur.fetchall())
    assert mine == theirs


def test_entry_and_registry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
