"""Each registered query with SQL gives the rows of that SQL, on the smallest tables."""

import datetime
import math

import duckdb
import pytest

from quernel.plans.registry import QUERIES, SQL

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def value(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, (list, tuple)):
        return tuple(map(value, v))
    if isinstance(v, (datetime.date, datetime.datetime)):
        return str(v)
    if isinstance(v, str):
        return v
    return round(float(v), 6) + 0.0


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    c.execute("SET TimeZone='UTC'")
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows(spark, sf, con, name):
    df = QUERIES[name](spark, sf)
    got = df.collect()
    result = con.execute(SQL[name])
    columns = [c[0] for c in result.description]
    assert sorted(columns) == sorted(df.columns)
    want = [dict(zip(columns, r)) for r in result.fetchall()]
    order = sorted(columns)
    rows = lambda rs: sorted((tuple(value(r[c]) for c in order) for r in rs), key=repr)
    assert rows([r.asDict() for r in got]) == rows(want)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, sf, name):
    df = QUERIES[name](spark, sf)
    assert df.columns and df.count() >= 0
