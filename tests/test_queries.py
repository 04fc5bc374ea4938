"""Every registered query of the core with SQL, against DuckDB on the smallest tables."""

import math
import os
from collections import Counter

import pytest

from crosslattice.plans import catalogue, problems, studies

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables here")
QUERIES, SQL = ({k: v for m in (catalogue, problems, studies) for k, v in x(m).items()} for x in (lambda m: m.QUERIES, lambda m: m.SQL))


@pytest.fixture(scope="module")
def duck():
    import duckdb

    c = duckdb.connect()
    for t in os.listdir(FOLDER):
        c.execute(f"CREATE VIEW {t[:-8]} AS SELECT * FROM '{FOLDER}/{t}'")
    return c


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6) + 0.0
    return v


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, duck, name):
    df = QUERIES[name](spark, FOLDER)
    columns = sorted(df.columns)
    got = Counter(repr(tuple(plain(x) for x in r)) for r in df.select(*columns).collect())
    r = duck.execute(SQL[name])
    at = [[x[0] for x in r.description].index(c) for c in columns]
    assert sorted(x[0] for x in r.description) == columns
    assert got == Counter(repr(tuple(plain(x[i]) for i in at)) for x in r.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_runs(spark, name):
    assert QUERIES[name](spark, FOLDER).count() >= 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() >= 1
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
