"""Every registered query with SQL against DuckDB on the smallest tables; the others give rows."""

import math
import os

import duckdb
import pytest

from tessera import plans

DATA = "/root/testdata/sf0.001"


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, list | tuple):
        return tuple(map(plain, v))
    if isinstance(v, bool) or isinstance(v, str | bytes):
        return v
    return round(float(v), 6)


def rows(names, values):
    order = sorted(range(len(names)), key=lambda k: names[k])
    return sorted((tuple(plain(r[k]) for k in order) for r in values), key=repr)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(plans.QUERIES))
def test_query(spark, duck, name):
    df = plans.QUERIES[name](spark, DATA)
    got = rows(df.columns, df.collect())
    if name in plans.ORACLE_SQL:
        r = duck.execute(plans.ORACLE_SQL[name])
        names = [c[0] for c in r.description]
        assert sorted(names) == sorted(df.columns)
        assert got == rows(names, r.fetchall())
    else:
        assert got
