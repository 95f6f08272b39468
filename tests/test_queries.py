"""Registered queries against their SQL on the smallest tables."""

import math

import duckdb
import pytest

import __spark_entry__ as entry_module
from tests.conftest import SF
from workload import queries as workload_queries

ORACLES = {k: v for k, v in entry_module.oracle_sql().items() if k in workload_queries.QUERIES}
QUERIES = {k: v for k, v in entry_module.queries().items() if k in workload_queries.QUERIES}


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for t in ("customer", "events", "embeddings", "orders"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def plain(row):
    out = []
    for v in row:
        if v is None or (isinstance(v, float) and math.isnan(v)):
            out.append(None)
        elif isinstance(v, float):
            out.append(round(v, 9))
        else:
            out.append(v)
    return tuple(out)


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sql, name):
    got = QUERIES[name](spark, SF)
    names = sorted(got.columns)
    cur = sql.execute(ORACLES[name])
    have = [d[0] for d in cur.description]
    assert sorted(have) == names
    place = [have.index(n) for n in names]
    want = sorted((plain([r[i] for i in place]) for r in cur.fetchall()), key=repr)
    mine = sorted((plain(r) for r in got.select(*[f"`{n}`" for n in names]).collect()), key=repr)
    assert len(mine) == len(want)
    assert mine == want


def test_entry(spark):
    assert entry_module.entry(spark).count() == 150
