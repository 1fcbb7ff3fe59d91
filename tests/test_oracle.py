"""Registered queries against their DuckDB SQL on the smallest tables."""

import os

import duckdb
import pytest

from millrace import extra_queries, more_queries, plan_queries  # noqa: F401
from millrace.queries import ORACLE, QUERIES

DATA = "/root/testdata/sf0.001"


def shown(v):
    return f"{v:.9g}" if isinstance(v, float) else str(v)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
@pytest.mark.parametrize("name", sorted(ORACLE.keys() & QUERIES.keys()))
def test_query(spark, name):
    df = QUERIES[name](spark, DATA)
    rows, columns = df.collect(), sorted(df.columns)
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.sql(f"create view {f.removesuffix('.parquet')} as select * from '{DATA}/{f}'")
    r = con.sql(ORACLE[name])
    assert sorted(r.columns) == columns
    at = [r.columns.index(c) for c in columns]
    assert sorted(tuple(shown(x[c]) for c in columns) for x in rows) == sorted(tuple(shown(x[i]) for i in at) for x in r.fetchall())
