"""Queries with SQL, on the whole small tables."""

import glob
import os

import duckdb
import pytest

import check
from dayspan.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM read_parquet('{f}')")
    return c


@pytest.mark.parametrize("name", sorted(queries.oracles()))
def test_query_equals_sql(spark, con, name):
    df = queries.queries()[name](spark, SF)
    rows = [tuple(r) for r in df.collect()]
    cur = con.execute(queries.oracles()[name])
    message, _ = check.compare(rows, df.columns, cur.fetchall(), [d[0] for d in cur.description])
    assert not message


def test_every_operator_has_a_query():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.queries()) == list(range(1, 14))
