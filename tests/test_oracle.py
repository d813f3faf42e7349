"""Every registered query that has SQL gives the same rows as DuckDB."""

import re

import pytest

import __spark_entry__ as entry
from check import compare, duck
from dayspan.plans import registry

ORACLES = registry.oracles()  # the text queries have tests of their own

# Queries whose work is numeric code over Arrow batches; all others stay in Spark expressions.
PYTHON = {"pair_dtw", "knn_classify", "dbscan", "dbscan_labels"}


@pytest.fixture(scope="module")
def con(sf):
    return duck(sf)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_as_sql(spark, sf, con, name):
    df = entry.queries()[name](spark, sf)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    assert name in PYTHON or not re.search("ArrowEvalPython|BatchEvalPython|InPandas|InArrow", plan)
    rows = [tuple(r) for r in df.collect()]
    cur = con.execute(ORACLES[name])
    message, _ = compare(rows, df.columns, cur.fetchall(), [d[0] for d in cur.description])
    assert not message, message


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0


def test_sql_only_for_registered_names():
    assert set(ORACLES) <= set(entry.queries())
