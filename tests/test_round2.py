"""Wide tables, repeated days and keys, one scan for all pairs."""

from itertools import combinations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from dayspan.operators import aggregate as ag
from dayspan.operators import correlation as co
from dayspan.operators import merge as mg
from dayspan.operators import timeline as tl


def test_subsets_of_seventeen_columns(spark):
    rng = np.random.default_rng(1)
    cols = [f"c{i}" for i in range(17)]
    data = pd.DataFrame(np.where(rng.random((60, 17)) < 0.6, 1.0, np.nan), columns=cols)
    data["num_id"] = np.arange(60) // 6
    df = spark.createDataFrame(data.astype(object).where(data.notna(), None).astype({"num_id": int}), "".join(f"{c} double, " for c in cols) + "num_id long")
    got = {r["columns"]: r["num_people"] for r in ag.people_columns(df, cols, 0.6, 15).collect()}
    known = data.groupby("num_id")[cols].count()
    want = {",".join(s): int((known[list(s)].sum(axis=1) / (6 * len(s)) >= 0.6).sum()) for k in (15, 16, 17) for s in combinations(cols, k)}
    assert got == want
    assert ag.people_columns(df.limit(0), cols[:5], 0.6).filter("num_people <> 0").count() == 0


def test_densify_keeps_repeated_days(spark):
    rows = [(1, "2020-01-01", 2), (1, "2020-01-01", 3), (1, "2020-01-03", 4), (2, "2020-01-05", 1)]
    df = spark.createDataFrame(rows, "num_id int, d string, v int").select("num_id", F.to_date("d").alias("dt"), "v")
    got = sorted((r.num_id, str(r.dt), r.v or 0) for r in tl.densify_days(df).collect())
    assert got == [(1, "2020-01-01", 2), (1, "2020-01-01", 3), (1, "2020-01-02", 0), (1, "2020-01-03", 4), (2, "2020-01-05", 1)]


def test_union_merge_refuses_repeated_keys(spark):
    left = spark.createDataFrame([(1, 1, 9), (1, 5, 2)], "k int, v int, u int")
    right = spark.createDataFrame([(1, 7), (2, 8)], "k int, w int")
    with pytest.raises(Exception, match="several rows of one key"):
        mg.merge_all([left, right], ["k"], unique=True).collect()
    one = mg.merge_all([left.limit(1), right], ["k"], unique=True).collect()
    assert sorted(map(tuple, one)) == [(1, 1, 9, 7), (2, None, None, 8)]


def test_forty_columns_in_one_scan(spark, tmp_path):
    rng = np.random.default_rng(2)
    base = rng.normal(size=(500, 40)) @ rng.normal(size=(40, 40)) + 1e5
    base[:, 7] = 3.7
    base[rng.random(base.shape) < 0.1] = np.nan
    cols = [f"c{i}" for i in range(40)]
    data = pd.DataFrame(base, columns=cols)
    data["num_id"] = np.arange(500) % 3
    names = ", ".join(f"{c} double" for c in cols)
    path = str(tmp_path / "wide")
    spark.createDataFrame(data.astype(object).where(data.notna(), None), names + ", num_id int").write.parquet(path)
    df = spark.read.parquet(path)
    out = co.corr_matrix(df, cols)
    assert out._jdf.queryExecution().executedPlan().toString().count("FileScan") == 1
    want = data[cols].corr()
    got = {(r.var_i, r.var_j): r.r for r in out.collect()}
    assert len(got) == 780
    for (a, b), r in got.items():
        assert (r is None) == (7 in (int(a[1:]), int(b[1:])))
        assert r is None or abs(r - want.loc[a, b]) < 1e-6
    person = {(r.num_id, r.var_i, r.var_j): r.r for r in co.person_corr(df, cols[:6]).collect()}
    for g, part in data.groupby("num_id"):
        w = part[cols[:6]].corr()
        assert all(abs(person[(g, a, b)] - w.loc[a, b]) < 1e-6 for a, b in combinations(cols[:6], 2))
