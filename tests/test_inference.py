import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from dayspan.operators import aggregate as ag
from dayspan.operators import correlation as co
from dayspan.operators import inference as st
from dayspan.operators import merge


def test_ks_against_definition(spark):
    rng = np.random.default_rng(0)
    a, b = np.round(rng.normal(0, 1, 150), 1), np.round(rng.normal(0.4, 1, 90), 1)
    df = spark.createDataFrame([(float(v), True) for v in a] + [(float(v), False) for v in b], "x double, first boolean")
    grid = np.union1d(a, b)
    d = max(abs((a <= g).mean() - (b <= g).mean()) for g in grid)
    got = st.ks_two_sample(df, "x", F.col("first")).first()
    assert abs(got["statistic"] - d) < 1e-12 and (got["n_a"], got["n_b"]) == (150, 90)
    lam = d * math.sqrt(150 * 90 / 240)
    assert abs(got["p_value"] - 2 * sum((-1) ** (k - 1) * math.exp(-2 * k * k * lam * lam) for k in range(1, 200))) < 1e-9


def test_both_ks_series_agree(spark):
    x = spark.createDataFrame([(0.5,), (1.0,), (1.179,), (1.181,), (2.0,)], "x double")
    got = x.select("x", st.ks_p(F.col("x"), F.lit(2), F.lit(2)).alias("p")).collect()
    for r in got:
        want = 2 * sum((-1) ** (k - 1) * math.exp(-2 * k * k * r["x"] ** 2) for k in range(1, 400))
        assert abs(r["p"] - want) < 1e-7


def test_kruskal_with_ties(spark):
    rng = np.random.default_rng(1)
    pdf = pd.DataFrame({"g": rng.integers(0, 4, 200), "x": rng.integers(0, 12, 200).astype(float)})
    r = pdf.x.rank()
    n = len(pdf)
    h = 12 / (n * (n + 1)) * sum(v.sum() ** 2 / len(v) for _, v in r.groupby(pdf.g)) - 3 * (n + 1)
    t = pdf.x.value_counts()
    h /= 1 - (t**3 - t).sum() / (n**3 - n)
    got = st.kruskal_wallis(spark.createDataFrame(pdf), "g", ["x"]).first()
    assert abs(got["h"] - h) < 1e-9 and got["groups"] == 4


def test_pairs_with_a_group_of_one_have_no_statistic(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("b", 4.0), ("b", 7.0), ("c", 1.0)], "g string, x double")
    got = {(r["group_a"], r["group_b"]): r["t"] for r in st.welch_t(df, "g", "x").collect()}
    assert [k for k, t in got.items() if t is not None] == [("a", "b")] and set(got) == {("a", "b"), ("a", "c"), ("b", "c")}
    thin = [r for r in st.cohens_d(df, "g", "x").collect() if "c" in (r["group_a"], r["group_b"])]
    assert len(thin) == 2 and all(r["d"] is None for r in thin)
    assert abs(st.cohens_d(df, "g", "x").first()["d"] - (-4 / math.sqrt((0.5 + 4.5) / 2))) < 1e-12


def test_person_correlation_edges(spark):
    rows = [(1, 1.0, 2.0, 5.0), (1, 2.0, 4.0, 5.0), (2, 1.0, 1.0, 1.0), (3, None, 1.0, 2.0), (3, 1.0, None, 3.0)]
    df = spark.createDataFrame(rows, "num_id int, a double, b double, c double")
    got = {(r["num_id"], r["var_i"], r["var_j"]): r["r"] for r in co.person_corr(df, ["a", "b", "c"]).collect()}
    assert abs(got[(1, "a", "b")] - 1) < 1e-12 and got[(1, "a", "c")] == 0.0
    assert not any(k[0] == 2 for k in got)
    assert set(got) == {(p, i, j) for p in (1, 3) for i, j in (("a", "b"), ("a", "c"), ("b", "c"))}
    full = co.symmetric(co.person_corr(df, ["a", "b", "c"], diagonal=True), ["num_id"])
    assert full.filter("num_id = 1").count() == 9


def test_all_pairs_of_many_columns(spark):
    x = np.random.default_rng(2).normal(size=(50, 6))
    cols = [f"c{i}" for i in range(6)]
    df = spark.createDataFrame(pd.DataFrame(x, columns=cols))
    want = np.corrcoef(x.T)
    for r in co.corr_matrix(df, cols).collect():
        assert abs(r["r"] - want[int(r["var_i"][1]), int(r["var_j"][1])]) < 1e-9


def test_missing_keys_match_each_other_in_a_merge(spark):
    a = spark.createDataFrame([(1, None, "p"), (2, 5, "q")], "k int, d int, x string")
    b = spark.createDataFrame([(1, None, 7), (3, None, 8)], "k int, d int, y int")
    got = sorted(merge.outer_merge(a, b).collect(), key=lambda r: r["k"])
    assert [(r["k"], r["d"], r["x"], r["y"]) for r in got] == [(1, None, "p", 7), (2, 5, "q", None), (3, None, None, 8)]
    union = merge.merge_all([a, b], ["k", "d"], unique=True)
    assert sorted(map(tuple, union.collect()), key=lambda r: r[0]) == sorted(map(tuple, got), key=lambda r: r[0])


def test_subset_search_above_sixteen_columns(spark):
    cols = [f"c{i}" for i in range(18)]
    rows = [(p, *[float(i) if (i < 15 or p < 3) else None for i in range(18)]) for p in range(6) for _ in range(2)]
    df = spark.createDataFrame(rows, "num_id int, " + ", ".join(f"{c} double" for c in cols))
    best = ag.best_tradeoff(ag.people_columns(df, cols, 0.9, least=14)).first()
    assert best["num_people"] == 6 and best["num_columns"] == 16


def test_histogram_and_constant_column(spark):
    df = spark.createDataFrame([(0.0, 1.0), (1.0, 1.0), (10.0, None)], "x double, c double")
    got = {(r["column"], r["bin"]): r["n"] for r in ag.histogram(df, ["x", "c"], 10).collect()}
    assert got == {("x", 0): 1, ("x", 1): 1, ("x", 9): 1, ("c", 0): 2}
