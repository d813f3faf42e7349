import math
from itertools import combinations
from math import factorial

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from dayspan.operators import attribution, evaluation, models as mo, neighbours, reduction, selection, splits


@pytest.fixture(scope="module")
def xy(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(400, 3))
    y = 2 * x[:, 0] - x[:, 1] + 0.1 * rng.normal(size=400)
    pdf = pd.DataFrame(x, columns=["a", "b", "c"]).assign(id=np.arange(400), num_id=np.arange(400) % 20, day=np.arange(400) // 20, target=y, high=(y > 0).astype(float))
    return spark.createDataFrame(pdf)


def test_mixed_model_against_dense_likelihood(spark):
    rng = np.random.default_rng(7)
    g = rng.integers(0, 12, 150)
    x = rng.normal(size=150) + 100
    y = 5 + 1.5 * x + rng.normal(0, 2, 12)[g] + rng.normal(0, 1, 150)
    got = {r["term"]: r["value"] for r in mo.mixed_lm(spark.createDataFrame(pd.DataFrame({"g": g, "x": x, "y": y})), "y", ["x"], "g").collect()}
    z = np.eye(12)[g]
    xs = np.column_stack([np.ones(150), x])

    def reml(ratio):
        v = np.eye(150) + ratio * z @ z.T
        vi = np.linalg.inv(v)
        a = xs.T @ vi @ xs
        beta = np.linalg.solve(a, xs.T @ vi @ y)
        r = y - xs @ beta
        s = r @ vi @ r / 148
        return -0.5 * (148 * math.log(s) + np.linalg.slogdet(v)[1] + np.linalg.slogdet(a)[1]), beta, s

    ratio = got["group_variance"] / got["residual_variance"]
    ll, beta, s = reml(ratio)
    assert all(ll >= reml(ratio * f)[0] - 1e-9 for f in (0.5, 0.9, 0.99, 1.01, 1.1, 2.0))
    assert abs(got["x"] - beta[1]) < 1e-8 and abs(got["intercept"] - beta[0]) < 1e-5 and abs(got["residual_variance"] - s) < 1e-8


def test_nearest_neighbours_against_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(8)
    x = np.vstack([rng.normal(size=(150, 4)), np.tile(rng.normal(size=(1, 4)), (60, 1)), rng.normal(8, 1, size=(90, 4))])
    pdf = pd.DataFrame(x, columns=list("pqrs")).assign(id=np.arange(len(x)), label=rng.integers(0, 3, len(x)))
    df = spark.createDataFrame(pdf)
    train, test = df.filter("id % 4 != 0"), df.filter("id % 4 = 0")
    monkeypatch.setattr(neighbours, "BLOCK_ROWS", 20)
    got = neighbours.nearest(train, test, "id", list("pqrs"), "label", 5, pivots=8).toPandas()
    tr, te = pdf[pdf.id % 4 != 0], pdf[pdf.id % 4 == 0]
    for r in te.itertuples():
        d = np.sqrt(((tr[list("pqrs")].to_numpy() - x[r.id]) ** 2).sum(axis=1))
        want = tr.id.to_numpy()[np.lexsort((tr.id.to_numpy(), d))[:5]]
        assert set(got[got.id == r.id].train_id) == set(want)


def test_per_person_logistic_against_numpy(spark):
    rng = np.random.default_rng(9)
    pdf = pd.DataFrame({"num_id": rng.integers(0, 3, 90), "a": rng.normal(size=90), "b": rng.normal(size=90)})
    pdf["y"] = (pdf.a > 0).astype(int)
    got = {r["num_id"]: r["w"] for r in mo.per_person_logistic(spark.createDataFrame(pdf), ["a", "b"], "y", steps=10, rate=0.01).collect()}
    for p, part in pdf.groupby("num_id"):
        x, y = np.column_stack([part.a, part.b, np.ones(len(part))]), part.y.to_numpy()
        w = m = v = np.zeros(3)
        for t in range(1, 11):
            g = ((1 / (1 + np.exp(-x @ w)) - y)[:, None] * x).mean(axis=0)
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            w = w - 0.01 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        assert np.allclose(got[p], w)


def test_splits_never_share_a_person(spark, xy):
    s = splits.group_split3(xy)
    assert s.count() == s.select("num_id").distinct().count() == 20
    sizes = {r["split"]: r["n"] for r in s.groupBy("split").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert sizes == {"test": 3, "val": 4, "train": 13}
    folds = splits.group_kfold(xy, k=5)
    per = [r["rows"] for r in folds.groupBy("fold").agg(F.sum("rows").alias("rows")).collect()]
    assert len(per) == 5 and max(per) - min(per) <= 20
    tail = splits.tail_split(xy.select("num_id", "day"), ["day", "num_id"])
    assert tail.filter("split = 'val'").count() == 60
    assert tail.filter("split = 'val'").agg(F.min("day")).first()[0] >= tail.filter("split = 'train'").agg(F.max("day")).first()[0]


def test_walk_forward_predicts_every_late_row_once(xy):
    out = mo.walk_forward(xy, ["a", "b", "c"], "target", share=0.1, trees=10)
    assert out.count() == 40 and out.select("day").distinct().count() == 2
    assert mo.walk_forward_report(out).first()["r2"] > 0.5
    assert mo.walk_forward_report(out, ["num_id"]).count() == 20


def _known(leaf, x, known):
    """Value of a leaf when only the features of ``known`` can be looked at."""
    value = leaf.value
    for f, tests, cover in zip(leaf.features, leaf.tests, leaf.covers):
        value *= float(all(attribution._passes(x[f : f + 1], t)[0] for t in tests)) if f in known else cover
    return value


@pytest.mark.parametrize("boosted", [False, True])
def test_contributions_are_exact(spark, xy, boosted):
    cols = ["a", "b", "c", "day"]
    rows = mo.assemble(xy, cols, ["id", F.col("target").alias("y")])
    model = (mo.GBTRegressor(labelCol="y", maxDepth=3, maxIter=4, seed=1) if boosted else mo.forest(trees=5)).fit(rows)
    found = attribution.leaves(model)
    parts = {}
    for r in attribution.shapley_rows(model, xy, cols, "id").collect():
        parts.setdefault(r["id"], {})[r["feature"]] = r["contribution"]
    for r in model.transform(rows).select("id", "features", "prediction").collect():  # they add up for every row
        assert abs(sum(parts[r["id"]].values()) + attribution.base_value(found) - r["prediction"]) < 1e-9
    p = len(cols)
    for r in rows.orderBy("id").limit(3).collect():  # and follow the definition over all sets of features
        x = np.array(r["features"].toArray())
        worth = {s: sum(_known(leaf, x, s) for leaf in found) for n in range(p + 1) for s in combinations(range(p), n)}
        for j, c in enumerate(cols):
            want = sum(
                factorial(len(s)) * factorial(p - 1 - len(s)) / factorial(p) * (worth[tuple(sorted((*s, j)))] - worth[s]) for s in worth if j not in s
            )
            assert abs(parts[r["id"]][c] - want) < 1e-9
    rank = [r["feature"] for r in attribution.attribution_summary(model, xy, cols, "id").orderBy(F.desc("mean_abs")).collect()]
    assert rank[0] == "a"


def test_boosted_trees_beat_one_tree(xy):
    rows = mo.assemble(xy, ["a", "b", "c"], [F.col("target").alias("y"), "id"])
    train, test = rows.filter("id % 5 != 0"), rows.filter("id % 5 = 0")
    one = evaluation.regression_metrics(mo.adaboost_r2(train, test, rounds=1)).first()["r2"]
    many = evaluation.regression_metrics(mo.adaboost_r2(train, test, rounds=8)).first()["r2"]
    assert many > one > 0.5


def test_balanced_weights_and_auc(spark):
    df = spark.createDataFrame([(0.0,)] * 6 + [(1.0,)] * 2, "y double")
    w = {r["y"]: r["w"] for r in mo.class_weights(df, "y").distinct().collect()}
    assert w == {0.0: 8 / 12, 1.0: 2.0}
    s = spark.createDataFrame([(0, 0.1), (0, 0.4), (1, 0.4), (1, 0.8)], "y int, probability double")
    assert evaluation.roc_auc(s).first()["auc"] == 0.875
    assert evaluation.roc_auc(s.filter("y = 1")).first()["auc"] is None


def test_compare_grid_shape(xy):
    rows = splits.kfold(splits.row_split3(xy, "id"), "id", 2)
    data = mo.assemble(rows.withColumn("y", F.col("target")), ["a", "b", "c"], ["y", "split", "fold"])
    grid = {k: v for k, v in mo.regressors(3, 5).items() if k in ("linear", "decision_tree")}
    out = mo.compare({"d": data}, grid, 2)
    assert out.count() == 2 * 3 * 3 and out.filter("score is null").count() == 0
    best = out.filter("metric = 'r2' and fold = -1").orderBy(F.desc("score")).first()
    assert best["model"] == "linear" and best["score"] > 0.99


def test_stability_prefers_the_informative_column(xy):
    out = selection.stability_select(xy, "high", ["a", "c"], ["id"], samples=2, penalties=(0.05,), folds=2, max_iter=20)
    got = {r["variable"]: r for r in out.collect()}
    assert got["a"]["selected"] == 1 and got["a"]["mean_coef"] > got["c"]["mean_coef"]


def test_components_against_numpy(spark):
    x = np.random.default_rng(10).normal(size=(80, 4)) @ np.diag([3, 2, 1, 0.5])
    cols = list("wxyz")
    df = spark.createDataFrame(pd.DataFrame(x, columns=cols).assign(id=np.arange(80)))
    got = reduction.project(df, cols, ["id"], 2).orderBy("id").toPandas()[["PC1", "PC2"]].to_numpy()
    c = x - x.mean(axis=0)
    u, s, vt = np.linalg.svd(c, full_matrices=False)
    for i in range(2):
        v = vt[i] * np.sign(vt[i][np.argmax(np.abs(vt[i]))])
        assert np.allclose(got[:, i], c @ v)
