"""Stability selection: all fits together against one fit after the other."""

import numpy as np
from pyspark.sql import functions as F

from dayspan.operators import selection


def _plain(x, y, w, penalty, rounds=20000):
    """L1 logistic regression by plain proximal steps."""
    beta, n = np.zeros(x.shape[1]), w.sum()
    step = 4 * n / (w * (x * x).sum(1)).sum()
    for _ in range(rounds):
        g = x.T @ (w * (1 / (1 + np.exp(-x @ beta)) - y)) / n
        new = beta - step * g
        new[:-1] = np.sign(new[:-1]) * np.maximum(np.abs(new[:-1]) - step * penalty, 0)
        if np.abs(new - beta).max() < 1e-9:
            break
        beta = new
    return new


def test_joint_fits_against_single_ones(spark):
    rng = np.random.default_rng(8)
    n, cols, penalties, folds, samples = 120, ["a", "b", "c"], (0.1, 0.01), 3, 4
    x = rng.normal(size=(n, 3)) * [1.0, 5.0, 0.2] + 3
    y = (x[:, 0] - 3 + 0.1 * (x[:, 1] - 3) + rng.normal(0, 0.5, n) > 0).astype(float)
    df = spark.createDataFrame([(i, *map(float, r), float(v)) for i, (r, v) in enumerate(zip(x, y))], "id long, a double, b double, c double, y double")
    got = {r["variable"]: r["mean_coef"] for r in selection.stability_select(df, "y", cols, ["id"], samples, 0.1, penalties, folds, max_iter=600, tol=1e-8).collect()}
    keys = np.array([r["h"] for r in df.orderBy("id").select(F.xxhash64("id").alias("h")).collect()], np.int64)
    w, fold = selection.Draws(samples, folds, 0.7)(keys)
    sd = x.std(0)
    z = np.column_stack([(x - x.mean(0)) / sd, np.ones(n)])
    total = np.zeros(3)
    for s in range(samples):
        score = []
        for penalty in penalties:
            hits = []
            for f in range(folds):
                b = _plain(z, y, w[:, s] * (fold[:, s] != f), penalty)
                held = w[:, s] * (fold[:, s] == f)
                hits.append((held * ((z @ b > 0) == (y > 0.5))).sum() / held.sum())
            score.append(np.mean(hits))
        total += np.abs(_plain(z, y, w[:, s], penalties[int(np.argmax(score))])[:3] / sd)
    for i, c in enumerate(cols):
        assert abs(got[c] - total[i] / samples) < 1e-3


def test_no_rows_select_nothing(spark):
    df = spark.createDataFrame([], "id long, a double, y double")
    assert [tuple(r) for r in selection.stability_select(df, "y", ["a"], ["id"], 2).collect()] == [("a", 0.0, 0)]
