"""Findings of round 4."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from dayspan.operators import clustering as cl
from dayspan.operators import distance as di
from dayspan.operators import models as mo
from dayspan.operators import neighbours as nb
from dayspan.plans import modelling


def _vectors(spark, n=400, wide=3):
    rng = np.random.default_rng(3)
    x = np.round(rng.normal(size=(n, wide)) + 3 * rng.integers(0, 4, (n, 1)), 1)
    names = [f"x{i}" for i in range(wide)]
    return spark.createDataFrame([tuple(map(float, r)) for r in np.vstack([x, x[:50]])], ", ".join(f"{c} double" for c in names)), names


def test_settled_models_do_not_keep_the_sums_of_their_round(spark):
    df, names = _vectors(spark, 200)
    points = df.selectExpr("array(x0, x1, x2) AS x").groupBy("x").count().withColumnRenamed("count", "n")
    seeds = cl._seed_sequences(points, 6, 4, 34)
    best = cl._moved_together(points, [(k, s[:k]) for k in (6, 5, 4, 3, 2) for s in seeds], 100)
    assert sorted(best) == [2, 3, 4, 5, 6] and all(c.base is None and c.shape == (k, 3) for k, (_, c) in best.items())


def test_a_sweep_over_held_rows_gives_the_figures_of_the_scans(spark, monkeypatch):
    df, names = _vectors(spark)
    held = cl.kmeans_sweep(df, names, range(2, 9), inits=3).collect()
    monkeypatch.setattr(cl, "HELD_NUMBERS", 0)
    scanned = cl.kmeans_sweep(df, names, range(2, 9), inits=3).collect()
    assert len(held) == 7 and np.allclose([list(r) for r in held], [list(r) for r in scanned])


@pytest.mark.parametrize("lot", [di.CELL_ROWS, 2])
@pytest.mark.parametrize("metric", ["euclidean", "dtw"])
def test_persons_with_equal_vectors_are_pairs_too(spark, monkeypatch, metric, lot):
    monkeypatch.setattr(di, "CELL_ROWS", lot)  # small: the copies of a vector are cut into lots
    rng = np.random.default_rng(5)
    x = rng.integers(0, 4, (40, 3)).astype(float)
    x = np.vstack([x, np.tile(x[:2], (5, 1))])
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)] + [(99, 1.0, None, 1.0), (None, *map(float, x[0]))], "id long, a double, b double, c double")
    dist = (lambda a, b: np.sqrt(((a - b) ** 2).sum())) if metric == "euclidean" else (lambda a, b: di.dtw_matrix(a[None], b[None])[0])
    want = {(i, j): d for i in range(len(x)) for j in range(i + 1, len(x)) if (d := dist(x[i], x[j])) <= 1.5}
    got = di.person_pairs(df, "id", ["a", "b", "c"], 1.5, metric).collect()
    assert len(got) == len(want) and 0.0 in want.values()
    assert all(abs(r["d"] - want[r["id_a"], r["id_b"]]) < 1e-9 for r in got)


def test_neighbours_are_written_once_for_each_group(spark, monkeypatch):
    """A training row near to many cells goes to few groups; keys may repeat, labels may be null."""
    rng = np.random.default_rng(4)
    x = rng.normal(size=(300, 6))
    x[100:110] = x[0]
    ids = [int(i) for i in range(300)]
    ids[7] = 3
    rows = [(i, *map(float, r), None if n % 17 == 0 else n % 3) for n, (i, r) in enumerate(zip(ids, x))]
    cols = list("pqrstu")
    df = spark.createDataFrame(rows, "id long, " + ", ".join(f"{c} double" for c in cols) + ", label long").withColumn("n", F.monotonically_increasing_id())
    train, test = df.filter("id % 5 != 0"), df.filter("id % 5 = 0")
    sent, plain = [], nb._wanted
    monkeypatch.setattr(nb, "_wanted", lambda *a: sent.append(plain(*a)) or sent[-1])
    monkeypatch.setattr(nb, "BATCH_ROWS", 16)
    monkeypatch.setattr(nb, "TILE_ROWS", 7)
    got = nb.nearest(train, test, "id", cols, "label", 4).collect()
    tr = [r for r in rows if r[0] % 5]
    y, key = np.array([r[1:7] for r in tr]), np.array([r[0] for r in tr])
    for r in (r for r in rows if r[0] % 5 == 0):
        d = np.sqrt(((y - np.array(r[1:7])) ** 2).sum(axis=1))
        want = np.lexsort((key, d))[:4]
        mine = sorted((g["d"], g["train_id"], g["label"]) for g in got if g["id"] == r[0])
        assert [m[1] for m in mine] == key[want].tolist() and np.allclose([m[0] for m in mine], d[want])
        assert all(m[2] in {t[7] for t in tr if t[0] == m[1]} for m in mine)
    assert sent[0].agg(F.sum(F.size("wanted"))).first()[0] <= spark.sparkContext.defaultParallelism * len(tr) / 2


def test_cells_form_few_groups(monkeypatch):
    pivots = np.random.default_rng(1).normal(size=(40, 5))
    first, lots, groups, slices = nb._groups(pivots, {c: 100 for c in range(40)}, 20_000, 8, 5)
    assert groups * slices >= 8 and groups <= 4 and set(lots) == {1}
    monkeypatch.setattr(nb, "BLOCK_ROWS", 250)
    first, lots, groups, slices = nb._groups(pivots, {0: 1000, **{c: 100 for c in range(1, 40)}}, 20_000, 8, 5)
    held = [0.0] * groups
    for c in range(40):
        for g in range(first[c], first[c] + lots[c]):
            held[g] += (1000 if c == 0 else 100) / lots[c]
    assert max(held) <= 250 and min(held) > 0


def test_comparisons_have_all_rounds_trees_and_folds(spark, sf, monkeypatch):
    seen = []
    monkeypatch.setattr(modelling, "split_rows", lambda *a, **more: more["folds"])
    monkeypatch.setattr(modelling, "split_table", lambda *a: None)
    monkeypatch.setattr(modelling, "with_vector", lambda *a: None)
    monkeypatch.setattr(mo, "compare", lambda data, models, folds, classify=False: seen.append((data, models, folds)))
    modelling.compare_classifiers(spark, sf)
    modelling.compare_regressors(spark, sf)
    (rows, classifiers, folds), (_, regressors, _) = seen
    assert rows == {"sensors": 10} and folds == 10
    assert [classifiers[m].getMaxIter() for m in ("logistic", "linear_svm", "gbt")] == [100] * 3
    assert classifiers["random_forest"].getNumTrees() == regressors["random_forest"].getNumTrees() == 100
    assert regressors["gbt_gradient"].getMaxIter() == 100
