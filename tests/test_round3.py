"""Cases found by comparing larger tables with the SQL."""

import datetime as dt
import math
import threading

import numpy as np
from pyspark.ml.regression import LinearRegression
from pyspark.sql import functions as F

from dayspan.operators import attribution, clean
from dayspan.operators import clustering as cl
from dayspan.operators import distance as di
from dayspan.operators import evaluation as ev
from dayspan.operators import impute
from dayspan.operators import models as mo
from dayspan.operators import neighbours as ne
from dayspan.operators import selection
from dayspan.operators import timeline as tl
from dayspan.plans import modelling


def test_a_mean_of_a_day_is_added_in_time_order(spark):
    """The mean equals, to the last bit, that of the filled rows added one by one, gaps at the start and shared minutes included."""
    rng = np.random.default_rng(5)
    rows, want = [], {}
    for person in range(60):
        n = int(rng.integers(2, 12))
        values = [None if rng.random() < 0.4 else round(float(rng.uniform(0, 200)), 2) for _ in range(n)]
        seconds = sorted(int(s) for s in rng.integers(0, 300, n))
        rows += [(person, dt.datetime(2024, 1, 1) + dt.timedelta(seconds=s), i, v) for i, (s, v) in enumerate(zip(seconds, values))]
        total, known = 0.0, next((v for v in values if v is not None), None)
        for v in values:
            known = known if v is None else v
            total = total if known is None else total + known
        want[person] = None if known is None else total / n
    df = spark.createDataFrame(rows, "num_id long, ts timestamp_ntz, ord long, x double")
    assert {r["num_id"]: r["x"] for r in tl.combine_same_day(df, "num_id", "ts", ["ts", "ord"], ["x"]).collect()} == want


def test_rates_over_zero_hours_can_be_infinite(spark):
    df = spark.createDataFrame([(1, 4.0, 2.0), (2, 4.0, 0.0), (3, 0.0, 0.0), (4, None, 0.0), (5, 4.0, None)], "i int, x double, h double")
    got = {r["i"]: r["x_hr"] for r in clean.per_hour(df, ["x"], "h", finite=False).collect()}
    assert (got[1], got[2], got[4], got[5]) == (2.0, math.inf, None, None) and math.isnan(got[3])


def test_rates_over_zero_hours_can_be_infinite(spark):
    df = spark.createDataFrame([(1, 4.0, 2.0), (2, 4.0, 0.0), (3, 0.0, 0.0), (4, None, 0.0), (5, 4.0, None)], "i int, x double, h double")
    got = {r["i"]: r["x_hr"] for r in clean.per_hour(df, ["x"], "h", finite=False).collect()}
    assert (got[1], got[2], got[4], got[5]) == (2.0, math.inf, None, None) and math.isnan(got[3])


def test_density_clustering_returns_no_near_pairs(spark, monkeypatch):
    """Week counts at a radius that covers most of them: labels come without a row per near pair, and one part without comparing all."""
    monkeypatch.setattr(di, "near_pairs", None)
    rng = np.random.default_rng(3)
    x = np.unique(rng.poisson(6, (400, 3)), axis=0).astype(float)
    compared = []
    plain = di.near_rows
    monkeypatch.setattr(di, "near_rows", lambda a, b, eps, metric: compared.append(len(a) * len(b)) or plain(a, b, eps, metric))
    assert set(cl._parts_within(np.arange(len(x)), x, 8.0, "dtw")) == {0} and sum(compared) < len(x) ** 2 / 2
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], "id long, a double, b double, c double")
    got = {r["id"]: r["cluster"] for r in cl.dbscan(df, "id", ["a", "b", "c"], 8.0, 10).collect()}
    d = np.array([di.dtw_matrix(np.broadcast_to(r, x.shape), x) for r in x])
    core = (d <= 8).sum(1) >= 10
    assert all((got[i] >= 0) == bool(core[i] or (d[i][core] <= 8).any()) for i in range(len(x)))


def test_rows_are_added_at_their_place_of_each_model():
    rng = np.random.default_rng(2)
    at, rows = np.column_stack([rng.integers(0, 3, 50), 3 + rng.integers(0, 9, 50)]), rng.normal(size=(50, 4))
    got, want = np.zeros((12, 4)), np.zeros((12, 4))
    cl._add_by_place(got, at, rows)
    for m in range(2):
        np.add.at(want, at[:, m], rows)
    assert np.allclose(got, want)


def test_sweep_keeps_its_pool_full(spark, monkeypatch):
    """Waiting models start as others end, so a small pool costs few scans more; best figures do not depend on the pool."""
    rng = np.random.default_rng(8)
    df = spark.createDataFrame([tuple(map(float, r)) for r in rng.normal(size=(60, 2))], "a double, b double")
    scans, plain = [], cl.summed
    monkeypatch.setattr(cl, "summed", lambda *a: scans.append(1) or plain(*a))
    wide = cl.kmeans_sweep(df, ["a", "b"], range(2, 5), inits=2).collect()
    at_once = len(scans)
    monkeypatch.setattr(cl, "SWEEP_CENTRES", 9)
    scans.clear()
    narrow = cl.kmeans_sweep(df, ["a", "b"], range(2, 5), inits=2).collect()
    assert len(scans) < 4 * at_once
    assert np.allclose([list(r) for r in wide], [list(r) for r in narrow])


def test_a_line_between_days_ends_in_the_same_bit_as_the_sql(spark):
    """``v0 + (v1 - v0) * a / b`` from left to right: a value beside a limit such as 50 falls on the same side of it."""
    rng = np.random.default_rng(8)
    rows, want = [], {}
    for person in range(400):
        b = int(rng.integers(2, 7))
        v0, v1 = (round(float(v), 2) for v in rng.uniform(0, 200, 2))
        days = [dt.date(2024, 1, 1) + dt.timedelta(days=i) for i in range(b + 1)]
        rows += [(person, 0, d, v0 if i == 0 else v1 if i == b else None) for i, d in enumerate(days)]
        want |= {(person, d): v0 + (v1 - v0) * i / b for i, d in enumerate(days) if 0 < i < b}
    df = spark.createDataFrame(rows, "num_id long, week int, dt date, x double")
    got = {(r["num_id"], r["dt"]): r["x_int"] for r in tl.interpolate_weekly(df, ["x"], 10.0).collect()}
    assert {k: got[k] for k in want} == want


def _panel(spark, n=3000):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(n, 2))
    return spark.createDataFrame([(i % 300, i // 300, float(a), float(b), float(4 * (a > 0.25) + (b > 0))) for i, (a, b) in enumerate(x)], "num_id long, day int, a double, b double, y double")


def test_forests_of_all_late_days_do_not_depend_on_the_partitions(spark):
    df = _panel(spark)
    runs = [
        {(r["num_id"], r["day"]): r["prediction"] for r in mo.walk_forward(d, ["a", "b"], "y", share=0.3, trees=20, depth=4).collect()}
        for d in (df, df.repartition(5, "a"))
    ]
    assert len(runs[0]) == 900 and runs[0].keys() == runs[1].keys()
    assert max(abs(runs[0][k] - runs[1][k]) for k in runs[0]) < 1e-9
    truth = {(r["num_id"], r["day"]): r["y"] for r in df.collect()}
    assert np.mean([(runs[0][k] - truth[k]) ** 2 for k in runs[0]]) < 0.05 * np.var(list(truth.values()))


def test_a_day_without_past_has_no_prediction(spark):
    got = mo.walk_forward(_panel(spark, 600), ["a", "b"], "y", share=1.0, trees=3, depth=2).collect()
    assert {r["day"] for r in got if r["prediction"] is None} == {0} and len(got) == 600


def test_rows_of_one_cell_are_attributed_once(spark):
    df = _panel(spark).withColumn("id", F.col("num_id") * 100 + F.col("day"))
    model = mo.forest(trees=4, depth=3).fit(mo.assemble(df, ["a", "b"], ["y"]))
    rows = attribution.shapley_rows(model, df, ["a", "b"], "id").groupBy("feature").agg(F.avg(F.abs("contribution")).alias("m")).collect()
    summary = attribution.attribution_summary(model, df, ["a", "b"], "id")
    got = {r["feature"]: r["mean_abs"] for r in summary.collect()}
    assert all(abs(got[r["feature"]] - r["m"]) < 1e-9 for r in rows) and len(got) == len(rows) == 2
    plan = summary._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" in plan[plan.index("MapInArrow"):]  # the cells are counted before their contributions are


def test_no_row_is_written_with_its_distances_to_all_pivots(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(400, 3))
    rows = spark.createDataFrame([(i, [float(v) for v in r], i % 4) for i, r in enumerate(x)], "id long, vec array<double>, label long")
    marks = x[:20]
    placed = ne._to_pivots(rows, "id", marks, ", label long")
    assert placed.columns == ["id", "vec", "label", "cell", "reach"]
    limit = rng.uniform(0.5, 2, 20)
    d = np.sqrt(((x[:, None] - marks[None]) ** 2).sum(2))
    got = {r["id"]: r["wanted"] for r in ne._wanted(placed, marks, limit).collect()}
    assert got == {i: list(np.flatnonzero(d[i] <= limit)) for i in range(400)}


def test_columns_of_a_large_table_are_imputed_by_joint_forests(spark, monkeypatch):
    """No MLlib fit on however few partitions; guesses do not depend on the partitions."""
    monkeypatch.setattr(impute, "SMALL_ROWS", 100)
    monkeypatch.setattr(impute, "RandomForestRegressor", None)
    rng = np.random.default_rng(5)
    a = rng.uniform(0, 10, 800)
    full = np.column_stack([a, 3 * a + rng.uniform(0, 1, 800)])
    lost = rng.random(800)
    rows = [(i, None if u < 0.1 else float(x), None if 0.1 <= u < 0.2 else float(y)) for i, ((x, y), u) in enumerate(zip(full, lost))]
    df = spark.createDataFrame(rows, "cell long, a double, b double")
    runs = [{r["cell"]: (r["a"], r["b"]) for r in impute.forest_impute(d, "cell", ["a", "b"], rounds=1, trees=10).collect()} for d in (df.coalesce(1), df.repartition(7, "a"))]
    got, again = (np.array([run[i] for i in range(800)]) for run in runs)
    assert np.abs(got - again).max() < 1e-9
    for c, hidden in enumerate((lost < 0.1, (0.1 <= lost) & (lost < 0.2))):
        assert (got[~hidden, c] == full[~hidden, c]).all()
        assert ((got[hidden, c] - full[hidden, c]) ** 2).mean() < 0.05 * full[:, c].var()


def test_a_bootstrap_looks_only_at_the_rows_it_has_drawn(monkeypatch):
    """Gradients of all fits equal those over all rows; the logistic function is taken once per drawn row and fit."""
    rng = np.random.default_rng(9)
    n, samples, folds, penalties = 300, 7, 3, 2
    xs, ys = rng.normal(size=(n, 4)), (rng.random(n) > 0.5) * 1.0
    at = rng.normal(size=(4, samples * penalties * (folds + 1)))
    w, fold = selection.Draws(samples, folds, 0.7)(rng.integers(-(2**62), 2**62, n))
    w[:, 2] = 0  # nothing drawn
    every = np.stack([w * (fold != f) for f in range(folds)] + [w], 2)[:, :, None].repeat(penalties, 2).reshape(n, -1)
    want = xs.T @ (every * (1 / (1 + np.exp(-(xs @ at))) - ys[:, None]))
    taken, plain = [], np.exp
    monkeypatch.setattr(np, "exp", lambda a, **k: taken.append(a.size) or plain(a, **k))
    assert np.allclose(selection._slopes(xs, ys, w, fold, folds, at), want, atol=1e-9)
    assert sum(taken) == (w > 0).sum() * penalties * (folds + 1) < 0.6 * n * at.shape[1]


def _split_table(spark, n=400):
    rng = np.random.default_rng(12)
    x = rng.normal(size=(n, 2))
    rows = [(float(a), float(b), float(a + rng.normal() / 2 > 0), "test" if i % 5 == 0 else "train", i % 2) for i, (a, b) in enumerate(x)]
    return mo.assemble(spark.createDataFrame(rows, "a double, b double, y double, split string, fold int").coalesce(2), ["a", "b"], ["y", "split", "fold"])


def test_compared_models_score_as_if_fitted_one_by_one(spark):
    rows = _split_table(spark).persist()
    models = mo.classifiers(iterations=5, trees=4)
    got = {(r["model"], r["fold"], r["metric"]): r["score"] for r in mo.compare({"d": rows}, models, 2, classify=True).collect()}
    assert len(got) == 2 * 3 * len(models)
    train = rows.filter("split = 'train'")
    for name, est in models.items():
        for f, fit_on, test in ((0, train.filter("fold != 0"), train.filter("fold = 0")), (-1, train, rows.filter("split != 'train'"))):
            scored = mo.positive_probability(est.fit(fit_on), test).select("y", "prediction", "probability").toPandas()
            up, down = (scored.probability[scored.y == c].to_numpy() for c in (1, 0))
            auc = ((up[:, None] > down).sum() + (up[:, None] == down).sum() / 2) / (len(up) * len(down))
            assert abs(got[name, f, "accuracy"] - (scored.y == scored.prediction).mean()) < 1e-12 and abs(got[name, f, "auc"] - auc) < 1e-12


def test_fits_of_a_comparison_run_at_a_time(spark):
    both = threading.Barrier(2)

    class Meeting(LinearRegression):
        def _fit(self, dataset):
            both.wait(60)  # breaks if no second fit runs meanwhile
            return super()._fit(dataset)

    assert mo.compare({"d": _split_table(spark)}, {"m": Meeting(labelCol="y")}, 1).count() == 6


def test_predictions_are_evaluated_once_for_all_metrics(spark):
    seen = spark.sparkContext.accumulator(0)

    def noted(p):
        seen.add(1)
        return p

    given = [(1, 1.0, 1.0, 0.9), (1, 0.0, 0.0, 0.2), (1, 0.0, 1.0, 0.9), (1, 1.0, 0.0, None), (1, 1.0, None, 0.4), (2, 1.0, 1.0, 0.5)]
    df = spark.createDataFrame(given, "g int, y double, prediction double, p double").withColumn("probability", F.udf(noted, "double")("p")).drop("p")
    got = {r["g"]: r for r in ev.classification_metrics(df, ["g"]).collect()}
    assert seen.value == len(given)
    assert (got[1]["n"], got[1]["accuracy"], got[1]["auc"]) == (5, 0.5, 0.625) and abs(got[1]["mean_probability"] - 0.6) < 1e-12
    assert (got[2]["n"], got[2]["accuracy"], got[2]["auc"], got[2]["mean_probability"]) == (1, 1.0, None, 0.5)


def test_rows_of_a_comparison_are_spread_evenly(spark, sf):
    rows = modelling.split_rows(spark, sf, "high", grouped=False, folds=3)
    sizes = [r["count"] for r in rows.groupBy(F.spark_partition_id().alias("at")).count().collect()]
    assert len(sizes) == 2 * spark.sparkContext.defaultParallelism and max(sizes) < 2 * sum(sizes) / len(sizes)


def test_a_comparison_computes_its_panel_once(spark, sf, monkeypatch):
    """Both draws, the join and both sets of columns read one evaluation of the panel."""
    seen = spark.sparkContext.accumulator(0)

    def noted(v):
        seen.add(1)
        return v

    rng = np.random.default_rng(6)
    days = [(p, dt.date(2024, 1, 1 + d), p * 100000 + d, *map(float, rng.uniform(0, 100, 5))) for p in range(30) for d in range(6)]
    plain = spark.createDataFrame(days, "num_id long, dt date, cell_row long, view double, click double, signup double, error double, value double")
    panel = plain.withColumn("purchase", F.udf(noted, "double").asNondeterministic()("value")).drop("value")
    monkeypatch.setattr(modelling, "known_panel", lambda *a: panel)
    monkeypatch.setattr(modelling, "_small_grid", lambda names: {"linear": mo.regressors()["linear"]})
    out = modelling.compare_regressors(spark, sf)
    assert out.count() == 2 * 4 * 3 and seen.value == len(days)


def test_vectors_are_placed_once_and_in_many_tasks(spark, monkeypatch):
    seen, cuts, plain = spark.sparkContext.accumulator(0), [], di.cut_lineage
    monkeypatch.setattr(di, "cut_lineage", lambda d: cuts.append(plain(d)) or cuts[-1])

    def noted(v):
        seen.add(1)
        return v

    rows = [(i, float(a), float(b), float(c)) for i, (a, b, c) in enumerate(np.random.default_rng(4).poisson(5, (300, 3)))]
    df = spark.createDataFrame(rows, "id long, v double, b double, c double").select("id", F.udf(noted, "double").asNondeterministic()("v").alias("a"), "b", "c")
    assert di.landmark_mds(df, "id", ["a", "b", "c"], landmarks=20).count() == 300 and seen.value == 300
    placed = next(d for d in cuts if d.columns == ["id", "y1", "y2"])
    assert placed.rdd.getNumPartitions() == 2 * spark.sparkContext.defaultParallelism


def test_placement_is_the_mean_of_the_moves_to_all_landmarks():
    rng = np.random.default_rng(11)
    coords, target = rng.normal(size=(9, 2)), rng.uniform(0.1, 3, (40, 9))
    x = coords[target.argmin(axis=1)] + 1e-6
    for _ in range(5):
        gap = x[:, None, :] - coords[None, :, :]
        now = np.maximum(np.sqrt((gap**2).sum(axis=2)), 1e-12)
        x = (coords[None, :, :] + gap * (target / now)[:, :, None]).mean(axis=1)
    assert np.abs(di._placed(target, coords, 5) - x).max() < 1e-9
