"""Fits: linear and mixed models, trees, walk-forward, comparison grids, per-person logistic."""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

import numpy as np
from pyspark.ml import Estimator
from pyspark.ml.classification import (
    DecisionTreeClassifier,
    GBTClassifier,
    LinearSVC,
    LogisticRegression,
    RandomForestClassifier,
)
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import (
    DecisionTreeRegressor,
    GBTRegressor,
    LinearRegression,
    RandomForestRegressor,
)
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dayspan.operators import evaluation as ev
from dayspan.operators.forests import fit_forests, forest_prediction
from dayspan.operators.transform import least_squares
from dayspan.session import cut_lineage

# Fits of a comparison that run at a time.
FITS = 4


def assemble(df: DataFrame, cols: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """Complete rows with a feature vector ``features``."""
    rows = df.na.drop("any", subset=list(cols))
    return VectorAssembler(inputCols=list(cols), outputCol="features").transform(rows).select("features", *keep)


# ---- linear ------------------------------------------------------------------


def ols(df: DataFrame, target: str, cols: Sequence[str]) -> DataFrame:
    """Intercept, coefficients and R2 of ordinary least squares, as (term, value)."""
    rows = df.na.drop("any", subset=[target, *cols])
    fit = least_squares(rows, [target], cols)[target]
    guess = F.lit(float(fit[0]))
    for b, c in zip(fit[1:], cols):
        guess = guess + F.col(c) * F.lit(float(b))
    r2 = ev.regression_metrics(rows.select(F.col(target).alias("y"), guess.alias("prediction"))).first()["r2"]
    terms = [("intercept", float(fit[0])), *[(c, float(b)) for c, b in zip(cols, fit[1:])], ("r2", r2)]
    return df.sparkSession.createDataFrame(terms, "term string, value double")


def mixed_lm(df: DataFrame, target: str, cols: Sequence[str], group: str) -> DataFrame:
    """Random-intercept model by restricted maximum likelihood, as (term, value).

    The likelihood needs the pooled cross products and, per group size n, the sums
    of the groups' own totals. Those come from one grouping per group and one per
    size; the search over the variance ratio then costs nothing on the cluster.
    """
    rows = df.na.drop("any", subset=[target, group, *cols])
    p = len(cols) + 1
    names = [f"_v{i}" for i in range(p + 1)]  # intercept, predictors, target
    base = rows.select(F.col(group).alias("_g"), F.lit(1.0).alias("_v0"), *[F.col(c).cast("double").alias(f"_v{i + 1}") for i, c in enumerate((*cols, target))])
    # A common shift keeps the cross products well conditioned.
    means = base.agg(*[F.avg(v).alias(v) for v in names[1:]]).first()
    shift = np.array([0.0, *[means[v] for v in names[1:]]])
    base = base.select("_g", "_v0", *[(F.col(v) - F.lit(float(m))).alias(v) for v, m in zip(names[1:], shift[1:])])
    cells = [(i, j) for i in range(p + 1) for j in range(i, p + 1)]
    per_group = base.groupBy("_g").agg(
        F.count(F.lit(1)).alias("_n"),
        *[F.sum(v).alias(f"s{v}") for v in names],
        *[F.sum(F.col(names[i]) * F.col(names[j])).alias(f"x{i}_{j}") for i, j in cells],
    )
    sizes = per_group.groupBy("_n").agg(
        F.count(F.lit(1)).alias("_m"),
        *[F.sum(F.col(f"s{names[i]}") * F.col(f"s{names[j]}")).alias(f"t{i}_{j}") for i, j in cells],
        *[F.sum(f"x{i}_{j}").alias(f"x{i}_{j}") for i, j in cells],
    ).collect()
    n_of = np.array([r["_n"] for r in sizes], float)
    m_of = np.array([r["_m"] for r in sizes], float)

    def matrix(r, kind):
        a = np.zeros((p + 1, p + 1))
        for i, j in cells:
            a[i, j] = a[j, i] = r[f"{kind}{i}_{j}"]
        return a

    total = sum(matrix(r, "x") for r in sizes)
    outer = np.array([matrix(r, "t") for r in sizes])
    n = float((n_of * m_of).sum())

    def solve(ratio: float):
        w = ratio / (1.0 + n_of * ratio)
        a = total - np.tensordot(w, outer, axes=1)
        beta = np.linalg.solve(a[:p, :p], a[:p, p])
        rss = a[p, p] - beta @ a[:p, p]
        var = rss / (n - p)
        ll = -0.5 * ((n - p) * math.log(var) + (m_of * np.log1p(n_of * ratio)).sum() + np.linalg.slogdet(a[:p, :p])[1])
        return ll, beta, var, a

    grid = [0.0, *np.exp(np.linspace(-12, 8, 81))]
    best = max(grid, key=lambda r: solve(r)[0])
    if best > 0:
        low, high = math.log(best) - 0.25, math.log(best) + 0.25
        for _ in range(80):
            a, b = low + 0.382 * (high - low), high - 0.382 * (high - low)
            if solve(math.exp(a))[0] < solve(math.exp(b))[0]:
                low = a
            else:
                high = b
        best = math.exp((low + high) / 2)
    ll, beta, var, a = solve(best)
    se = np.sqrt(var * np.diag(np.linalg.inv(a[:p, :p])))
    intercept = beta[0] + shift[p] - float(beta[1:] @ shift[1:p])
    terms = [("intercept", intercept), *[(c, float(b)) for c, b in zip(cols, beta[1:])]]
    terms += [(f"se_{c}", float(s)) for c, s in zip(cols, se[1:])]
    terms += [("group_variance", best * var), ("residual_variance", var), ("groups", float(m_of.sum())), ("rows", n)]
    return df.sparkSession.createDataFrame([(t, float(v)) for t, v in terms], "term string, value double")


# ---- trees and forests ---------------------------------------------------------


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """Balanced weight ``w``: rows over (classes times rows of the class)."""
    counts = {r[label]: r["n"] for r in df.groupBy(label).agg(F.count(F.lit(1)).alias("n")).collect()}
    total, k = sum(counts.values()), len(counts)
    weight = None
    for value, n in counts.items():
        hit, w = F.col(label) == value, F.lit(total / (k * n))
        weight = F.when(hit, w) if weight is None else weight.when(hit, w)
    return df.withColumn("w", weight)


def positive_probability(model, rows: DataFrame) -> DataFrame:
    """Predictions with ``probability`` as the chance of class 1 (a squashed margin for models without one)."""
    out = model.transform(rows)
    if "probability" in out.columns:
        p = vector_to_array("probability")
        return out.withColumn("probability", F.coalesce(F.try_element_at(p, F.lit(2)), F.lit(0.0)))
    return out.withColumn("probability", 1 / (1 + F.exp(-vector_to_array("rawPrediction")[1])))


def cross_validate(estimator: Estimator, rows: DataFrame, metrics: Callable[[DataFrame], DataFrame], folds: int, fold: str = "fold", classify: bool = False) -> DataFrame:
    """Out-of-fold predictions of every fold, scored in one grouping by fold."""
    scored = None
    for f in range(folds):
        train, test = rows.filter(F.col(fold) != f), rows.filter(F.col(fold) == f)
        model = estimator.fit(train)
        got = positive_probability(model, test) if classify else model.transform(test)
        got = got.select(fold, "y", "prediction", *(["probability"] if classify else []))
        scored = got if scored is None else scored.unionByName(got)
    return metrics(scored)


def tree_regressor_report(rows: DataFrame, folds: int = 5, depth: int = 2) -> DataFrame:
    """Depth-limited regression tree: cross-validated folds, then the held-out part.

    ``rows`` needs features, y, split (train or test) and fold.
    """
    tree = DecisionTreeRegressor(labelCol="y", maxDepth=depth, minInstancesPerNode=2, seed=42)
    train, test = rows.filter("split = 'train'"), rows.filter("split != 'train'")
    cv = cross_validate(tree, train, lambda d: ev.regression_metrics(d, ["fold"]), folds)
    held = ev.regression_metrics(tree.fit(train).transform(test)).withColumn("fold", F.lit(-1))
    return cv.unionByName(held)


def tree_classifier_report(rows: DataFrame, folds: int = 5, depth: int = 2) -> DataFrame:
    """Balanced-weight classification tree with gini and with entropy, folds and held-out."""
    out = None
    for impurity in ("gini", "entropy"):
        tree = DecisionTreeClassifier(labelCol="y", weightCol="w", maxDepth=depth, minInstancesPerNode=2, impurity=impurity, seed=42)
        train, test = class_weights(rows.filter("split = 'train'"), "y"), rows.filter("split != 'train'")
        cv = cross_validate(tree, train, lambda d: ev.classification_metrics(d, ["fold"]), folds, classify=True)
        held = ev.classification_metrics(positive_probability(tree.fit(train), test)).withColumn("fold", F.lit(-1))
        part = cv.unionByName(held).withColumn("impurity", F.lit(impurity))
        out = part if out is None else out.unionByName(part)
    return out


def fit_and_score(estimator: Estimator, rows: DataFrame, classify: bool = False) -> DataFrame:
    """Fit on ``split = 'train'`` and score the other rows."""
    train, test = rows.filter("split = 'train'"), rows.filter("split != 'train'")
    model = estimator.fit(train)
    if classify:
        return ev.classification_metrics(positive_probability(model, test))
    return ev.regression_metrics(model.transform(test))


def forest(classify: bool = False, trees: int = 100, depth: int = 5, **more) -> Estimator:
    """Random forest; a regression split looks at all features, a classification split at their root."""
    if classify:
        return RandomForestClassifier(labelCol="y", numTrees=trees, maxDepth=depth, seed=42, **more)
    return RandomForestRegressor(labelCol="y", numTrees=trees, maxDepth=depth, seed=42, featureSubsetStrategy="all", **more)


def linear_svc(iterations: int = 100) -> Estimator:
    return LinearSVC(labelCol="y", maxIter=iterations)


# Gradient-boosted trees stand for the four boosting libraries; the presets keep their default depth and rate.
GBT_PRESETS = {
    "gradient": {"maxDepth": 3, "stepSize": 0.1, "maxIter": 100},
    "hist": {"maxDepth": 5, "stepSize": 0.1, "maxIter": 100, "maxBins": 255},
    "xgb": {"maxDepth": 6, "stepSize": 0.3, "maxIter": 100},
    "cat": {"maxDepth": 6, "stepSize": 0.03, "maxIter": 1000},
}


def regressors(iterations: int | None = None, trees: int = 100) -> dict[str, Estimator]:
    """The regressor grid; ``iterations`` overrides the boosting rounds of every preset."""
    def boost(name):
        conf = dict(GBT_PRESETS[name])
        if iterations:
            conf["maxIter"] = iterations
        return GBTRegressor(labelCol="y", seed=42, **conf)

    return {
        "linear": LinearRegression(labelCol="y", solver="normal"),
        "decision_tree": DecisionTreeRegressor(labelCol="y", maxDepth=10, seed=42),
        "random_forest": forest(trees=trees),
        "bagging": forest(trees=10),
        **{f"gbt_{n}": boost(n) for n in GBT_PRESETS},
    }


def classifiers(iterations: int = 100, trees: int = 100) -> dict[str, Estimator]:
    return {
        "logistic": LogisticRegression(labelCol="y", maxIter=iterations),
        "linear_svm": linear_svc(iterations),
        "decision_tree": DecisionTreeClassifier(labelCol="y", seed=42),
        "random_forest": forest(True, trees),
        "gbt": GBTClassifier(labelCol="y", maxIter=iterations, seed=42),
        "bagging": forest(True, 10, featureSubsetStrategy="all"),
    }


def compare(datasets: Mapping[str, DataFrame], models: Mapping[str, Estimator], folds: int, classify: bool = False) -> DataFrame:
    """(dataset, model, fold, metric, score): folds of the training part, and -1 for held-out rows.

    Each dataset needs features, y, split and fold. Its rows are kept for all fits, several of which run
    at a time. Predictions of all models and folds are scored in one grouping, computed now.
    """
    kept = {name: rows.select("features", "y", "split", "fold").persist() for name, rows in datasets.items()}
    grid = [(name, label, f) for name in kept for label in models for f in (*range(folds), -1)]

    def predicted(cell):
        name, label, f = cell
        train, held = kept[name].filter("split = 'train'"), kept[name].filter("split != 'train'")
        fit_on, test = (train, held) if f < 0 else (train.filter(F.col("fold") != f), train.filter(F.col("fold") == f))
        model = models[label].copy().fit(fit_on)
        got = positive_probability(model, test) if classify else model.transform(test)
        return got.select(
            F.lit(name).alias("dataset"), F.lit(label).alias("model"), F.lit(f).alias("fold"), "y", "prediction",
            *(["probability"] if classify else []),
        )

    with ThreadPoolExecutor(FITS) as pool:  # many small jobs each; the cluster runs several at a time
        scored = reduce(DataFrame.unionByName, pool.map(predicted, grid))
    keys = ["dataset", "model", "fold"]
    if classify:
        out = ev.flatten_results(ev.classification_metrics(scored, keys), keys, ["accuracy", "auc"])
    else:
        out = ev.flatten_results(ev.regression_metrics(scored, keys), keys, ["r2", "mae", "pearson"])
    out = cut_lineage(out)
    for rows in kept.values():
        rows.unpersist()
    return out


def adaboost_r2(train: DataFrame, test: DataFrame, rounds: int = 10, depth: int = 3, seed: int = 42) -> DataFrame:
    """AdaBoost.R2 with weighted trees and linear loss; test rows get the weighted median.

    Both frames carry features and y; ``test`` keeps its other columns.
    """
    state = cut_lineage(train.select("features", F.col("y").cast("double").alias("y")).withColumn("w", F.lit(1.0)))
    voices: list[tuple[object, float]] = []
    for t in range(rounds):
        tree = DecisionTreeRegressor(labelCol="y", weightCol="w", maxDepth=depth, seed=seed + t).fit(state)
        error = F.abs(F.col("y") - F.col("prediction"))
        judged = tree.transform(state).withColumn("_e", error)
        top = judged.agg(F.max("_e")).first()[0]
        if not top:
            voices.append((tree, 1.0))
            break
        loss = judged.agg((F.sum(F.col("w") * F.col("_e") / top) / F.sum("w")).alias("l")).first()["l"]
        if loss >= 0.5:
            if not voices:
                voices.append((tree, 1.0))
            break
        beta = loss / (1 - loss)
        voices.append((tree, math.log(1 / beta)))
        state = cut_lineage(judged.select("features", "y", (F.col("w") * F.pow(F.lit(beta), 1 - F.col("_e") / top)).alias("w")))
    out, votes = test, []
    for i, (tree, weight) in enumerate(voices):
        out = tree.setPredictionCol(f"_p{i}").transform(out)
        votes.append(F.struct(F.col(f"_p{i}").alias("p"), F.lit(weight).alias("w")))
    half = sum(w for _, w in voices) / 2
    ranked = F.array_sort(F.array(*votes))
    median = F.aggregate(
        ranked,
        F.struct(F.lit(0.0).alias("sum"), F.lit(None).cast("double").alias("p")),
        lambda acc, v: F.struct(
            (acc["sum"] + v["w"]).alias("sum"),
            F.when(acc["p"].isNull() & (acc["sum"] + v["w"] >= half - 1e-12), v["p"]).otherwise(acc["p"]).alias("p"),
        ),
        lambda acc: acc["p"],
    )
    return out.select(*test.columns, median.alias("prediction"))


# ---- time-ordered validation ---------------------------------------------------


def walk_forward(df: DataFrame, cols: Sequence[str], target: str, day: str = "day", share: float = 0.2, keep: Sequence[str] = ("num_id",), trees: int = 500, depth: int = 5) -> DataFrame:
    """One-step predictions: for each late day a forest fitted on all earlier rows.

    Steps are distinct days, a number bounded by the study. The forests of all steps grow together, a level in
    one scan (``fit_forests``). The draws follow a hash of (keep, day) and the row's values.
    Returns (keep, day, y, prediction); a day with nothing before it has no prediction.
    """
    known = df.filter(F.col(target).isNotNull()).na.drop("any", subset=list(cols))
    y = F.col(target).cast("double")
    rows = cut_lineage(known.select(*keep, day, y.alias("y"), F.array(*[F.col(c).cast("double") for c in cols]).alias("x")))
    days = [r[0] for r in rows.select(day).distinct().orderBy(day).collect()]
    late = days[len(days) - int(len(days) * share):] if share else []
    if not late:
        return rows.select(*keep, day, "y", F.lit(None).cast("double").alias("prediction")).filter(F.lit(False))
    # A row is learned by the steps after its day; the late days up to its own come first.
    first = F.aggregate(F.array(*[F.lit(d) for d in late]), F.lit(0), lambda n, d: n + (d <= F.col(day)).cast("int"))
    rows = rows.withColumn("first", first).withColumn("h", F.xxhash64(*keep, day, "y", "x"))
    model = fit_forests(rows, len(late), trees, depth)
    tested = rows.filter(F.col("first") > 0)
    return tested.select(*keep, day, "y", forest_prediction(tested, model, F.col("x"), F.col("first") - 1).alias("prediction"))


def walk_forward_report(predictions: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return ev.regression_metrics(predictions, by).select(*by, "n", "mae", "mse", "r2")


def expanding_forecast(df: DataFrame, y: str, x: str, key: str = "num_id", day: str = "day", least: int = 8) -> DataFrame:
    """Per person a linear one-step forecast from all earlier rows, once more than ``least`` exist."""
    from pyspark.sql import Window

    past = Window.partitionBy(key).orderBy(day).rowsBetween(Window.unboundedPreceding, -1)
    known = df.filter(F.col(y).isNotNull() & F.col(x).isNotNull())
    guess = F.regr_intercept(y, x).over(past) + F.regr_slope(y, x).over(past) * F.col(x)
    return known.select(key, day, F.col(y).alias("y"), F.when(F.count(F.lit(1)).over(past) > least, guess).alias("prediction"))


# ---- one model per person -------------------------------------------------------

# Rows of a person that one task sums.
SALT_ROWS = 50_000


def per_person_logistic(
    df: DataFrame,
    cols: Sequence[str],
    label: str,
    key: str = "num_id",
    steps: int = 10,
    rate: float = 0.001,
    start: float = 0.0,
) -> DataFrame:
    """A logistic unit per person trained by Adam on all persons at once: (key, w).

    Rows are placed once by (person, salt) and stay there. A person has one salt for each
    ``SALT_ROWS`` rows; the weights are copied to the salts, gradient sums are taken per salt and
    then per person, so a person with very many rows is many small groups.
    ``w`` holds the coefficients, the intercept last.
    """
    b1, b2, tiny = 0.9, 0.999, 1e-8  # Adam's usual constants
    p = len(cols) + 1
    given = df.na.drop("any", subset=[label, *cols]).select(
        key, F.col(label).cast("double").alias("_y"), F.array(*[F.col(c).cast("double") for c in cols], F.lit(1.0)).alias("_x")
    )
    sizes = cut_lineage(given.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).withColumn("_salts", F.ceil(F.col("_n") / SALT_ROWS).cast("int")))
    spread = given.join(sizes, key).withColumn("_salt", F.pmod(F.xxhash64("_x", "_y", F.monotonically_increasing_id()), F.col("_salts")).cast("int"))
    rows = cut_lineage(spread.select(key, "_salt", "_y", "_x").repartition(key, "_salt"))
    zeros = F.array(*[F.lit(0.0)] * p)
    state = sizes.select(key, "_n", "_salts", F.array(*[F.lit(float(start))] * p).alias("w"), zeros.alias("m"), zeros.alias("v"))
    for t in range(1, steps + 1):
        copies = state.select(key, F.explode(F.sequence(F.lit(0), F.col("_salts") - 1)).alias("_salt"), "w")
        score = F.aggregate(F.zip_with("_x", "w", lambda x, w: x * w), F.lit(0.0), lambda s, z: s + z)
        gap = 1 / (1 + F.exp(-score)) - F.col("_y")
        parts = rows.join(copies, [key, "_salt"]).groupBy(key, "_salt").agg(*[F.sum(gap * F.col("_x")[i]).alias(f"_g{i}") for i in range(p)])
        grads = parts.groupBy(key).agg(*[F.sum(f"_g{i}").alias(f"_g{i}") for i in range(p)])
        g = grads.select(key, F.array(*[f"_g{i}" for i in range(p)]).alias("g"))
        both = state.join(g, key).withColumn("g", F.transform("g", lambda x: x / F.col("_n")))
        m = F.zip_with("m", "g", lambda a, b: b1 * a + (1 - b1) * b)
        v = F.zip_with("v", "g", lambda a, b: b2 * a + (1 - b2) * b * b)
        moved = both.select(key, "_n", "_salts", "w", m.alias("m"), v.alias("v"))
        push = F.zip_with("m", "v", lambda a, b: a / (1 - b1**t) / (F.sqrt(b / (1 - b2**t)) + tiny))
        state = moved.select(key, "_n", "_salts", F.zip_with("w", push, lambda w, d: w - rate * d).alias("w"), "m", "v")
        if t % 3 == 0 or t == steps:
            state = cut_lineage(state)
    return state.select(key, "w")


def logistic_accuracy(df: DataFrame, weights: DataFrame, cols: Sequence[str], label: str, key: str = "num_id") -> DataFrame:
    """Accuracy and mean cross-entropy of each person's unit on the given rows."""
    x = F.array(*[F.col(c).cast("double") for c in cols], F.lit(1.0))
    score = F.aggregate(F.zip_with(x, F.col("w"), lambda a, b: a * b), F.lit(0.0), lambda s, z: s + z)
    p = 1 / (1 + F.exp(-score))
    y: Column = F.col(label).cast("double")
    safe = F.greatest(F.lit(1e-12), F.least(F.lit(1 - 1e-12), p))
    return df.na.drop("any", subset=[label, *cols]).join(weights, key).groupBy(key).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(((p > 0.5).cast("double") == y).cast("double")).alias("accuracy"),
        F.avg(-(y * F.log(safe) + (1 - y) * F.log(1 - safe))).alias("loss"),
    )
