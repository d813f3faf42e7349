"""How much each feature moves a tree model's predictions."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


@dataclass
class Leaf:
    """One leaf: its share of the prediction, and per feature on its path the tests and the share of training rows."""

    value: float
    features: list[int]
    tests: list[list[tuple[str, object]]]
    covers: list[float]
    table: np.ndarray | None = None


# Features on a path up to which a leaf keeps its contributions for every pattern of passed tests.
TABLE_FEATURES = 10


def _passes(column: np.ndarray, test: tuple[str, object]) -> np.ndarray:
    kind, bound = test
    if kind == "in":
        return np.isin(column, bound)
    if kind == "out":
        return ~np.isin(column, bound)
    return column <= bound if kind == "low" else column > bound


def leaves(model) -> list[Leaf]:
    """The leaves of all trees of a fitted tree, forest or boosted model, weighted as the model adds them."""
    trees = list(model.trees) if hasattr(model, "trees") else [model]
    weights = list(model.treeWeights) if hasattr(model, "treeWeights") else [1.0]
    scale = 1.0 if "GBT" in type(model).__name__ else 1.0 / sum(weights)
    found = []

    def walk(node, weight, path):
        if node.numDescendants() == 0:
            merged: dict[int, tuple[list, float]] = {}
            for feature, test, cover in path:
                tests, share = merged.get(feature, ([], 1.0))
                merged[feature] = ([*tests, test], share * cover)
            found.append(Leaf(weight * node.prediction(), list(merged), [t for t, _ in merged.values()], [c for _, c in merged.values()]))
            return
        split, rows = node.split(), node.impurityStats().count()
        if "Continuous" in split.getClass().getSimpleName():
            tests = ("low", split.threshold()), ("high", split.threshold())
        else:
            left = [float(c) for c in split.leftCategories()]
            tests = ("in", left), ("out", left)
        for child, test in zip((node.leftChild(), node.rightChild()), tests):
            walk(child, weight, [*path, (split.featureIndex(), test, child.impurityStats().count() / rows)])

    for tree, weight in zip(trees, weights):
        walk(tree._java_obj.rootNode(), weight * scale, [])
    for leaf in found:
        m = len(leaf.features)
        leaf.tests = [_narrowest(tests) for tests in leaf.tests]
        if 0 < m <= TABLE_FEATURES:
            patterns = (np.arange(2**m)[:, None] >> np.arange(m) & 1).astype(float)
            leaf.table = leaf.value * leaf_contributions(patterns, leaf.covers)
    return found


def _narrowest(tests: Sequence[tuple[str, object]]) -> list[tuple[str, object]]:
    """The same tests with one bound on each side."""
    low, high = [b for kind, b in tests if kind == "low"], [b for kind, b in tests if kind == "high"]
    kept = [t for t in tests if t[0] in ("in", "out")]
    return kept + ([("low", min(low))] if low else []) + ([("high", max(high))] if high else [])


def leaf_contributions(passes: np.ndarray, covers: Sequence[float]) -> np.ndarray:
    """Shapley values of a leaf of value 1: rows x features on its path.

    ``passes`` says which features let a row through. A known feature counts as that, an unknown
    one as the share of training rows that went this way. The sum over all sets of known features
    is read from the coefficients of a product with one factor for each other feature.
    """
    n, m = passes.shape
    out = np.zeros((n, m))
    sizes = np.array([math.factorial(k) * math.factorial(m - 1 - k) / math.factorial(m) for k in range(m)])
    for j in range(m):
        terms = np.zeros((n, m))
        terms[:, 0] = 1.0
        for i in range(m):
            if i != j:
                terms[:, 1:] = terms[:, 1:] * covers[i] + terms[:, :-1] * passes[:, i : i + 1]
                terms[:, 0] *= covers[i]
        out[:, j] = (terms @ sizes) * (passes[:, j] - covers[j])
    return out


def contributions(found: Sequence[Leaf], x: np.ndarray) -> np.ndarray:
    """Rows x features. Rows that meet a leaf alike share one calculation, kept with the leaf where its path is short."""
    columns = np.ascontiguousarray(x.T)
    out = np.zeros(columns.shape)
    for leaf in found:
        if not leaf.features:
            continue
        passes = [np.logical_and.reduce([_passes(columns[f], t) for t in tests]) for f, tests in zip(leaf.features, leaf.tests)]
        if leaf.table is not None:
            which, table = sum(p.astype(np.int64) << j for j, p in enumerate(passes)), leaf.table
        else:
            alike, which = np.unique(np.stack(passes, 1), axis=0, return_inverse=True)
            which, table = which.reshape(-1), leaf.value * leaf_contributions(alike.astype(float), leaf.covers)
        for j, f in enumerate(leaf.features):
            out[f] += table[:, j][which]
    return out.T


def base_value(found: Sequence[Leaf]) -> float:
    """The prediction when no feature is known."""
    return float(sum(leaf.value * math.prod(leaf.covers) for leaf in found))


def shapley_rows(model, df: DataFrame, cols: Sequence[str], key: str) -> DataFrame:
    """(key, feature, contribution): exact Shapley values along the paths of the model's trees.

    A row's contributions and the base value add up to its prediction. There is no background
    sample and no drawn order; the work is rows times leaves. Rows with a gap are left out.
    """
    found = leaves(model)
    return _shapley(found, df, cols, key)


def _shapley(found: Sequence[Leaf], df: DataFrame, cols: Sequence[str], key: str) -> DataFrame:
    rows = df.na.drop("any", subset=list(cols)).select(key, F.array(*[F.col(c).cast("double") for c in cols]).alias("x"))
    given = df.sparkSession.sparkContext.broadcast(list(found))  # as large as the model
    names = list(cols)

    def work(batches):
        for batch in batches:
            if batch.num_rows:
                x = np.asarray(batch.column(1).flatten()).reshape(batch.num_rows, -1)
                keys = batch.column(0).take(pa.array(np.repeat(np.arange(len(x)), len(names))))
                yield pa.RecordBatch.from_arrays([keys, pa.array(names * len(x)), pa.array(contributions(given.value, x).ravel())], names=[key, "feature", "contribution"])

    schema = StructType([df.schema[key], *StructType.fromDDL("feature string, contribution double").fields])
    return rows.mapInArrow(work, schema)


def attribution_summary(model, df: DataFrame, cols: Sequence[str], key: str) -> DataFrame:
    """Mean absolute contribution per feature next to the model's own importance.

    Rows between the same bounds of the model have the same contributions: they are counted first, so the work
    is that of the distinct cells, dealt over all tasks again.
    """
    own = [float(x) for x in model.featureImportances.toArray()] if hasattr(model, "featureImportances") else [None] * len(cols)
    table = df.sparkSession.createDataFrame(list(zip(cols, own)), "feature string, importance double")
    found = leaves(model)
    cells = df.na.drop("any", subset=list(cols)).select(*[_cell(found, i, F.col(c).cast("double")).alias(c) for i, c in enumerate(cols)])
    counted = cells.groupBy(*cols).agg(F.count(F.lit(1)).alias("_n")).repartition(4 * df.sparkSession.sparkContext.defaultParallelism, *cols)
    size = F.sum(F.col("_n") * F.abs("contribution")) / F.sum("_n")
    mean = _shapley(found, counted, cols, "_n").groupBy("feature").agg(size.alias("mean_abs"))
    return mean.join(F.broadcast(table), "feature")  # one row for each column


def _cell(found: Sequence[Leaf], feature: int, x: Column) -> Column:
    """The least bound of the model at or over the value, which meets every test as the value does; categories stay."""
    tests = [t for leaf in found for f, ts in zip(leaf.features, leaf.tests) if f == feature for t in ts]
    if any(kind in ("in", "out") for kind, _ in tests):
        return x
    bounds = sorted({float(b) for _, b in tests})
    over = F.filter(F.array(*[F.lit(b) for b in bounds]), lambda b: b >= x) if bounds else F.array().cast("array<double>")
    return F.coalesce(F.get(over, F.lit(0)), F.lit(float("inf")))
