"""Principal components per group of variables, and merging the scores back."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dayspan.functions.sums import summed

# Columns up to which the covariance is aggregated as expressions, and rows a worker multiplies together.
WIDE, PART_ROWS = 16, 4096


def pca_fit(df: DataFrame, cols: Sequence[str], k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Means, loadings (k x p) and explained variance shares.

    The covariance is one aggregate, or for more than ``WIDE`` columns, where that would be
    thousands of expressions, one matrix product per part of rows. The sign of each component
    makes its largest loading positive.
    """
    p = len(cols)
    means = df.agg(F.count(F.lit(1)).alias("_n"), *[F.avg(c).alias(f"_m{i}") for i, c in enumerate(cols)]).first()
    n = means["_n"]
    mu = np.array([means[f"_m{i}"] if means[f"_m{i}"] is not None else 0.0 for i in range(p)])
    dev = [F.col(c).cast("double") - F.lit(float(m)) for c, m in zip(cols, mu)]
    cov = np.zeros((p, p))
    if p > WIDE:
        cov = summed(df.select(F.array(*dev).alias("x")), lambda x: (x.T @ x).ravel(), p * p, PART_ROWS).reshape(p, p) / max(1, n - 1)
    else:
        cells = [(i, j) for i in range(p) for j in range(i, p)]
        row = df.agg(*[F.sum(dev[i] * dev[j]).alias(f"{i}|{j}") for i, j in cells]).first()
        for i, j in cells:
            cov[i, j] = cov[j, i] = (row[f"{i}|{j}"] or 0.0) / max(1, n - 1)
    values, vectors = np.linalg.eigh(cov)
    order = np.argsort(values)[::-1][:k]
    load = vectors[:, order].T
    load = np.array([v * np.sign(v[np.argmax(np.abs(v))] or 1.0) for v in load])
    return mu, load, values[order] / (values.sum() or 1.0)


def score_columns(cols: Sequence[str], mu: np.ndarray, load: np.ndarray, prefix: str):
    """Projection of a row on each component as plain arithmetic."""
    out = []
    for x, vector in enumerate(load):
        total = F.lit(0.0)
        for c, m, w in zip(cols, mu, vector):
            total = total + (F.col(c) - F.lit(float(m))) * F.lit(float(w))
        out.append(total.alias(f"{prefix}PC{x + 1}"))
    return out


def pca_by_cluster(
    df: DataFrame, clusters: Mapping[str, int], keys: Sequence[str], k: int = 1
) -> tuple[DataFrame, DataFrame]:
    """Scores ``c{i}_PC{x}`` with their keys, and the model table, one PCA per variable cluster."""
    rows = df.na.drop("any").persist()
    scores, model = [], []
    for i in sorted(set(clusters.values())):
        cols = [c for c in df.columns if clusters.get(c) == i]
        if not cols:
            continue
        mu, load, share = pca_fit(rows, cols, min(k, len(cols)))
        scores += score_columns(cols, mu, load, f"c{i}_")
        for x in range(len(load)):
            model += [(i, f"PC{x + 1}", c, float(load[x, j]), float(mu[j]), float(share[x])) for j, c in enumerate(cols)]
    table = df.sparkSession.createDataFrame(
        model, "cluster int, component string, variable string, loading double, mean double, explained double"
    )
    return rows.select(*keys, *scores), table


def project(df: DataFrame, cols: Sequence[str], keys: Sequence[str], k: int = 2) -> DataFrame:
    """First k components of complete rows."""
    rows = df.na.drop("any", subset=list(cols))
    mu, load, _ = pca_fit(rows, cols, k)
    return rows.select(*keys, *score_columns(cols, mu, load, ""))


def merge_scores(df: DataFrame, scores: DataFrame, on: Sequence[str], names: Mapping[str, str]) -> DataFrame:
    """Inner join of named component scores onto the panel by key."""
    return df.join(scores.select(*on, *[F.col(c).alias(n) for c, n in names.items()]), list(on))
