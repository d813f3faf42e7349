"""Feature selection: variance, collinearity, stability."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dayspan.functions.sums import summed
from dayspan.operators.correlation import _long, corr_matrix, symmetric
from dayspan.session import cut_lineage


def variances(df: DataFrame, cols: Sequence[str], threshold: float = 0.005) -> DataFrame:
    """Population variance per column and whether it exceeds the threshold."""
    wide = df.agg(*[F.var_pop(c).alias(c) for c in cols])
    return wide.unpivot([], list(cols), "variable", "variance").withColumn(
        "keep", F.coalesce(F.col("variance") > threshold, F.lit(False)).cast("int")
    )


def variance_filter(df: DataFrame, cols: Sequence[str], threshold: float = 0.005) -> DataFrame:
    low = {r["variable"] for r in variances(df, cols, threshold).filter("keep = 0").collect()}
    return df.drop(*low)


def collinear_drops(df: DataFrame, target: str, cols: Sequence[str], threshold: float = 0.9) -> DataFrame:
    """Columns to drop: of each pair above the threshold the one less tied to the target.

    On a tie both columns of the pair go. The join is over columns, not rows.
    """
    pairs = symmetric(corr_matrix(df, cols)).withColumn("r", F.abs("r")).filter(F.col("r") > threshold)
    ties = _long(df, [], [(c, target) for c in cols]).select(
        F.col("var_i").alias("v"), F.coalesce(F.abs("r"), F.lit(0.0)).alias("t")
    )
    a = ties.select(F.col("v").alias("var_i"), F.col("t").alias("t_i"))
    b = ties.select(F.col("v").alias("var_j"), F.col("t").alias("t_j"))
    judged = pairs.join(a, "var_i").join(b, "var_j")
    loser = F.when(F.col("t_i") >= F.col("t_j"), F.col("var_j")).otherwise(F.col("var_i"))
    return judged.select(loser.alias("variable")).distinct()


# Rows a worker looks at together: in the passes before and after the steps, and in a step, one bootstrap at a time.
PART_ROWS, STEP_ROWS = 256, 1024


def poisson_cuts(rate: float, bits: int = 30) -> np.ndarray:
    """Distribution function of the Poisson draw that says how often a row enters a bootstrap."""
    total, cuts, k = 0.0, [], 0
    while 1 - total > 2.0**-bits:
        total += math.exp(-rate) * rate**k / math.factorial(k)
        cuts.append(total)
        k += 1
    return np.array(cuts)


def _mixed(h: np.ndarray) -> np.ndarray:
    """Spreads 64-bit numbers (two multiply-and-shift rounds)."""
    for factor in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB):
        h = (h ^ (h >> np.uint64(30))) * np.uint64(factor)
    return h ^ (h >> np.uint64(31))


class Draws:
    """Weights and folds of rows in all bootstraps, from a hash of their key alone."""

    def __init__(self, samples: int, folds: int, rate: float):
        self.salt = np.arange(1, samples + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        self.folds, self.cuts = folds, poisson_cuts(rate)

    def __call__(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        h = _mixed(keys.view(np.uint64)[:, None] + self.salt[None, :])
        w = np.searchsorted(self.cuts, (h >> np.uint64(34)) * 2.0**-30, "right").astype(float)
        return w, (_mixed(h + np.uint64(1)) % np.uint64(self.folds)).astype(np.int64)


def _columns(w: np.ndarray, fold: np.ndarray, folds: int) -> np.ndarray:
    """Rows x (bootstrap, left-out fold; the last: none): weight of a row in the fits of one penalty."""
    return np.stack([w * (fold != f) for f in range(folds)] + [w], 2).reshape(len(w), -1)


def _slopes(xs: np.ndarray, ys: np.ndarray, w: np.ndarray, fold: np.ndarray, folds: int, at: np.ndarray) -> np.ndarray:
    """Sums over rows of the logistic gradients of all fits, columns x (bootstrap, penalty, left-out fold).

    A bootstrap looks only at the rows it has drawn, about half of them, and its numbers stay in the cache.
    """
    out, wide = np.zeros_like(at), at.shape[1] // w.shape[1]
    left_out = np.arange(folds + 1)[:, None]  # the last number is no fold
    for s, (often, part) in enumerate(zip(np.ascontiguousarray(w.T), np.ascontiguousarray(fold.T))):
        drawn, own = np.flatnonzero(often), slice(s * wide, (s + 1) * wide)
        x = xs[drawn]
        m = at[:, own].T @ x.T
        np.clip(m, -40, 40, out=m)
        np.negative(m, out=m)
        np.exp(m, out=m)
        m += 1
        np.divide(1, m, out=m)
        m -= ys[drawn]
        each = m.reshape(wide // (folds + 1), folds + 1, len(drawn))
        each *= often[drawn] * (part[drawn] != left_out)
        out[:, own] = (m @ x).T
    return out


def stability_select(
    df: DataFrame,
    label: str,
    cols: Sequence[str],
    key: Sequence[str],
    samples: int = 200,
    threshold: float = 0.1,
    penalties: Sequence[float] = (0.1, 0.01, 0.001),
    folds: int = 5,
    max_iter: int = 100,
    tol: float = 1e-5,
    rate: float = 0.7,
) -> DataFrame:
    """Mean absolute coefficient over bootstraps of an L1 logistic model, and the choice.

    The fits of all bootstraps, left-out folds and penalties are the columns of one weight matrix
    and take accelerated proximal gradient steps together, so a step is one scan of the rows
    whatever the number of fits. A bootstrap is a Poisson weight from a hash of the row key: no
    resampled copy exists, and a lost executor redraws the same sample. Of each bootstrap the
    penalty with the best mean accuracy on its left-out folds counts (ties: the larger one).
    Columns are standardised by their spread over all rows; coefficients are in the columns' units.
    """
    rows = df.na.drop("any", subset=[*cols, label])
    spread = rows.agg(F.count(F.lit(1)).alias("n"), *[F.avg(c).alias(f"m{i}") for i, c in enumerate(cols)], *[F.stddev_pop(c).alias(f"s{i}") for i, c in enumerate(cols)]).first()
    p, n_pen = len(cols), len(penalties)
    if spread["m0"] is None:
        return df.sparkSession.createDataFrame([(c, 0.0, 0) for c in cols], "variable string, mean_coef double, selected int")
    sd = np.array([spread[f"s{i}"] for i in range(p)])
    unit = np.where(sd > 0, sd, 1.0)
    x = F.array(*[(F.col(c).cast("double") - F.lit(spread[f"m{i}"])) / F.lit(float(unit[i])) for i, c in enumerate(cols)], F.lit(1.0))
    # The rows are few bytes and much work: every task gets its share, but no fewer rows than a step looks at together.
    tasks = max(1, min(2 * df.sparkSession.sparkContext.defaultParallelism, spread["n"] // STEP_ROWS))
    base = cut_lineage(rows.select(x.alias("x"), F.col(label).cast("double").alias("y"), F.xxhash64(*key).alias("h")).repartition(tasks, "h"))
    draws = Draws(samples, folds, rate)
    fits = samples * (folds + 1) * n_pen  # by bootstrap, penalty and left-out fold
    strength = np.tile(np.repeat(np.array(penalties, float), folds + 1), samples)

    def sizes(xs, ys, keys):
        w = _columns(*draws(keys), folds)
        return np.concatenate([w.sum(0), (xs * xs).sum(1) @ w])

    got = summed(base, sizes, 2 * fits // n_pen, PART_ROWS).reshape(2, samples, 1, folds + 1).repeat(n_pen, 2).reshape(2, fits)
    total = np.maximum(got[0], 1e-12)
    step = 4.0 * total / np.maximum(got[1], 1e-12)  # a quarter of the trace bounds the curvature
    beta = np.zeros((p + 1, fits))
    ahead, t = beta.copy(), 1.0
    for _ in range(max_iter):
        at = ahead

        def gradient(xs, ys, keys, at=at):
            return _slopes(xs, ys, *draws(keys), folds, at).ravel()

        slope = summed(base, gradient, (p + 1) * fits, STEP_ROWS).reshape(p + 1, fits) / total
        new = at - step * slope
        shrink = step * strength
        new[:p] = np.sign(new[:p]) * np.maximum(np.abs(new[:p]) - shrink, 0.0)
        turn = ((at - new) * (new - beta)).sum(0) > 0  # past the slope: start the momentum again
        nxt = (1 + math.sqrt(1 + 4 * t * t)) / 2
        ahead = new + np.where(turn, 0.0, (t - 1) / nxt) * (new - beta)
        moved, beta, t = float(np.abs(new - beta).max()), new, nxt
        if moved < tol:
            break
    tested = np.arange(fits).reshape(samples, n_pen, folds + 1).transpose(0, 2, 1)

    def hits(xs, ys, keys):
        w, fold = draws(keys)
        right = ((xs @ beta > 0) == (ys[:, None] > 0.5)).reshape(len(ys), samples, n_pen, folds + 1).transpose(0, 1, 3, 2)
        out, seen = np.zeros((samples, folds, n_pen)), np.zeros((samples, folds))
        for f in range(folds):
            here = w * (fold == f)
            out[:, f] = np.einsum("rs,rsp->sp", here, right[:, :, f])
            seen[:, f] = here.sum(0)
        return np.concatenate([out.ravel(), seen.ravel()])

    judged = summed(base, hits, samples * folds * (n_pen + 1), PART_ROWS)
    right = judged[:samples * folds * n_pen].reshape(samples, folds, n_pen) / np.maximum(judged[samples * folds * n_pen:], 1e-12).reshape(samples, folds, 1)
    order = np.argsort(-np.array(penalties, float), kind="stable")
    best = order[right.mean(1)[:, order].argmax(1)]
    chosen = beta[:p, tested[np.arange(samples), folds, best]]
    mean = np.abs(chosen / unit[:, None]).mean(1)
    table = [(c, float(m), int(m > threshold)) for c, m in zip(cols, mean)]
    return df.sparkSession.createDataFrame(table, "variable string, mean_coef double, selected int")
