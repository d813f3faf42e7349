"""Scaling, outliers, Box-Cox and residuals.

Every fit is an aggregate whose size depends on the number of columns; only that
reaches the driver, and the transform is a projection.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dayspan.functions.tails import grubbs_critical
from dayspan.operators.clean import replace_columns


def zscore(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Centre and divide by the population SD; a constant column becomes zero."""
    s = df.agg(*[F.avg(c).alias(f"m_{c}") for c in cols], *[F.stddev_pop(c).alias(f"s_{c}") for c in cols]).first()
    return replace_columns(
        df,
        {c: (F.col(c) - F.lit(s[f"m_{c}"])) / F.lit(s[f"s_{c}"] or 1.0) for c in cols if s[f"m_{c}"] is not None},
    )


def minmax_nonzero(df: DataFrame, cols: Sequence[str], alpha: float | None = 0.05) -> DataFrame:
    """Scale the non-zero values to 0..1; zeros become missing, then Grubbs outliers too."""
    some = {c: F.nullif(F.col(c).cast("double"), F.lit(0.0)) for c in cols}
    s = df.agg(
        *[F.min(e).alias(f"lo_{c}") for c, e in some.items()],
        *[F.max(e).alias(f"hi_{c}") for c, e in some.items()],
        *[F.count(e).alias(f"n_{c}") for c, e in some.items()],
    ).first()
    scaled = {}
    for c, e in some.items():
        if s[f"n_{c}"] > 1:
            span = (s[f"hi_{c}"] - s[f"lo_{c}"]) or 1.0
            scaled[c] = (e - F.lit(s[f"lo_{c}"])) / F.lit(span)
        else:
            scaled[c] = F.lit(None).cast("double")
    out = replace_columns(df, scaled)
    return grubbs_outliers(out, cols, alpha) if alpha else out


def grubbs_bounds(df: DataFrame, cols: Sequence[str], alpha: float = 0.05, batch: int = 2000) -> dict[str, tuple[float, float] | None]:
    """Interval of values that survive the iterated two-sided Grubbs test, per column.

    Each round removes the value furthest from the mean, which is the smallest or
    the largest left. So the rounds need only n, the two moments and the ends of
    the ordered values; the ends are read in batches until the test stops.
    """
    stats = df.agg(
        *[F.count(c).alias(f"n_{c}") for c in cols],
        *[F.avg(c).alias(f"m_{c}") for c in cols],
        *[F.var_pop(c).alias(f"v_{c}") for c in cols],
    ).first()
    return {c: _one_column(df, c, stats[f"n_{c}"], stats[f"m_{c}"], stats[f"v_{c}"], alpha, batch) for c in cols}


def _ends(df: DataFrame, col: str, low: bool, beyond: float | None, batch: int) -> list[tuple[float, int]]:
    """Next distinct values with their counts from one end."""
    values = df.filter(F.col(col).isNotNull())
    if beyond is not None:
        values = values.filter(F.col(col) > beyond if low else F.col(col) < beyond)
    counted = values.groupBy(F.col(col).alias("x")).agg(F.count(F.lit(1)).alias("n"))
    order = F.asc("x") if low else F.desc("x")
    return [(float(r["x"]), r["n"]) for r in counted.orderBy(order).limit(batch).collect()]


def _one_column(df, col, n, mean, var, alpha, batch):
    if n < 3 or not var:
        return None
    shift, total, squares = mean, 0.0, var * n  # sums of deviations from the first mean
    sides = {True: _ends(df, col, True, None, batch), False: _ends(df, col, False, None, batch)}
    at = {True: [0, 0], False: [0, 0]}  # index into the batch, rows already taken from that value
    while n >= 3:
        centre = shift + total / n
        sd = math.sqrt(max(0.0, (squares - total * total / n) / (n - 1)))
        for low in (True, False):
            if at[low][0] >= len(sides[low]):
                more = _ends(df, col, low, sides[low][-1][0], batch)
                if not more:
                    return None
                sides[low], at[low] = more, [0, 0]
        x_low, x_high = sides[True][at[True][0]][0], sides[False][at[False][0]][0]
        low = centre - x_low > x_high - centre
        x = x_low if low else x_high
        if not abs(x - centre) > grubbs_critical(n, alpha) * sd:
            return x_low, x_high
        d = x - shift
        n, total, squares = n - 1, total - d, squares - d * d
        at[low][1] += 1
        if at[low][1] >= sides[low][at[low][0]][1]:
            at[low] = [at[low][0] + 1, 0]
    return None


def grubbs_outliers(df: DataFrame, cols: Sequence[str], alpha: float = 0.05) -> DataFrame:
    """Values removed by the iterated Grubbs test become missing."""
    bounds = grubbs_bounds(df, cols, alpha)
    return replace_columns(
        df, {c: F.when(F.col(c).between(b[0], b[1]), F.col(c)) for c, b in bounds.items() if b is not None}
    )


# Half-width and number of grid points of each pass of the Box-Cox search.
BOXCOX_PASSES = ((5.0, 11), (0.5, 5), (0.1, 5), (0.02, 5), (0.004, 5))


def boxcox_lambdas(df: DataFrame, cols: Sequence[str]) -> dict[str, float | None]:
    """Maximum-likelihood Box-Cox exponent per column; None for a column with a negative value.

    Every pass scores a few exponents for all columns in one aggregate and moves
    to the vertex of the parabola through the best three.
    """
    low = df.agg(*[F.min(c).alias(c) for c in cols]).first()
    shifted = {c: F.col(c) + 1e-6 if low[c] is not None and low[c] <= 0 else F.col(c) for c in cols}
    usable = [c for c in cols if low[c] is not None and low[c] >= 0]
    if not usable:
        return dict.fromkeys(cols)
    logs = df.agg(*[F.avg(F.log(shifted[c])).alias(c) for c in usable]).first()
    best = dict.fromkeys(usable, 0.0)
    for width, points in BOXCOX_PASSES:
        grid = {c: np.linspace(best[c] - width, best[c] + width, points) for c in usable}
        aggs = []
        for c in usable:
            z = F.log(shifted[c]) - F.lit(logs[c])
            for i, lam in enumerate(grid[c]):
                y = z if abs(lam) < 1e-9 else (F.exp(z * F.lit(float(lam))) - 1) / F.lit(float(lam))
                aggs.append(F.var_pop(y).alias(f"{c}|{i}"))
        row = df.agg(*aggs).first()
        for c in usable:
            # With x scaled by its geometric mean the likelihood is -n/2 log(variance).
            score = [math.log(row[f"{c}|{i}"]) if row[f"{c}|{i}"] else 0.0 for i in range(points)]
            i = int(np.argmin(score))
            best[c] = float(grid[c][i])
            if 0 < i < points - 1:
                left, mid, right = score[i - 1 : i + 2]
                bend = left - 2 * mid + right
                if bend > 0:
                    best[c] += 0.5 * (left - right) / bend * float(grid[c][1] - grid[c][0])
    return {c: best.get(c) for c in cols}


def boxcox(df: DataFrame, cols: Sequence[str]) -> tuple[DataFrame, dict[str, float | None]]:
    """Box-Cox transformed columns and their exponents; zeros are shifted by 1e-6."""
    lams = boxcox_lambdas(df, cols)
    low = df.agg(*[F.min(c).alias(c) for c in cols]).first()
    new = {}
    for c, lam in lams.items():
        if lam is None:
            continue
        x = F.col(c) + 1e-6 if low[c] <= 0 else F.col(c)
        new[c] = F.log(x) if abs(lam) < 1e-12 else (F.pow(x, F.lit(lam)) - 1) / F.lit(lam)
    return replace_columns(df, new), lams


def least_squares(df: DataFrame, targets: Sequence[str], covariates: Sequence[str]) -> Mapping[str, np.ndarray]:
    """Intercept and slopes of each target on the covariates, from centred cross products."""
    known = {t: F.col(t).isNotNull() for t in targets}
    for t in targets:
        for c in covariates:
            known[t] = known[t] & F.col(c).isNotNull()
    cell = {(t, c): F.when(known[t], F.col(c).cast("double")) for t in targets for c in (*covariates, t)}
    means = df.agg(*[F.avg(e).alias(f"{t}|{c}") for (t, c), e in cell.items()]).first()
    aggs = []
    for t in targets:
        names = [*covariates, t]
        dev = {c: cell[(t, c)] - F.lit(means[f"{t}|{c}"]) for c in names}
        for i, a in enumerate(names):
            for b in names[i:]:
                aggs.append(F.sum(dev[a] * dev[b]).alias(f"{t}|{a}|{b}"))
    row = df.agg(*aggs).first()
    out = {}
    for t in targets:
        p = len(covariates)
        xx, xy = np.zeros((p, p)), np.zeros(p)
        for i, a in enumerate(covariates):
            xy[i] = row[f"{t}|{a}|{t}"] or 0.0
            for j in range(i, p):
                xx[i, j] = xx[j, i] = row[f"{t}|{a}|{covariates[j]}"] or 0.0
        slopes = np.linalg.lstsq(xx, xy, rcond=None)[0]
        centre = means[f"{t}|{t}"]
        if centre is None:
            out[t] = None
            continue
        intercept = centre - sum(s * means[f"{t}|{c}"] for s, c in zip(slopes, covariates))
        out[t] = np.concatenate([[intercept], slopes])
    return out


def residualise(df: DataFrame, targets: Sequence[str], covariates: Sequence[str]) -> DataFrame:
    """Replace each target by its residual after regression on the covariates."""
    fits = least_squares(df, targets, covariates)
    new = {}
    for t, b in fits.items():
        if b is None:
            continue
        fitted = F.lit(float(b[0]))
        for s, c in zip(b[1:], covariates):
            fitted = fitted + F.col(c) * F.lit(float(s))
        new[t] = F.col(t) - fitted
    return replace_columns(df, new)
