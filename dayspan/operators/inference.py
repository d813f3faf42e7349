"""Group comparisons: Kolmogorov-Smirnov, Kruskal-Wallis, Welch, Cohen."""

from __future__ import annotations

import math
from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dayspan.functions.ordered import average_ranks, running_totals
from dayspan.functions.tails import chi2_tail, t_two_sided


def ks_p(d: Column, n: Column, m: Column) -> Column:
    """Asymptotic two-sided p-value as a column; the short series serves small arguments."""
    x = d * F.sqrt(n * m / (n + m))
    y = F.exp(F.try_divide(F.lit(-(math.pi**2) / 8), x * x))
    near = 1 - F.try_divide(F.lit(math.sqrt(2 * math.pi)), x) * (y + F.pow(y, 9) + F.pow(y, 25) + F.pow(y, 49))
    far = F.aggregate(
        F.sequence(F.lit(1), F.lit(60)),
        F.lit(0.0),
        lambda acc, k: acc + F.when(k % 2 == 1, 2.0).otherwise(-2.0) * F.exp(-2.0 * k * k * x * x),
    )
    return F.when(x < 1e-9, F.lit(1.0)).when(x < 1.18, near).otherwise(F.least(F.lit(1.0), far))


def ks_two_sample(df: DataFrame, value: str, first: Column, by: Sequence[str] = ()) -> DataFrame:
    """Largest gap between the two empirical distributions; ``first`` marks sample one."""
    by = list(by)
    counts = (
        df.filter(F.col(value).isNotNull())
        .groupBy(*by, value)
        .agg(F.count_if(first).alias("a"), F.count_if(~first).alias("b"))
    )
    ranked = running_totals(counts, by, value, ["a", "b"])
    gap = F.abs(F.try_divide("cum_a", "tot_a") - F.try_divide("cum_b", "tot_b"))
    out = ranked.groupBy(*by).agg(
        F.max("tot_a").alias("n_a"), F.max("tot_b").alias("n_b"), F.max(gap).alias("statistic")
    )
    return out.withColumn("p_value", ks_p(F.col("statistic"), F.col("n_a"), F.col("n_b")))


def kruskal_wallis(df: DataFrame, label: str, cols: Sequence[str]) -> DataFrame:
    """H with tie correction and its chi-squared tail, per feature."""
    long = df.unpivot([label], list(cols), "feature", "x").filter(F.col("x").isNotNull() & F.col(label).isNotNull())
    ranks = average_ranks(long, "x", ["feature"], [label])
    group = ranks.groupBy("feature", label).agg(
        F.sum("n").alias("n"),
        F.sum(F.col("n") * F.col("rank")).alias("r"),
        F.sum(F.col("n") * (F.col("ties") * F.col("ties") - 1.0)).alias("t"),
    )
    n = F.sum("n")
    out = group.groupBy("feature").agg(
        n.alias("n"),
        F.count(F.lit(1)).alias("groups"),
        F.sum(F.col("r") * F.col("r") / F.col("n")).alias("s"),
        F.sum("t").alias("t"),
    )
    total = F.col("n").cast("double")
    raw = 12.0 / (total * (total + 1)) * F.col("s") - 3 * (total + 1)
    tie = 1 - F.try_divide(F.col("t"), total * total * total - total)
    rows = out.select("feature", "n", "groups", F.try_divide(raw, F.nullif(tie, F.lit(0.0))).alias("h")).collect()
    return df.sparkSession.createDataFrame(
        [(r["feature"], r["n"], r["groups"], r["h"], None if r["h"] is None else chi2_tail(r["h"], r["groups"] - 1)) for r in rows],
        "feature string, n long, groups long, h double, p_value double",
    )


def _moments(df: DataFrame, label: str, col: str):
    known = df.filter(F.col(label).isNotNull())
    return sorted(
        known.groupBy(label).agg(F.count(col).alias("n"), F.avg(col).alias("m"), F.var_samp(col).alias("v")).collect(),
        key=lambda r: r[label],
    )


def welch_t(df: DataFrame, label: str, col: str) -> DataFrame:
    """Welch's t for every pair of groups, null for a group of under two values or a pair without spread.

    Pairs are of group moments, one row per cluster.
    """
    rows = []
    for a, b in combinations(_moments(df, label, col), 2):
        names = (str(a[label]), str(b[label]), a["n"], b["n"])
        if min(a["n"], b["n"]) < 2 or a["v"] + b["v"] == 0:
            rows.append((*names, None, None, None))
            continue
        va, vb = a["v"] / a["n"], b["v"] / b["n"]
        t = (a["m"] - b["m"]) / math.sqrt(va + vb)
        dof = (va + vb) ** 2 / (va**2 / (a["n"] - 1) + vb**2 / (b["n"] - 1))
        rows.append((*names, t, dof, t_two_sided(t, dof)))
    return df.sparkSession.createDataFrame(
        rows, "group_a string, group_b string, n_a long, n_b long, t double, dof double, p_value double"
    )


def cohens_d(df: DataFrame, label: str, col: str) -> DataFrame:
    """Mean difference in units of the pooled SD for every pair of groups, null for a group of under two values."""
    rows = []
    for a, b in combinations(_moments(df, label, col), 2):
        if min(a["n"], b["n"]) < 2:
            rows.append((str(a[label]), str(b[label]), None, None))
            continue
        pooled = math.sqrt(((a["n"] - 1) * a["v"] + (b["n"] - 1) * b["v"]) / (a["n"] + b["n"] - 2))
        rows.append((str(a[label]), str(b[label]), pooled, (a["m"] - b["m"]) / pooled if pooled else None))
    return df.sparkSession.createDataFrame(rows, "group_a string, group_b string, pooled_sd double, d double")
