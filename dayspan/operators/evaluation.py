"""Metrics as aggregates over long prediction tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dayspan.functions.columns import safe_corr
from dayspan.functions.ordered import average_ranks
from dayspan.session import cut_lineage


def regression_metrics(df: DataFrame, by: Sequence[str] = (), y: str = "y", guess: str = "prediction") -> DataFrame:
    """R2, MAE, MSE, RMSE and Pearson r per group."""
    e = F.col(y) - F.col(guess)
    mse = F.avg(e * e)
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        (1 - F.try_divide(mse, F.var_pop(y))).alias("r2"),
        F.avg(F.abs(e)).alias("mae"),
        mse.alias("mse"),
        F.sqrt(mse).alias("rmse"),
        safe_corr(y, guess).alias("pearson"),
    )


def roc_auc(df: DataFrame, by: Sequence[str] = (), y: str = "y", score: str = "probability", weight: str | None = None) -> DataFrame:
    """Exact area under the curve from average ranks; tied scores are merged before ranking.

    ``weight`` names a column that says how many rows a row stands for.
    """
    if not by:
        return roc_auc(df.withColumn("_all", F.lit(1)), ["_all"], y, score, weight).drop("_all")
    by = list(by)
    ranks = average_ranks(df.withColumn("_pos", (F.col(y) > 0).cast("int")), score, by, ["_pos"], weight)
    pos = F.sum(F.when(F.col("_pos") == 1, F.col("n")).otherwise(0))
    neg = F.sum(F.when(F.col("_pos") == 0, F.col("n")).otherwise(0))
    ranked = F.sum(F.when(F.col("_pos") == 1, F.col("n") * F.col("rank")).otherwise(0.0))
    return ranks.groupBy(*by).agg(F.try_divide(ranked - pos * (pos + 1) / 2, (pos * neg).cast("double")).alias("auc"))


def classification_metrics(df: DataFrame, by: Sequence[str] = (), y: str = "y", guess: str = "prediction", score: str = "probability") -> DataFrame:
    """Rows, accuracy, AUC and mean probability per group. The predictions are evaluated once, into counts of equal ones."""
    if not by:
        return classification_metrics(df.withColumn("_all", F.lit(1)), ["_all"], y, guess, score).drop("_all")
    counts = cut_lineage(df.groupBy(*by, y, guess, score).agg(F.count(F.lit(1)).alias("_rows")))
    hit = (F.col(y) == F.col(guess)).cast("double")
    mean = lambda c: F.try_divide(F.sum(c * F.col("_rows")), F.sum(F.when(c.isNotNull(), F.col("_rows"))))
    basic = counts.groupBy(*by).agg(F.sum("_rows").alias("n"), mean(hit).alias("accuracy"), mean(F.col(score)).alias("mean_probability"))
    return basic.join(roc_auc(counts, by, y, score, "_rows"), list(by))


def person_r2(df: DataFrame, y: str, x: str, key: str = "num_id", limit: float = 0.5) -> DataFrame:
    """R2 of one raw column taken as the prediction of another, per person, flagged over the limit."""
    both = df.filter(F.col(y).isNotNull() & F.col(x).isNotNull())
    out = regression_metrics(both, [key], y, x).select(key, "n", "r2")
    return out.withColumn("strong", F.coalesce(F.col("r2") > limit, F.lit(False)).cast("int"))


def flatten_results(df: DataFrame, ids: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """Wide metric columns to (ids, metric, score)."""
    return df.unpivot(list(ids), list(metrics), "metric", "score")
