"""Reproducible splits: by person, by row, by time, and folds.

All draws order a hash of the key, so a lost executor or a rerun gives the same
split, and no random number depends on the partitioning.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dayspan.functions.columns import stable_hash
from dayspan.functions.ordered import number_rows

HASH_RANGE = (0.0, 4294967296.0)


def _ranked(df: DataFrame, key: str, seed: int) -> DataFrame:
    keyed = df.withColumn("_h", stable_hash(F.col(key), seed))
    return number_rows(keyed, ["_h", key], "_at", HASH_RANGE).drop("_h")


def group_split(df: DataFrame, key: str = "num_id", share: float = 0.15, seed: int = 42) -> DataFrame:
    """(key, split): the share counts persons and is rounded up."""
    people = df.select(key).distinct()
    test = F.col("_at") <= F.ceil(F.col("_at_of") * F.lit(share))
    return _ranked(people, key, seed).select(key, F.when(test, "test").otherwise("train").alias("split"))


def group_split3(df: DataFrame, key: str = "num_id", test: float = 0.15, val: float = 0.2, seed: int = 42) -> DataFrame:
    """(key, split) with test first, then validation from the persons that are left."""
    return _three_ways(_ranked(df.select(key).distinct(), key, seed), test, val).select(key, "split")


def _three_ways(ranked: DataFrame, test: float, val: float) -> DataFrame:
    n_test = F.ceil(F.col("_at_of") * F.lit(test))
    n_val = F.ceil((F.col("_at_of") - n_test) * F.lit(val))
    at = F.col("_at")
    name = F.when(at <= n_test, "test").when(at <= n_test + n_val, "val").otherwise("train")
    return ranked.withColumn("split", name).drop("_at", "_at_of")


def row_split3(df: DataFrame, key: str, test: float = 0.15, val: float = 0.2, seed: int = 42) -> DataFrame:
    """Rows into train, val and test by a unique integer row key."""
    return _three_ways(_ranked(df, key, seed), test, val)


def tail_split(df: DataFrame, order: Sequence[str], share: float = 0.15) -> DataFrame:
    """The last share of rows in time order is the validation part."""
    ranked = number_rows(df, list(order), "_at")
    late = F.col("_at") > F.col("_at_of") - F.floor(F.col("_at_of") * F.lit(share))
    return ranked.withColumn("split", F.when(late, "val").otherwise("train")).drop("_at", "_at_of")


def window_split(df: DataFrame, train: tuple[int, int], val: tuple[int, int], day: str = "day") -> DataFrame:
    """Rows inside the two day ranges (both ends included); the rest is left out."""
    name = F.when(F.col(day).between(*train), "train").when(F.col(day).between(*val), "val")
    return df.withColumn("split", name).filter(F.col("split").isNotNull())


def group_kfold(df: DataFrame, key: str = "num_id", k: int = 5, seed: int = 42) -> DataFrame:
    """(key, rows, fold): persons dealt out by size in snake order, so folds balance in rows."""
    sizes = df.groupBy(key).agg(F.count(F.lit(1)).alias("rows"))
    # Larger persons first; among equals the hash decides, which also spreads the range slices.
    place = -F.col("rows") + stable_hash(F.col(key), seed) / F.lit(4294967296.0)
    ranked = number_rows(sizes.withColumn("_o", place), ["_o", key], "_at")
    turn = (F.col("_at") - 1) % (2 * k)
    fold = F.when(turn < k, turn).otherwise(2 * k - 1 - turn)
    return ranked.select(key, "rows", fold.cast("int").alias("fold"))


def kfold(df: DataFrame, key: str, k: int = 5, seed: int = 42) -> DataFrame:
    """Shuffled folds of equal size by a unique integer row key."""
    ranked = _ranked(df, key, seed)
    return ranked.withColumn("fold", ((F.col("_at") - 1) % k).cast("int")).drop("_at", "_at_of")


def with_split(df: DataFrame, split: DataFrame, key: str = "num_id") -> DataFrame:
    return df.join(split, key)


def feature_target(df: DataFrame, prefer: str = "phq9_sum", fallback: str = "phq2_sum", leaks: Sequence[str] = ("phq9", "phq2")) -> tuple[DataFrame, str]:
    """Predictors with the target as ``y``: the preferred target if present; leaking names dropped."""
    target = prefer if prefer in df.columns else fallback
    keep: list[Column | str] = [c for c in df.columns if not any(x in c for x in leaks)]
    return df.select(*keep, F.col(target).alias("y")), target
