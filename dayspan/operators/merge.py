"""Joins of panel tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

def small_side(df: DataFrame, bound: int | None = None) -> DataFrame:
    """Broadcast hint for a lookup whose row count is bounded by construction or by count."""
    if bound is None:
        return df
    rows = df.limit(bound + 1).count()
    return F.broadcast(df) if rows <= bound else df


def outer_merge(left: DataFrame, right: DataFrame, keys: Sequence[str] | None = None) -> DataFrame:
    """Full outer join on the shared columns; missing keys match each other."""
    keys = list(keys) if keys else [c for c in left.columns if c in right.columns]
    if not keys:
        raise ValueError("the tables share no column to merge on")
    clash = [c for c in left.columns if c in right.columns and c not in keys]
    if clash:
        raise ValueError(f"columns on both sides but not keys: {clash}")
    a, b = left.alias("a"), right.alias("b")
    same = reduce(lambda x, y: x & y, (F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys))
    return a.join(b, same, "full").select(
        *[F.coalesce(F.col(f"a.{k}"), F.col(f"b.{k}")).alias(k) for k in keys],
        *[F.col(f"a.{c}") for c in left.columns if c not in keys],
        *[F.col(f"b.{c}") for c in right.columns if c not in keys],
    )


def merge_all(tables: Sequence[DataFrame], keys: Sequence[str] | None = None, unique: bool = False) -> DataFrame:
    """Fold of outer merges over all tables.

    With ``unique`` the caller states that each table has one row per key: the
    fold is then one union and one grouping, a single shuffle for any number of
    tables, with partial aggregation before it. The same grouping counts the rows
    of each table, and a key that a table holds twice raises an error.
    """
    if not unique:
        return reduce(lambda x, y: outer_merge(x, y, keys), tables)
    if not keys:
        raise ValueError("a union merge needs its keys stated")
    marked = [t.withColumn("_table", F.lit(i)) for i, t in enumerate(tables)]
    stacked = reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), marked)
    values = [c for c in stacked.columns if c not in keys and c != "_table"]
    most = F.greatest(F.lit(0), *[F.count_if(F.col("_table") == i) for i in range(len(tables))])
    merged = stacked.groupBy(*keys).agg(*[F.max(c).alias(c) for c in values], most.alias("_rows"))
    told = F.raise_error(F.lit("a table has several rows of one key; merge without unique"))
    checked = F.when(F.col("_rows") > 1, told.cast("long")).otherwise(F.col("_rows"))
    return merged.withColumn("_rows", checked).filter("_rows > 0").select(*keys, *values)


def collisions(tables: Mapping[str, DataFrame], keys: Sequence[str]) -> list[tuple[str, str, str]]:
    """(column, first table, second table) for names that a merge on ``keys`` would double."""
    seen: dict[str, str] = {}
    found = []
    for name, df in tables.items():
        for c in df.columns:
            if c in keys:
                continue
            if c in seen:
                found.append((c, seen[c], name))
            else:
                seen[c] = name
    return found


def attach_dims(df: DataFrame, dims: Sequence[tuple[DataFrame, str]]) -> DataFrame:
    """Left join of person-level tables onto the person list, then distinct rows."""
    for dim, on in dims:
        df = df.join(dim, on, "left")
    return df.distinct()


def pseudonymise(df: DataFrame, key: DataFrame, natural: str) -> DataFrame:
    """Full outer join to the id key, then the natural id is dropped."""
    return df.join(key, natural, "full").drop(natural)


def attach_columns(
    df: DataFrame, source: DataFrame, on: Sequence[str], cols: Sequence[str], how: str = "left"
) -> DataFrame:
    """Join a few columns of another table; the rest is pruned before the join."""
    return df.join(source.select(*on, *cols), list(on), how)


def keep_ids(df: DataFrame, ids: DataFrame, on: str) -> DataFrame:
    return df.join(ids.select(on), on, "left_semi")


def overlap(sets: Mapping[str, DataFrame], on: str) -> DataFrame:
    """Number of keys that two named sets share, for each pair of sets."""
    names = list(sets)
    marked = reduce(
        lambda a, b: a.unionByName(b),
        (sets[n].select(on).distinct().withColumn("_set", F.lit(n)) for n in names),
    )
    sides = marked.groupBy(on).agg(*[F.max((F.col("_set") == n).cast("int")).alias(n) for n in names])
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i + 1 :]]
    wide = sides.agg(*[F.sum(F.col(a) * F.col(b)).alias(f"{a}|{b}") for a, b in pairs])
    return wide.unpivot([], list(wide.columns), "pair", "shared").select(
        F.split("pair", "\\|")[0].alias("set_a"), F.split("pair", "\\|")[1].alias("set_b"), "shared"
    )
