"""Projections, casts, masks and row filters."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dayspan.functions import columns as X
from dayspan.spec import PanelSpec


def replace_columns(df: DataFrame, new: Mapping[str, Column]) -> DataFrame:
    """Replace or append many columns in one projection."""
    kept = [new[c].alias(c) if c in new else F.col(c) for c in df.columns]
    return df.select(*kept, *[e.alias(c) for c, e in new.items() if c not in df.columns])


def drop_like(df: DataFrame, *patterns: str) -> DataFrame:
    """Drop columns whose name matches one of the patterns."""
    rx = [re.compile(p) for p in patterns]
    return df.select(*[c for c in df.columns if not any(r.search(c) for r in rx)])


def keep_from_group(df: DataFrame, group: Iterable[str], keep: Iterable[str]) -> DataFrame:
    """Drop a listed group of columns except the named survivors."""
    gone = set(group) - set(keep)
    return df.drop(*[c for c in df.columns if c in gone])


def unify_date(df: DataFrame, candidates: Sequence[str], name: str = "dt") -> DataFrame:
    """First parsable of several date columns as one naive timestamp; bad text is missing."""
    present = [c for c in candidates if c in df.columns]
    parsed = [F.col(c).try_cast("timestamp_ntz") for c in present]
    return df.select(
        *[c for c in df.columns if c not in present or c == name], F.coalesce(*parsed).alias(name)
    )


def rename(df: DataFrame, names: Mapping[str, str], strip: str = "") -> DataFrame:
    """Rename by map and strip a suffix from all names, in one step."""
    def new(c: str) -> str:
        c = names.get(c, c)
        return c[: -len(strip)] if strip and c.endswith(strip) else c

    return df.select(*[F.col(c).alias(new(c)) for c in df.columns])


def baseline_time(df: DataFrame) -> DataFrame:
    """Week and day zero for tables collected once at enrolment."""
    return replace_columns(df, {"week": F.lit(0), "day": F.lit(0)})


def silence_to_missing(df: DataFrame, thresholds: Mapping[str, float]) -> DataFrame:
    """Values at or below a column's threshold become missing."""
    hit = {c: X.mask_upto(F.col(c), t) for c, t in thresholds.items() if c in df.columns}
    return replace_columns(df, hit)


def silence_counts(df: DataFrame, thresholds: Mapping[str, float]) -> DataFrame:
    """Changed cells per thresholded column, counted in one pass."""
    return df.agg(*[F.count_if(F.col(c) <= t).alias(c) for c, t in thresholds.items() if c in df.columns])


def per_hour(df: DataFrame, cols: Sequence[str], hours: str, finite: bool = True) -> DataFrame:
    """Divide numeric columns by observed hours; the result is named ``{col}_hr``.

    A rate over zero hours is missing, or with ``finite`` off infinite, and NaN for zero over zero.
    """
    numeric = {c for c, t in df.dtypes if t != "boolean"}

    def rate(c: str) -> Column:
        plain = F.try_divide(F.col(c), F.col(hours))
        if finite:
            return plain
        endless = F.when(F.col(c) > 0, F.lit(float("inf"))).when(F.col(c) < 0, F.lit(float("-inf"))).when(F.col(c) == 0, F.lit(float("nan")))
        return F.when(F.col(hours) == 0, endless).otherwise(plain)

    return replace_columns(df, {f"{c}_hr": rate(c) for c in cols if c in numeric})


def indicators(df: DataFrame, cols: Sequence[str], suffix: str = "_indicator") -> DataFrame:
    return replace_columns(df, {f"{c}{suffix}": X.positive(F.col(c)) for c in cols})


def nonzero_copies(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return replace_columns(df, {f"{c}_nonzero": F.nullif(F.col(c), F.lit(0)) for c in cols})


def complete_rows(df: DataFrame, cols: Sequence[str] | None = None, how: str = "any") -> DataFrame:
    """Rows without gaps in all, or in the chosen, columns."""
    return df.na.drop(how=how, subset=list(cols) if cols else None)


def completeness(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Per column: rows, known cells, and whether it is fully missing or fully known."""
    wide = df.agg(F.count(F.lit(1)).alias("_rows"), *[F.count(c).alias(c) for c in cols])
    return wide.unpivot(["_rows"], list(cols), "column", "known").select(
        "column",
        "known",
        F.col("_rows").alias("rows"),
        (F.col("known") == 0).cast("int").alias("all_missing"),
        (F.col("known") == F.col("_rows")).cast("int").alias("all_known"),
    )


def drop_empty_columns(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Drop the columns that hold no value at all."""
    row = df.agg(*[F.count(c).alias(c) for c in cols]).first()
    return df.drop(*[c for c in cols if row[c] == 0])


def coerce_numeric(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Text to double; what does not parse, or parses to NaN, is missing."""
    return replace_columns(
        df, {c: X.finite_or_missing(F.col(c).try_cast("double")) for c in cols}
    )


def log1p_safe(df: DataFrame, cols: Sequence[str]) -> tuple[DataFrame, list[str]]:
    """log(1+x) where no value is negative; the other columns stay and are reported."""
    low = df.agg(*[F.min(c).alias(c) for c in cols]).first()
    refused = [c for c in cols if low[c] is not None and low[c] < 0]
    return replace_columns(df, {c: F.log1p(F.col(c)) for c in cols if c not in refused}), refused




def catalogue(df: DataFrame, panel: PanelSpec, suffixes: Sequence[str] = ()) -> DataFrame:
    """(column, role, suffix, numeric, known, gaps) of every column, in one pass over the table.

    Roles come from the panel's description, ``suffix`` tells derived copies of features apart.
    """
    numeric = {c for c, kind in df.dtypes if kind in ("tinyint", "smallint", "int", "bigint", "float", "double") or kind.startswith("decimal")}
    counts = df.agg(F.count(F.lit(1)).alias("_rows"), *[F.count(F.col(c)).alias(f"_k{i}") for i, c in enumerate(df.columns)])
    cells = []
    for i, c in enumerate(df.columns):
        role, suffix = panel.role_of(c, tuple(suffixes))
        cells.append(F.struct(
            F.lit(c).alias("column"), F.lit(role).alias("role"), F.lit(suffix).alias("suffix"), F.lit(int(c in numeric)).alias("numeric"),
            F.col(f"_k{i}").alias("known"), (F.col("_rows") - F.col(f"_k{i}")).alias("gaps")))
    return counts.select(F.inline(F.array(*cells)))


def columns_of(df: DataFrame, panel: PanelSpec, role: str, suffix: str = "", where: Callable[[str, str], bool] | None = None) -> list[str]:
    """The table's columns of a role and suffix, in its order; ``where`` looks at (name, type)."""
    found = [(c, kind) for c, kind in df.dtypes if panel.role_of(c, (suffix,)) == (role, suffix)]
    return [c for c, kind in found if where is None or where(c, kind)]
