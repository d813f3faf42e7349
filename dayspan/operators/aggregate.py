"""Groupings: panels by week, counts, coverage, audits, profiles."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dayspan.functions.ordered import group_quantiles
from dayspan.session import cut_lineage


def weekly_panel(
    df: DataFrame,
    numbers: Sequence[str],
    texts: Sequence[str] = (),
    key: str = "num_id",
    week: str = "week",
    date: str = "dt",
) -> DataFrame:
    """Person-week means of numbers and first known value of the other columns."""
    return df.groupBy(key, week).agg(
        *[F.avg(c).alias(c) for c in numbers],
        *[F.min_by(c, F.when(F.col(c).isNotNull(), F.col(date))).alias(c) for c in texts],
    )


def value_counts(df: DataFrame, col: str) -> DataFrame:
    """Rows per value, most frequent first."""
    return df.groupBy(col).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), col)


def distinct_per_group(df: DataFrame, by: Sequence[str], cols: Sequence[str]) -> DataFrame:
    return df.groupBy(*by).agg(*[F.count_distinct(c).alias(f"n_{c}") for c in cols])


def at_least(df: DataFrame, entity: str, unit: str) -> DataFrame:
    """For each X: how many entities have at least X distinct units.

    The final window runs over the distinct counts, of which there are no more
    than there are units in the calendar.
    """
    per = df.select(entity, unit).distinct().groupBy(entity).agg(F.count(F.lit(1)).alias("x"))
    curve = per.groupBy("x").agg(F.count(F.lit(1)).alias("n"))
    down = Window.partitionBy(F.lit(1)).orderBy(F.desc("x"))
    return curve.select("x", F.sum("n").over(down).alias("at_least"))


def sufficient(df: DataFrame, min_week: int = 4, min_rows: int = 20, key: str = "num_id", week: str = "week") -> DataFrame:
    """Rows of persons who reached a week or own enough rows."""
    ids = (
        df.groupBy(key)
        .agg(F.max(week).alias("_w"), F.count(F.lit(1)).alias("_n"))
        .filter((F.col("_w") >= min_week) | (F.col("_n") >= min_rows))
    )
    return df.join(ids.select(key), key, "left_semi")


def person_coverage(df: DataFrame, cols: Sequence[str], key: str = "num_id") -> DataFrame:
    """Mean over a person's rows of the known share of the chosen columns."""
    known = sum(F.count(c) for c in cols)
    return df.groupBy(key).agg((known / (F.count(F.lit(1)) * len(cols))).alias("coverage"))


def coverage_filter(df: DataFrame, cols: Sequence[str], threshold: float = 0.7, key: str = "num_id") -> DataFrame:
    ids = person_coverage(df, cols, key).filter(F.col("coverage") >= threshold)
    return df.join(ids.select(key), key, "left_semi")


def people_columns(
    df: DataFrame, cols: Sequence[str], threshold: float = 0.7, least: int = 4, key: str = "num_id"
) -> DataFrame:
    """Persons passing coverage for every column subset of at least ``least`` columns.

    All columns share a person's row count, so the coverage of a subset follows
    from known cells per (person, column). Persons with equal count vectors are
    merged; each such profile is then spread over the subsets, numbered by their
    bits, and the subsets are grouped: one path and one scan for any number of
    columns. Subsets are as many as 2 to the number of columns.
    """
    n = len(cols)
    counts = df.groupBy(key).agg(F.count(F.lit(1)).alias("_rows"), *[F.count(c).alias(c) for c in cols])
    known = F.array(*[F.col(c) for c in cols])
    profiles = counts.groupBy("_rows", *cols).agg(F.count(F.lit(1)).alias("_people")).select("_rows", known.alias("_known"), "_people")
    # a profile of nobody, so that every subset has a row
    nobody = df.sparkSession.createDataFrame([(1, [0] * n, 0)], "_rows long, _known array<long>, _people long")
    low = min(n, 12)
    spread = profiles.unionByName(nobody).select("*", F.explode(F.sequence(F.lit(0), F.lit((1 << (n - low)) - 1))).alias("_high"))
    spread = spread.select("*", F.explode(F.sequence(F.lit(0), F.lit((1 << low) - 1))).alias("_low"))
    mask = (F.col("_high").cast("long") * (1 << low) + F.col("_low")).alias("_mask")
    spread = spread.select("_rows", "_known", "_people", mask).filter(F.bit_count("_mask") >= least)
    bit = lambda i: F.shiftright("_mask", i).bitwiseAND(F.lit(1).cast("long"))
    total = sum((bit(i) * F.element_at("_known", i + 1) for i in range(n)), F.lit(0))
    share = total / (F.col("_rows") * F.bit_count("_mask"))
    scored = spread.groupBy("_mask").agg(F.sum(F.when(share >= threshold, F.col("_people")).otherwise(F.lit(0))).alias("num_people"))
    names = F.array_join(F.array_compact(F.array(*[F.when(bit(i) == 1, F.lit(c)) for i, c in enumerate(cols)])), ",")
    return scored.select(
        names.alias("columns"), F.bit_count("_mask").cast("long").alias("num_columns"), F.col("num_people").cast("long").alias("num_people")
    )


def best_tradeoff(scored: DataFrame) -> DataFrame:
    """The subset with most persons times columns; ties go to the larger, then first, subset."""
    top = F.struct(
        (F.col("num_people") * F.col("num_columns")).alias("cells"), "num_columns", "num_people"
    )
    return (
        scored.orderBy(F.desc(top), "columns")
        .limit(1)
        .select("columns", "num_columns", "num_people")
    )


def median_profile(df: DataFrame, by: str, cols: Sequence[str]) -> DataFrame:
    """Rounded (half to even) median of every feature per cluster."""
    long = df.unpivot([by], list(cols), "feature", "x")
    med = group_quantiles(long, [by, "feature"], "x", {"median": 0.5})
    return med.select(by, "feature", F.bround("median", 0).alias("median"))


def feature_counts(df: DataFrame, by: str, cols: Sequence[str]) -> DataFrame:
    return df.groupBy(by).agg(*[F.count(c).alias(c) for c in cols])


def group_stats(df: DataFrame, by: Sequence[str], col: str) -> DataFrame:
    """n, mean, sample SD and standard error of the mean per group."""
    n = F.count(col)
    return df.groupBy(*by).agg(
        n.alias("n"),
        F.avg(col).alias("mean"),
        F.stddev_samp(col).alias("sd"),
        F.try_divide(F.stddev_samp(col), F.sqrt(n)).alias("sem"),
    )


def constant_columns(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Columns with one distinct known value. Min against max needs no distinct count."""
    tests = df.agg(*[(F.coalesce(F.min(c) == F.max(c), F.lit(False))).cast("int").alias(c) for c in cols])
    return tests.unpivot([], list(cols), "column", "is_constant")


def duplicate_days(df: DataFrame, key: str = "num_id", date: str = "dt") -> DataFrame:
    """Person-days with more than one distinct row."""
    return df.distinct().groupBy(key, date).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def bad_weeks(df: DataFrame, key: str = "num_id", week: str = "week", date: str = "dt", days: int = 7) -> DataFrame:
    """Person-weeks whose own dates span more than ``days``."""
    span = F.datediff(F.max(date), F.min(date))
    return df.groupBy(key, week).agg(span.alias("span")).filter(F.col("span") > days)


def missing_summary(df: DataFrame, by: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """Rows, cells, missing cells and missing share per group."""
    rows, k = F.count(F.lit(1)), len(cols)
    missing = rows * k - sum(F.count(c) for c in cols)
    return df.groupBy(*by).agg(
        rows.alias("rows"),
        (rows * k).alias("cells"),
        missing.alias("missing"),
        (missing / (rows * k)).alias("missing_share"),
    )


def pivot_weeks(
    df: DataFrame, col: str, weeks: Sequence[int], key: str = "num_id", week: str = "week", mask: bool = True
) -> DataFrame:
    """Person by week means. Gaps are zero-filled, or left missing with ``mask``."""
    cells = [F.avg(F.when(F.col(week) == w, F.col(col))).alias(f"w{w}") for w in weeks]
    wide = df.groupBy(key).agg(*cells)
    names = [f"w{w}" for w in weeks]
    filled = wide.na.fill(0.0, names)
    if not mask:
        return filled
    return filled.select(key, *[F.nullif(F.col(n), F.lit(0.0)).alias(n) for n in names])


def complete_weeks(df: DataFrame, col: str, weeks: Sequence[int], key: str = "num_id", week: str = "week") -> DataFrame:
    """Pivoted weeks of persons who have a value in each required week."""
    return pivot_weeks(df, col, weeks, key, week).na.drop("any", subset=[f"w{w}" for w in weeks])


def melt(df: DataFrame, ids: Sequence[str], cols: Sequence[str]) -> DataFrame:
    return df.unpivot(list(ids), list(cols), "column", "value")


def histogram(df: DataFrame, cols: Sequence[str], bins: int) -> DataFrame:
    """Equal-width counts per column between its own minimum and maximum, last bin closed."""
    bounds = df.agg(*[F.min(c).alias(f"lo_{c}") for c in cols], *[F.max(c).alias(f"hi_{c}") for c in cols]).first()
    place = []
    for c in cols:
        lo, hi = bounds[f"lo_{c}"], bounds[f"hi_{c}"]
        if lo is None or hi <= lo:
            place.append(F.when(F.col(c).isNotNull(), F.lit(0)).alias(c))
            continue
        at = F.floor((F.col(c) - F.lit(lo)) * F.lit(bins) / F.lit(hi - lo)).cast("int")
        place.append(F.least(at, F.when(F.col(c).isNotNull(), F.lit(bins - 1))).alias(c))
    long = df.select(*place).unpivot([], list(cols), "column", "bin")
    return long.filter(F.col("bin").isNotNull()).groupBy("column", "bin").agg(F.count(F.lit(1)).alias("n"))


def box_stats(df: DataFrame, by: str, col: str) -> DataFrame:
    """Quartiles and the furthest values inside 1.5 interquartile ranges, per group."""
    values = cut_lineage(df.filter(F.col(col).isNotNull()).groupBy(by, col).agg(F.count(F.lit(1)).alias("_n")))
    q = group_quantiles(values, [by], col, {"q1": 0.25, "median": 0.5, "q3": 0.75}, weight="_n")
    reach = 1.5 * (F.col("q3") - F.col("q1"))
    near = values.join(q, by).filter(F.col(col).between(F.col("q1") - reach, F.col("q3") + reach))
    return near.groupBy(by).agg(
        *[F.max(c).alias(c) for c in ("n", "q1", "median", "q3")],
        F.min(col).alias("low"),
        F.max(col).alias("high"),
    )
