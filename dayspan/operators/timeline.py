"""Same-day combination, week numbers, densifying, gaps, lags and windows over time.

After ``combine_same_day`` a person owns at most one row per calendar day, so
every window keyed by person that follows is bounded by the study length. The
combination itself meets raw rows, where one person or day can be very large,
and therefore works on slices of the day.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dayspan.operators.clean import replace_columns

# Rows of a day that are added one by one; the order of float additions decides the last bit of a mean.
DAY_ROWS = 500
UP_TO_HERE = (Window.unboundedPreceding, Window.currentRow)
FROM_HERE = (Window.currentRow, Window.unboundedFollowing)


def minute_slice(df: DataFrame, ts: str) -> Column:
    """Minute of a timestamp as a value that never falls as time goes on.

    A zone-free timestamp is read as written: cutting it in the session's zone
    could reorder the hours around a clock change.
    """
    if dict(df.dtypes)[ts] == "timestamp_ntz":
        return F.hour(ts) * 60 + F.minute(ts)
    return F.floor(F.unix_seconds(F.col(ts).cast("timestamp")) / 60)


def fill_within(
    df: DataFrame, group: Sequence[str], order: Sequence[str], cols: Sequence[str], slice_by: Column | None = None
) -> DataFrame:
    """Forward fill, then backward fill, inside each group.

    ``slice_by`` must not decrease along ``order`` inside a group (e.g. ``minute_slice`` of a day).
    With it a very large group is filled slice by slice; values cross slices
    through a table of each slice's first and last known value.
    """
    by = list(group)
    if slice_by is not None:
        by, df = [*group, "_slice"], df.withColumn("_slice", slice_by)
    w = Window.partitionBy(*by).orderBy(*order)
    back, ahead = w.rowsBetween(*UP_TO_HERE), w.rowsBetween(*FROM_HERE)
    earlier = {c: F.last(c, ignorenulls=True).over(back) for c in cols}
    later = {c: F.first(c, ignorenulls=True).over(ahead) for c in cols}
    if slice_by is None:
        return replace_columns(df, {c: F.coalesce(earlier[c], later[c]) for c in cols})
    at = F.struct(*order)
    ends = df.groupBy(*by).agg(
        *[F.min_by(c, F.when(F.col(c).isNotNull(), at)).alias(f"_first_{c}") for c in cols],
        *[F.max_by(c, F.when(F.col(c).isNotNull(), at)).alias(f"_last_{c}") for c in cols],
    )
    slices = Window.partitionBy(*group).orderBy("_slice")
    before = slices.rowsBetween(Window.unboundedPreceding, -1)
    after = slices.rowsBetween(1, Window.unboundedFollowing)
    carried = ends.select(
        *by,
        *[F.last(f"_last_{c}", ignorenulls=True).over(before).alias(f"_prev_{c}") for c in cols],
        *[F.first(f"_first_{c}", ignorenulls=True).over(after).alias(f"_next_{c}") for c in cols],
    )
    local = df.select("*", *[earlier[c].alias(f"_e_{c}") for c in cols], *[later[c].alias(f"_l_{c}") for c in cols])
    joined = local.join(carried, by)
    out = replace_columns(
        joined, {c: F.coalesce(f"_e_{c}", f"_prev_{c}", f"_l_{c}", f"_next_{c}") for c in cols}
    )
    return out.select(*[c for c in df.columns if c != "_slice"])


def combine_same_day(
    df: DataFrame,
    key: str,
    ts: str,
    order: Sequence[str],
    numbers: Sequence[str],
    texts: Sequence[str] = (),
    text_rule: str = "last",
    week: str | None = None,
    date: str = "dt",
) -> DataFrame:
    """One row per person and day: fill gaps both ways inside the day, then average.

    The fill and mean of a column equal a sum over its rows of the last known
    value, with rows before the first known value counted at that first value.
    That sum is built per slice of the day and the slices are chained by their
    last known values, so one person-day with very many rows spreads over tasks.
    A day of up to ``DAY_ROWS`` rows is added row by row in time order, as a plain mean
    would, so that a mean that lies on a threshold falls on the same side of it.
    Text columns take the last (or first) known value; ``week`` takes the first.
    """
    day = [key, date]
    sliced = df.select(
        key,
        F.to_date(ts).alias(date),
        minute_slice(df, ts).alias("_slice"),
        *[F.col(c).alias(f"_o{i}") for i, c in enumerate(order)],
        *[F.col(c) for c in (*numbers, *texts)],
        *([F.col(week)] if week else []),
    )
    o = [f"_o{i}" for i in range(len(order))]
    place = Window.partitionBy(*day, "_slice").orderBy(*o)
    filled = sliced.select(
        "*",
        F.row_number().over(place).alias("_rn"),
        *[F.last(c, ignorenulls=True).over(place.rowsBetween(*UP_TO_HERE)).alias(f"_f_{c}") for c in numbers],
    )

    def known_at(c: str, at: str) -> Column:
        return F.when(F.col(c).isNotNull(), F.col(at))

    labels = [*texts, *([week] if week else [])]
    pieces = filled.groupBy(*day, "_slice").agg(
        F.count(F.lit(1)).alias("_n"),
        F.array_sort(F.collect_list(F.when(F.col("_rn") <= DAY_ROWS, F.struct("_rn", *[F.col(f"_f_{c}").cast("double").alias(f"f{i}") for i, c in enumerate(numbers)])))).alias("_rows"),
        *[F.sum(f"_f_{c}").alias(f"_sum_{c}") for c in numbers],
        *[F.count_if(F.col(f"_f_{c}").isNull()).alias(f"_open_{c}") for c in numbers],
        *[F.min_by(c, known_at(c, "_rn")).alias(f"_first_{c}") for c in (*numbers, *labels)],
        *[F.max_by(c, known_at(c, "_rn")).alias(f"_last_{c}") for c in (*numbers, *labels)],
    )
    earlier = Window.partitionBy(*day).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    chained = pieces.select(
        "*",
        (F.coalesce(F.sum("_n").over(earlier), F.lit(0)) + F.col("_n")).alias("_upto"),
        *[F.last(f"_last_{c}", ignorenulls=True).over(earlier).alias(f"_prev_{c}") for c in numbers],
    )
    part = F.struct("_slice", "_rows", *[F.col(f"_prev_{c}").cast("double").alias(f"p{i}") for i, c in enumerate(numbers)])

    def mean_of(c: str) -> Column:
        prev, gap = F.col(f"_prev_{c}"), F.col(f"_open_{c}")
        carried = F.sum(F.coalesce(F.col(f"_sum_{c}"), F.lit(0.0)) + F.coalesce(prev * gap, F.lit(0.0)))
        ahead = F.sum(F.when(prev.isNull(), gap).otherwise(F.lit(0)))
        return (carried + ahead * F.min_by(f"_first_{c}", known_at(f"_first_{c}", "_slice"))) / F.sum("_n")

    def pick(c: str, rule: str) -> Column:
        by = F.max_by if rule == "last" else F.min_by
        return by(f"_{rule}_{c}", known_at(f"_{rule}_{c}", "_slice"))

    days = chained.groupBy(*day).agg(
        F.sum("_n").alias("_n"),
        F.array_sort(F.collect_list(F.when(F.col("_upto") <= DAY_ROWS, part))).alias("_parts"),
        *[F.min_by(f"_first_{c}", known_at(f"_first_{c}", "_slice")).cast("double").alias(f"_lead_{c}") for c in numbers],
        *[mean_of(c).alias(f"_mean_{c}") for c in numbers],
        *[pick(c, text_rule).alias(c) for c in texts],
        *([pick(week, "first").alias(week)] if week else []),
    )

    def added(i: int, c: str) -> Column:
        def through(total, p):
            return F.aggregate(p["_rows"], total, lambda s, r: s + F.coalesce(r[f"f{i}"], p[f"p{i}"], F.col(f"_lead_{c}")))

        return F.aggregate("_parts", F.lit(0.0), through)

    small = F.col("_n") <= DAY_ROWS
    return days.select(
        *day,
        *[F.when(small, added(i, c) / F.col("_n")).otherwise(F.col(f"_mean_{c}")).alias(c) for i, c in enumerate(numbers)],
        *texts,
        *([week] if week else []),
    )


def assign_week(df: DataFrame, key: str = "num_id", date: str = "dt", name: str = "week") -> DataFrame:
    """Whole weeks since the person's first date."""
    start = F.min(date).over(Window.partitionBy(key))
    return replace_columns(df, {name: F.floor(F.datediff(F.col(date), start) / 7).cast("int")})


def densify_days(df: DataFrame, key: str = "num_id", date: str = "dt") -> DataFrame:
    """Every calendar day between a person's first and last date, other columns missing.

    The last row of a day produces the days up to the person's next date, so no
    join is needed; further rows of the same day stay as they are.
    """
    rest = [c for c in df.columns if c not in (key, date)]
    following = F.lead(date).over(Window.partitionBy(key).orderBy(date))
    until = F.greatest(F.coalesce(F.date_sub(following, 1), F.col(date)), F.col(date))
    span = df.withColumn("_until", until)
    days = span.select(
        key, date, *rest, F.explode(F.sequence(F.col(date), F.col("_until"))).alias("_day")
    )
    real = F.col("_day") == F.col(date)
    return days.select(
        key, F.col("_day").alias(date), *[F.when(real, F.col(c)).alias(c) for c in rest]
    )


def day_number(df: DataFrame, key: str = "num_id", date: str = "dt", name: str = "day") -> DataFrame:
    """Ordinal of the row in the person's series, from zero."""
    n = F.row_number().over(Window.partitionBy(key).orderBy(date)) - 1
    return replace_columns(df, {name: n})


def interpolate_weekly(
    df: DataFrame,
    cols: Sequence[str],
    percent: float,
    key: str = "num_id",
    week: str = "week",
    date: str = "dt",
    suffix: str = "_int",
) -> DataFrame:
    """Linear in time inside a person-week whose known share is in [percent, 100).

    Gaps after the last known value repeat it, gaps before the first stay.
    """
    place = Window.partitionBy(key, week)
    back = place.orderBy(date).rowsBetween(*UP_TO_HERE)
    ahead = place.orderBy(date).rowsBetween(*FROM_HERE)
    new = {}
    for c in cols:
        at = F.when(F.col(c).isNotNull(), F.col(date))
        v0, d0 = F.last(c, ignorenulls=True).over(back), F.last(at, ignorenulls=True).over(back)
        v1, d1 = F.first(c, ignorenulls=True).over(ahead), F.first(at, ignorenulls=True).over(ahead)
        share = F.count(c).over(place) * 100.0 / F.count(F.lit(1)).over(place)
        # Multiplied first, then divided, as the SQL does: a share taken first ends in another last bit.
        line = v0 + F.try_divide((v1 - v0) * F.datediff(F.col(date), d0), F.datediff(d1, d0))
        guess = F.when(v1.isNull(), v0).otherwise(line)
        open_week = (share >= F.lit(float(percent))) & (share < 100)
        new[f"{c}{suffix}"] = F.when(F.col(c).isNotNull(), F.col(c)).when(open_week, guess)
    return replace_columns(df, new)


def interpolation_yield(
    df: DataFrame, cols: Sequence[str], key: str = "num_id", week: str = "week", suffix: str = "_int"
) -> DataFrame:
    """Per variable: person-weeks examined and person-weeks that gained a value."""
    weeks = df.groupBy(key, week).agg(
        *[(F.count(f"{c}{suffix}") > F.count(c)).cast("long").alias(c) for c in cols]
    )
    wide = weeks.agg(F.count(F.lit(1)).alias("weeks"), *[F.sum(c).alias(c) for c in cols])
    return wide.unpivot(["weeks"], list(cols), "variable", "improved").select("variable", "weeks", "improved")


def lag_columns(
    df: DataFrame, cols: Sequence[str], n: int = -1, key: str = "num_id", date: str = "dt"
) -> DataFrame:
    """Value n rows back in the person's order; a negative n looks ahead. Named ``{col}_lag{n}``."""
    w = Window.partitionBy(key).orderBy(date)
    return replace_columns(df, {f"{c}_lag{n}": F.lag(c, n).over(w) for c in cols})


def person_center(df: DataFrame, cols: Sequence[str], key: str = "num_id") -> DataFrame:
    """Value minus the person's own mean."""
    w = Window.partitionBy(key)
    return replace_columns(df, {c: F.col(c) - F.avg(c).over(w) for c in cols})


def guarded_slope(y: str, x: str, inside: Column | None = None) -> Column:
    """Least-squares slope; missing under two rows or with any gap in range."""
    yy = F.when(inside, F.col(y)) if inside is not None else F.col(y)
    rows = F.count_if(inside) if inside is not None else F.count(F.lit(1))
    return F.when((rows >= 2) & (F.count(yy) == rows), F.regr_slope(yy, F.col(x)))


def person_slope(df: DataFrame, cols: Sequence[str], x: str = "day", key: str = "num_id") -> DataFrame:
    return df.groupBy(key).agg(*[guarded_slope(c, x).alias(f"{c}_slope") for c in cols])


def wide_features(
    df: DataFrame, cols: Sequence[str], key: str = "num_id", week: str = "week", day: str = "day"
) -> DataFrame:
    """One row per person with window averages and slopes, from a single grouping."""
    w = F.col(week)
    spans = {"w1": w <= 1, "wu2": w <= 2, "wu4": w <= 4, "w4": w == 4}
    out = []
    for c in cols:
        out += [F.avg(F.when(inside, F.col(c))).alias(f"{c}_avg_{n}") for n, inside in spans.items()]
        out += [guarded_slope(c, day, spans[n]).alias(f"{c}_slope_{n}") for n in ("wu2", "wu4")]
    return df.groupBy(key).agg(*out)


def last_rows(df: DataFrame, n: int, key: str = "num_id", date: str = "dt") -> DataFrame:
    """The last n rows of each person's series."""
    w = Window.partitionBy(key).orderBy(F.col(date).desc())
    return df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= n).drop("_rn")


def calendar_parts(df: DataFrame, date: str = "dt") -> DataFrame:
    """Weekday (Monday is 1), month, season and season code."""
    from dayspan.functions.columns import season, season_code

    month = F.month(date)
    label = season(month)
    return replace_columns(
        df,
        {
            "day_of_week": F.weekday(date) + 1,
            "month": month,
            "season": label,
            "season_num": season_code(label),
        },
    )


def survey_weeks(df: DataFrame, allowed: Mapping[str, Sequence[int]], survey: str, week: str = "week") -> DataFrame:
    """Rows of each survey in the weeks in which it was given."""
    rule = None
    for name, weeks in allowed.items():
        hit = (F.col(survey) == name) & F.col(week).isin(*weeks)
        rule = hit if rule is None else rule | hit
    return df.filter(rule)
