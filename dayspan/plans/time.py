"""Weeks, gaps, lags, slopes and ordering."""

from __future__ import annotations

from pyspark.sql import functions as F

from dayspan.operators import correlation, timeline as tl
from dayspan.plans import inputs as inp
from dayspan.plans.base import query

_RND = inp.r6(*inp.FEATURES)


@query("assign_week", f"WITH {inp.SQL_WEEKS} SELECT num_id, dt, week FROM pw")
def assign_week(spark, sf):
    days = inp.table(spark, sf, "events").select(F.col("user_id").alias("num_id"), F.to_date("ts").alias("dt")).distinct()
    return tl.assign_week(days)


@query("densify_days", f"WITH {inp.SQL_FULL} SELECT num_id, dt, {_RND} FROM pf")
def densify_days(spark, sf):
    return inp.rounded(tl.densify_days(inp.panel_day(spark, sf)), inp.FEATURES)


@query("day_number", f"WITH {inp.SQL_FULL} SELECT num_id, dt, day, week FROM pf")
def day_number(spark, sf):
    return inp.panel_full(spark, sf).select("num_id", "dt", "day", "week")


@query("fill_within_day", f"WITH {inp.SQL_FILL} SELECT num_id, dt, event_id, {', '.join(inp.FEATURES)} FROM filled")
def fill_within_day(spark, sf):
    e = inp.ev_raw(spark, sf).drop("event_type")
    return tl.fill_within(
        e, ["num_id", "dt"], ["ts", "event_id"], inp.FEATURES, slice_by=tl.minute_slice(e, "ts")
    ).drop("ts")


def _interp(c: str, percent: float) -> str:
    p = "PARTITION BY num_id, week"
    back, ahead = f"({p} ORDER BY dt ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)", f"({p} ORDER BY dt ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)"
    at = f"CASE WHEN {c} IS NOT NULL THEN dt END"
    v0, d0 = f"last_value({c} IGNORE NULLS) OVER {back}", f"last_value({at} IGNORE NULLS) OVER {back}"
    v1, d1 = f"first_value({c} IGNORE NULLS) OVER {ahead}", f"first_value({at} IGNORE NULLS) OVER {ahead}"
    share = f"(count({c}) OVER ({p}) * 100.0 / count(*) OVER ({p}))"
    line = f"{v0} + ({v1} - {v0}) * CAST(date_diff('day', {d0}, dt) AS DOUBLE) / date_diff('day', {d0}, {d1})"
    return (
        f"CASE WHEN {c} IS NOT NULL THEN {c} WHEN {share} >= {percent} AND {share} < 100 THEN "
        f"CASE WHEN {v1} IS NULL THEN {v0} ELSE {line} END END AS {c}_int"
    )


_INT = f"{inp.SQL_FULL}, fi AS (SELECT *, {', '.join(_interp(c, 40.0) for c in inp.FEATURES)} FROM pf)"


@query(
    "interpolate_weekly",
    f"WITH {_INT} SELECT num_id, dt, week, {', '.join(f'round({c}_int, 6) AS {c}_int' for c in inp.FEATURES)} FROM fi",
)
def interpolate_weekly(spark, sf):
    out = tl.interpolate_weekly(inp.panel_full(spark, sf), inp.FEATURES, 40.0)
    names = [f"{c}_int" for c in inp.FEATURES]
    return inp.rounded(out.select("num_id", "dt", "week", *names), names)


@query(
    "interpolation_yield",
    f"WITH {_INT} "
    + " UNION ALL ".join(
        f"SELECT '{c}' AS variable, count(*) AS weeks, count(*) FILTER (b > a) AS improved FROM (SELECT num_id, week, count({c}) AS a, count({c}_int) AS b FROM fi GROUP BY 1, 2)"
        for c in inp.FEATURES
    ),
)
def interpolation_yield(spark, sf):
    return tl.interpolation_yield(tl.interpolate_weekly(inp.panel_full(spark, sf), inp.FEATURES, 40.0), inp.FEATURES)


@query(
    "lag_vars",
    f'WITH {inp.SQL_WEEKS} SELECT num_id, dt, round(lead(view) OVER w, 6) AS "view_lag-1", round(lead(click) OVER w, 6) AS "click_lag-1", '
    'round(lag(view, 2) OVER w, 6) AS view_lag2 FROM pw WINDOW w AS (PARTITION BY num_id ORDER BY dt)',
)
def lag_vars(spark, sf):
    p = tl.lag_columns(inp.panel_weeks(spark, sf), ["view", "click"])
    p = tl.lag_columns(p, ["view"], 2).select("num_id", "dt", "view_lag-1", "click_lag-1", "view_lag2")
    return inp.rounded(p, ["view_lag-1", "click_lag-1", "view_lag2"])


@query(
    "person_center",
    f"WITH {inp.SQL_DAY} SELECT num_id, dt, " + ", ".join(f"round({c} - avg({c}) OVER (PARTITION BY num_id), 6) AS {c}" for c in inp.FEATURES) + " FROM panel",
)
def person_center(spark, sf):
    return inp.rounded(tl.person_center(inp.panel_day(spark, sf), inp.FEATURES), inp.FEATURES)


_SPAN = {"w1": "week <= 1", "wu2": "week <= 2", "wu4": "week <= 4", "w4": "week = 4"}


def _slope(c: str, cond: str, name: str) -> str:
    y = f"CASE WHEN {cond} THEN {c} END"
    rows = f"count(*) FILTER ({cond})"
    return f"round(CASE WHEN {rows} >= 2 AND count({y}) = {rows} THEN regr_slope({y}, CAST(day AS DOUBLE)) END, 6) AS {name}"


@query(
    "person_slope",
    f"WITH {_INT} SELECT num_id, " + ", ".join(_slope(f"{c}_f", "true", f"{c}_f_slope") for c in inp.FEATURES)
    + " FROM (SELECT *, " + ", ".join(f"coalesce({c}, 0) AS {c}_f" for c in inp.FEATURES) + " FROM fi) GROUP BY 1",
)
def person_slope(spark, sf):
    p = inp.panel_full(spark, sf)
    p = p.select("num_id", "day", *[F.coalesce(c, F.lit(0.0)).alias(f"{c}_f") for c in inp.FEATURES])
    return inp.rounded(tl.person_slope(p, [f"{c}_f" for c in inp.FEATURES]), [f"{c}_f_slope" for c in inp.FEATURES])


def _wide(cols: list[str]) -> str:
    out = []
    for c in cols:
        out += [f"round(avg(CASE WHEN {s} THEN {c} END), 6) AS {c}_avg_{n}" for n, s in _SPAN.items()]
        out += [_slope(c, _SPAN[n], f"{c}_slope_{n}") for n in ("wu2", "wu4")]
    return ", ".join(out)


@query(
    "wide_features",
    f"WITH {_INT}, a AS (SELECT *, {' + '.join(f'coalesce({c}, 0)' for c in inp.FEATURES)} AS total FROM fi) "
    f"SELECT num_id, {_wide([f'{c}_int' for c in inp.FEATURES] + ['total'])} FROM a GROUP BY 1",
)
def wide_features(spark, sf):
    p = tl.interpolate_weekly(inp.panel_full(spark, sf), inp.FEATURES, 40.0)
    p = p.withColumn("total", sum(F.coalesce(F.col(c), F.lit(0.0)) for c in inp.FEATURES))
    out = tl.wide_features(p, [*[f"{c}_int" for c in inp.FEATURES], "total"])
    return inp.rounded(out, [c for c in out.columns if c != "num_id"])


@query("sort_panel", f"WITH {inp.SQL_WEEKS} SELECT num_id, week, dt FROM pw ORDER BY num_id, week, dt")
def sort_panel(spark, sf):
    return inp.panel_weeks(spark, sf).select("num_id", "week", "dt").orderBy("num_id", "week", "dt")


@query(
    "last_n_per_person",
    f"WITH {inp.SQL_WEEKS} SELECT num_id, dt, day FROM (SELECT *, row_number() OVER (PARTITION BY num_id ORDER BY dt DESC) AS rn FROM pw) WHERE rn <= 5",
)
def last_n_per_person(spark, sf):
    return tl.last_rows(inp.panel_weeks(spark, sf), 5).select("num_id", "dt", "day")


@query(
    "rank_by_target_corr",
    " UNION ALL ".join(
        f"SELECT '{c}' AS variable, round(abs(corr({c}, l_extendedprice)), 6) AS r FROM lineitem" for c in ("l_quantity", "l_discount", "l_tax")
    ),
)
def rank_by_target_corr(spark, sf):
    out = correlation.target_corr(inp.line_numbers(spark, sf), "l_extendedprice", ["l_quantity", "l_discount", "l_tax"])
    return inp.rounded(out.select("variable", F.abs("r").alias("r")), ["r"]).orderBy(F.desc("r"))
