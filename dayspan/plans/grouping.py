"""Aggregations."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import functions as F

from dayspan.operators import aggregate as ag
from dayspan.operators import timeline as tl
from dayspan.plans import inputs as inp
from dayspan.plans.base import query

_AVG = ", ".join(f"round(avg({c}), 6) AS {c}" for c in inp.FEATURES)
_RND = inp.r6(*inp.FEATURES)


@query(
    "combine_same_day",
    f"WITH {inp.SQL_FILL}, last_type AS (SELECT num_id, dt, max_by(event_type, (ts, event_id)) AS event_type FROM ev GROUP BY 1, 2) "
    f"SELECT f.num_id, f.dt, {_AVG}, any_value(l.event_type) AS event_type FROM filled f JOIN last_type l ON l.num_id = f.num_id AND l.dt = f.dt GROUP BY 1, 2",
)
def combine_same_day(spark, sf):
    out = tl.combine_same_day(inp.ev_raw(spark, sf), "num_id", "ts", ["ts", "event_id"], inp.FEATURES, ["event_type"])
    return inp.rounded(out, inp.FEATURES)


@query(
    "combine_day_keep_week",
    f"WITH {inp.SQL_FILL}, lab AS (SELECT num_id, dt, min_by(event_type, (ts, event_id)) AS event_type, "
    "min_by(CAST(event_id % 5 AS BIGINT), (ts, event_id)) AS week FROM ev GROUP BY 1, 2) "
    f"SELECT f.num_id, f.dt, {_AVG}, any_value(l.event_type) AS event_type, any_value(l.week) AS week FROM filled f JOIN lab l ON l.num_id = f.num_id AND l.dt = f.dt GROUP BY 1, 2",
)
def combine_day_keep_week(spark, sf):
    e = inp.ev_raw(spark, sf).withColumn("week", F.col("event_id") % 5)
    out = tl.combine_same_day(
        e, "num_id", "ts", ["ts", "event_id"], inp.FEATURES, ["event_type"], text_rule="first", week="week"
    )
    return inp.rounded(out, inp.FEATURES)


@query(
    "weekly_panel",
    f"WITH {inp.SQL_WEEKS}, t AS (SELECT num_id, week, min_by(dayname(dt), dt) AS first_day FROM pw WHERE view IS NOT NULL GROUP BY 1, 2) "
    f"SELECT pw.num_id, pw.week, {_AVG}, any_value(t.first_day) AS first_day FROM pw LEFT JOIN t ON t.num_id = pw.num_id AND t.week = pw.week GROUP BY 1, 2",
)
def weekly_panel(spark, sf):
    p = inp.panel_weeks(spark, sf).withColumn("first_day", F.when(F.col("view").isNotNull(), F.date_format("dt", "EEEE")))
    return inp.rounded(ag.weekly_panel(p, inp.FEATURES, ["first_day"]), inp.FEATURES)


@query(
    "person_week_mean",
    f"WITH {inp.SQL_WEEKS} SELECT num_id, week, round(avg(view), 6) AS view FROM pw GROUP BY 1, 2",
)
def person_week_mean(spark, sf):
    return inp.rounded(ag.weekly_panel(inp.panel_weeks(spark, sf), ["view"]), ["view"])


@query("value_counts", "SELECT c_mktsegment, count(*) AS n FROM customer GROUP BY 1 ORDER BY n DESC, 1")
def value_counts(spark, sf):
    return ag.value_counts(inp.table(spark, sf, "customer"), "c_mktsegment")


@query(
    "nunique_per_group",
    "SELECT o_custkey, count(DISTINCT o_orderdate) AS n_o_orderdate, count(DISTINCT o_orderpriority) AS n_o_orderpriority FROM orders GROUP BY 1",
)
def nunique_per_group(spark, sf):
    return ag.distinct_per_group(inp.table(spark, sf, "orders"), ["o_custkey"], ["o_orderdate", "o_orderpriority"])


def _events(spark, sf):
    return inp.table(spark, sf, "events").select(F.col("user_id").alias("num_id"), F.to_date("ts").alias("dt"))


def _curve(entity: str, unit: str) -> str:
    return (
        f"WITH e AS (SELECT user_id AS num_id, CAST(ts AS DATE) AS dt FROM events), p AS (SELECT {entity}, count(DISTINCT {unit}) AS x FROM e GROUP BY 1) "
        "SELECT x, CAST((SELECT count(*) FROM p q WHERE q.x >= d.x) AS BIGINT) AS at_least FROM (SELECT DISTINCT x FROM p) d"
    )


@query("at_least_x_units", _curve("num_id", "dt"))
def at_least_x_units(spark, sf):
    return ag.at_least(_events(spark, sf), "num_id", "dt")


@query("at_least_x_persons", _curve("dt", "num_id"))
def at_least_x_persons(spark, sf):
    return ag.at_least(_events(spark, sf), "dt", "num_id")


@query(
    "sufficient_data",
    f"WITH {inp.SQL_WEEKS} SELECT num_id, dt, week FROM pw WHERE num_id IN (SELECT num_id FROM pw GROUP BY num_id HAVING max(week) >= 4 OR count(*) >= 28)",
)
def sufficient_data(spark, sf):
    return ag.sufficient(inp.panel_weeks(spark, sf), 4, 28).select("num_id", "dt", "week")


@query(
    "coverage_filter",
    f"WITH {inp.SQL_DAY}, c AS (SELECT num_id, CAST(" + " + ".join(f"count({c})" for c in inp.SENSORS) + " AS DOUBLE) / (count(*) * 4) AS coverage FROM panel GROUP BY 1) "
    "SELECT panel.num_id, dt, round(coverage, 6) AS coverage FROM panel JOIN c ON c.num_id = panel.num_id WHERE coverage >= 0.4",
)
def coverage_filter(spark, sf):
    p = inp.panel_day(spark, sf)
    kept = ag.coverage_filter(p, inp.SENSORS, 0.4)
    cov = ag.person_coverage(p, inp.SENSORS)
    return inp.rounded(kept.select("num_id", "dt").join(cov, "num_id"), ["coverage"])


_SUBSETS = [s for k in (5, 4) for s in combinations(inp.FEATURES, k)]
_COUNTS = f"{inp.SQL_DAY}, k AS (SELECT num_id, count(*) AS n_rows, " + ", ".join(f"count({c}) AS {c}" for c in inp.FEATURES) + " FROM panel GROUP BY 1)"
_TRADE = " UNION ALL ".join(
    f"SELECT '{','.join(s)}' AS columns, CAST({len(s)} AS BIGINT) AS num_columns, count(*) FILTER (CAST({' + '.join(s)} AS DOUBLE) / (n_rows * {len(s)}) >= 0.4) AS num_people FROM k"
    for s in _SUBSETS
)


@query("people_column_tradeoff", f"WITH {_COUNTS} {_TRADE}")
def people_column_tradeoff(spark, sf):
    return ag.people_columns(inp.panel_day(spark, sf), inp.FEATURES, 0.4)


@query(
    "best_tradeoff",
    f"WITH {_COUNTS}, t AS ({_TRADE}) SELECT * FROM t ORDER BY num_people * num_columns DESC, num_columns DESC, columns LIMIT 1",
)
def best_tradeoff(spark, sf):
    return ag.best_tradeoff(ag.people_columns(inp.panel_day(spark, sf), inp.FEATURES, 0.4))


@query(
    "cluster_median_profile",
    " UNION ALL ".join(
        f"SELECT l_returnflag, '{c}' AS feature, round_even(quantile_cont({c}, 0.5), 0) AS median FROM lineitem GROUP BY 1" for c in inp.LINE
    ),
)
def cluster_median_profile(spark, sf):
    return ag.median_profile(inp.line_numbers(spark, sf), "l_returnflag", inp.LINE)


@query(
    "cluster_feature_counts",
    f"WITH {inp.SQL_DAY} SELECT c_mktsegment, " + ", ".join(f"count({c}) AS {c}" for c in inp.FEATURES) + " FROM panel JOIN customer ON c_custkey = num_id GROUP BY 1",
)
def cluster_feature_counts(spark, sf):
    seg = inp.table(spark, sf, "customer").select(F.col("c_custkey").alias("num_id"), "c_mktsegment")
    return ag.feature_counts(inp.panel_day(spark, sf).join(seg, "num_id"), "c_mktsegment", inp.FEATURES)


@query(
    "group_mean_sem",
    "SELECT l_returnflag, l_linestatus, count(l_quantity) AS n, round(avg(l_quantity), 6) AS mean, round(stddev_samp(l_quantity), 6) AS sd, "
    "round(stddev_samp(l_quantity) / sqrt(count(l_quantity)), 6) AS sem FROM lineitem GROUP BY 1, 2",
)
def group_mean_sem(spark, sf):
    out = ag.group_stats(inp.line_numbers(spark, sf), ["l_returnflag", "l_linestatus"], "l_quantity")
    return inp.rounded(out, ["mean", "sd", "sem"])


@query(
    "constant_features",
    " UNION ALL ".join(
        f"SELECT '{n}' AS \"column\", CAST(count(DISTINCT {e}) = 1 AS INTEGER) AS is_constant FROM lineitem"
        for n, e in (("l_quantity", "l_quantity"), ("l_tax", "l_tax"), ("unit", "(l_quantity / l_quantity)"))
    ),
)
def constant_features(spark, sf):
    li = inp.line_numbers(spark, sf).select("l_quantity", "l_tax", (F.col("l_quantity") / F.col("l_quantity")).alias("unit"))
    return ag.constant_columns(li, ["l_quantity", "l_tax", "unit"])


@query(
    "duplicate_days",
    "SELECT num_id, dt, count(*) AS n FROM (SELECT DISTINCT user_id AS num_id, CAST(ts AS DATE) AS dt, event_type FROM events) GROUP BY 1, 2 HAVING count(*) > 1",
)
def duplicate_days(spark, sf):
    return ag.duplicate_days(inp.ev_raw(spark, sf).select("num_id", "dt", "event_type"))


@query(
    "bad_weeks",
    "WITH o AS (SELECT o_custkey AS num_id, CAST(o_orderdate AS DATE) AS dt, month(o_orderdate) AS week FROM orders) "
    "SELECT num_id, CAST(week AS INTEGER) AS week, date_diff('day', min(dt), max(dt)) AS span FROM o GROUP BY 1, 2 HAVING date_diff('day', min(dt), max(dt)) > 7",
)
def bad_weeks(spark, sf):
    o = inp.table(spark, sf, "orders").select(
        F.col("o_custkey").alias("num_id"), F.to_date("o_orderdate").alias("dt"), F.month("o_orderdate").alias("week")
    )
    return ag.bad_weeks(o).withColumn("span", F.col("span").cast("long"))


_K = len(inp.FEATURES)
_MISS = f"count(*) * {_K} - (" + " + ".join(f"count({c})" for c in inp.FEATURES) + ")"


@query(
    "missing_summary",
    f"WITH {inp.SQL_DAY} SELECT num_id, count(*) AS rows, count(*) * {_K} AS cells, {_MISS} AS missing, round(CAST({_MISS} AS DOUBLE) / (count(*) * {_K}), 6) AS missing_share FROM panel GROUP BY 1",
)
def missing_summary(spark, sf):
    return inp.rounded(ag.missing_summary(inp.panel_day(spark, sf), ["num_id"], inp.FEATURES), ["missing_share"])


_WK = (0, 1, 2, 3, 4)
_PIV = ", ".join(f"round(nullif(coalesce(avg(CASE WHEN week = {w} THEN view END), 0), 0), 6) AS w{w}" for w in _WK)


@query("pivot_weeks", f"WITH {inp.SQL_WEEKS} SELECT num_id, {_PIV} FROM pw GROUP BY 1")
def pivot_weeks(spark, sf):
    return inp.rounded(ag.pivot_weeks(inp.panel_weeks(spark, sf), "view", _WK), [f"w{w}" for w in _WK])


@query(
    "complete_weeks",
    f"WITH {inp.SQL_WEEKS}, p AS (SELECT num_id, {_PIV} FROM pw GROUP BY 1) SELECT num_id, w0, w1, w2, w3 FROM p WHERE w0 IS NOT NULL AND w1 IS NOT NULL AND w2 IS NOT NULL AND w3 IS NOT NULL",
)
def complete_weeks(spark, sf):
    return inp.rounded(ag.complete_weeks(inp.panel_weeks(spark, sf), "view", _WK[:4]), [f"w{w}" for w in _WK[:4]])


@query(
    "melt_numeric",
    " UNION ALL ".join(f"SELECT l_orderkey, l_linenumber, '{c}' AS \"column\", {c} AS value FROM lineitem" for c in inp.LINE),
)
def melt_numeric(spark, sf):
    return ag.melt(inp.line_numbers(spark, sf), ["l_orderkey", "l_linenumber"], inp.LINE)


def _hist(c: str) -> str:
    return (
        f"SELECT '{c}' AS \"column\", CAST(least(24, floor(({c} - lo) * 25 / (hi - lo))) AS INTEGER) AS bin, count(*) AS n "
        f"FROM lineitem, (SELECT min({c}) AS lo, max({c}) AS hi FROM lineitem) GROUP BY 1, 2"
    )


@query("histogram_bins", " UNION ALL ".join(_hist(c) for c in ("l_quantity", "l_extendedprice")))
def histogram_bins(spark, sf):
    return ag.histogram(inp.line_numbers(spark, sf), ["l_quantity", "l_extendedprice"], 25)


@query(
    "box_stats",
    "WITH q AS (SELECT l_linestatus, count(*) AS n, quantile_cont(l_extendedprice, 0.25) AS q1, quantile_cont(l_extendedprice, 0.5) AS median, "
    "quantile_cont(l_extendedprice, 0.75) AS q3 FROM lineitem GROUP BY 1) "
    "SELECT q.l_linestatus, any_value(n) AS n, round(any_value(q1), 6) AS q1, round(any_value(median), 6) AS median, round(any_value(q3), 6) AS q3, "
    "min(l_extendedprice) AS low, max(l_extendedprice) AS high FROM q JOIN lineitem l ON l.l_linestatus = q.l_linestatus "
    "WHERE l_extendedprice BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) GROUP BY 1",
)
def box_stats(spark, sf):
    return inp.rounded(ag.box_stats(inp.line_numbers(spark, sf), "l_linestatus", "l_extendedprice"), ["q1", "median", "q3"])
