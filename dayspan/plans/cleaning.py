"""Projections, casts, masks and filters."""

from __future__ import annotations

from pyspark.sql import functions as F

from dayspan import spec
from dayspan.functions import columns as X
from dayspan.operators import clean, merge, timeline
from dayspan.plans import inputs as inp
from dayspan.plans.base import query


@query(
    "unify_dt",
    "SELECT o_orderkey, coalesce(CASE WHEN o_orderkey % 3 = 0 THEN o_orderdate END, "
    "CASE WHEN o_orderkey % 3 = 1 THEN o_orderdate END) AS dt FROM orders",
)
def unify_dt(spark, sf):
    o = inp.table(spark, sf, "orders").select(
        "o_orderkey",
        F.when(F.col("o_orderkey") % 3 == 0, F.col("o_orderdate").cast("string")).alias("dt_response"),
        F.when(F.col("o_orderkey") % 3 == 1, F.col("o_orderdate").cast("string")).otherwise("not a date").alias("startdate"),
    )
    return clean.unify_date(o, ["dt_response", "dt_passive", "startdate"])


@query("to_day", "SELECT event_id, CAST(ts AS DATE) AS dt FROM events")
def to_day(spark, sf):
    return inp.table(spark, sf, "events").select("event_id", F.to_date("ts").alias("dt"))


@query("rename_cols", "SELECT c_custkey AS num_id, c_acctbal AS balance, c_nationkey AS nation FROM customer")
def rename_cols(spark, sf):
    c = inp.table(spark, sf, "customer").select("c_custkey", F.col("c_acctbal").alias("balance_int"), "c_nationkey")
    return clean.rename(c, {"c_custkey": "num_id", "c_nationkey": "nation"}, strip="_int")


@query(
    "cohort_label",
    "SELECT c_custkey, CASE WHEN contains(c_name, '00001') THEN 'V2' ELSE 'V1' END AS v FROM customer",
)
def cohort_label(spark, sf):
    return inp.table(spark, sf, "customer").select("c_custkey", X.cohort(F.col("c_name"), "00001").alias("v"))


@query("baseline_time", "SELECT c_custkey, 0 AS week, 0 AS day FROM customer")
def baseline_time(spark, sf):
    return clean.baseline_time(inp.table(spark, sf, "customer").select("c_custkey"))


_SCORE = "SELECT p_partkey, p_size - 1 AS score FROM part"


def _scores(spark, sf):
    return inp.table(spark, sf, "part").select("p_partkey", (F.col("p_size") - 1).alias("score"))


def _banded(spark, sf, bands, default):
    return _scores(spark, sf).select("p_partkey", "score", X.band(F.col("score"), bands, default).alias("code"))


@query(
    "band_alc",
    f"SELECT *, CASE WHEN score = 0 THEN 0 WHEN score BETWEEN 1 AND 3 THEN 1 WHEN score BETWEEN 4 AND 6 THEN 2 "
    f"WHEN score >= 7 THEN 3 ELSE -1 END AS code FROM ({_SCORE})",
)
def band_alc(spark, sf):
    return _banded(spark, sf, spec.ALCOHOL_BANDS, spec.UNKNOWN)


@query(
    "band_gad",
    f"SELECT *, CASE WHEN score BETWEEN 0 AND 5 THEN 0 WHEN score BETWEEN 5 AND 10 THEN 1 WHEN score BETWEEN 11 AND 15 THEN 2 "
    f"WHEN score >= 16 THEN 3 END AS code FROM ({_SCORE})",
)
def band_gad(spark, sf):
    return _banded(spark, sf, spec.GAD7_BANDS, None)


@query(
    "band_phq9",
    f"SELECT *, CASE WHEN score BETWEEN 0 AND 4 THEN 0 WHEN score BETWEEN 5 AND 9 THEN 1 WHEN score BETWEEN 10 AND 14 THEN 2 "
    f"WHEN score BETWEEN 15 AND 19 THEN 3 WHEN score BETWEEN 20 AND 27 THEN 4 ELSE -1 END AS code FROM ({_SCORE})",
)
def band_phq9(spark, sf):
    return _banded(spark, sf, spec.PHQ9_BANDS, spec.UNKNOWN)


@query(
    "bin_cutoff",
    f"SELECT *, CASE WHEN score BETWEEN 0 AND 9 THEN 0 WHEN score >= 10 THEN 1 END AS phq9_bin, "
    f"CASE WHEN score BETWEEN 0 AND 2 THEN 0 WHEN score >= 3 THEN 1 END AS phq2_bin FROM ({_SCORE})",
)
def bin_cutoff(spark, sf):
    s = F.col("score")
    return _scores(spark, sf).select(
        "p_partkey", "score",
        X.band(s, spec.PHQ9_CUTOFF).alias("phq9_bin"), X.band(s, spec.PHQ2_CUTOFF).alias("phq2_bin"),
    )


@query(
    "band_generic",
    "SELECT c_custkey, CASE WHEN c_acctbal BETWEEN -1000 AND 0 THEN 0 WHEN c_acctbal BETWEEN 0 AND 2500.5 THEN 1 "
    "WHEN c_acctbal BETWEEN 3000 AND 5000 THEN 2 WHEN c_acctbal >= 7000 THEN 3 ELSE 9 END AS code FROM customer",
)
def band_generic(spark, sf):
    bands = ((-1000, 0, 0), (0, 2500.5, 1), (3000, 5000, 2), (7000, None, 3))
    return inp.table(spark, sf, "customer").select("c_custkey", X.band(F.col("c_acctbal"), bands, 9).alias("code"))


@query("mask_lt", "SELECT event_id, CASE WHEN value >= 6 THEN value END AS value FROM events")
def mask_lt(spark, sf):
    return inp.table(spark, sf, "events").select("event_id", X.mask_below(F.col("value"), 6).alias("value"))


_THR = {"view": 30.0, "click": 10.0, "signup": 0.0, "error": 55.5}


@query(
    "na_thresholds",
    f"WITH {inp.SQL_DAY} SELECT num_id, dt, "
    + ", ".join(f"round(CASE WHEN {c} > {t} THEN {c} END, 6) AS {c}" for c, t in _THR.items())
    + ", round(purchase, 6) AS purchase FROM panel",
)
def na_thresholds(spark, sf):
    return inp.rounded(clean.silence_to_missing(inp.panel_day(spark, sf), _THR), inp.FEATURES)


@query(
    "na_threshold_counts",
    f"WITH {inp.SQL_DAY} SELECT " + ", ".join(f"count(*) FILTER ({c} <= {t}) AS {c}" for c, t in _THR.items()) + " FROM panel",
)
def na_threshold_counts(spark, sf):
    return clean.silence_counts(inp.panel_day(spark, sf), _THR)


@query(
    "per_hour",
    f"WITH {inp.SQL_DAY} SELECT num_id, dt, " + ", ".join(f"round({c} / error, 6) AS {c}_hr" for c in ("view", "click", "signup")) + " FROM panel",
)
def per_hour(spark, sf):
    cols = ["view", "click", "signup"]
    rates = clean.per_hour(inp.panel_day(spark, sf), cols, "error", finite=False).select("num_id", "dt", *[f"{c}_hr" for c in cols])
    return inp.rounded(rates, [f"{c}_hr" for c in cols])


@query(
    "indicator_gt0",
    f"WITH {inp.SQL_DAY} SELECT num_id, dt, " + ", ".join(f"CAST(coalesce({c} > 0, false) AS INTEGER) AS {c}_indicator" for c in inp.SENSORS) + " FROM panel",
)
def indicator_gt0(spark, sf):
    p = clean.indicators(inp.panel_day(spark, sf), inp.SENSORS)
    return p.select("num_id", "dt", *[f"{c}_indicator" for c in inp.SENSORS])


@query(
    "nonzero_copy",
    "SELECT l_orderkey, l_linenumber, l_discount, nullif(l_discount, 0) AS l_discount_nonzero, nullif(l_tax, 0) AS l_tax_nonzero FROM lineitem",
)
def nonzero_copy(spark, sf):
    li = inp.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_discount", "l_tax")
    return clean.nonzero_copies(li, ["l_discount", "l_tax"]).drop("l_tax")


@query(
    "missing_indicator",
    f"WITH {inp.SQL_DAY} SELECT num_id, dt, CAST(purchase IS NULL AS INTEGER) AS purchase_indicator FROM panel",
)
def missing_indicator(spark, sf):
    return inp.panel_day(spark, sf).select("num_id", "dt", F.col("purchase").isNull().cast("int").alias("purchase_indicator"))


@query(
    "filter_day_window",
    f"WITH {inp.SQL_WEEKS} SELECT num_id, dt, day, week FROM pw WHERE day < 15 AND NOT (view IS NULL AND click IS NULL) "
    "AND num_id IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')",
)
def filter_day_window(spark, sf):
    cohort = inp.table(spark, sf, "customer").filter(F.col("c_mktsegment") == "BUILDING")
    p = inp.panel_weeks(spark, sf).filter((F.col("day") < 15) & ~(F.col("view").isNull() & F.col("click").isNull()))
    return merge.keep_ids(p, cohort.select(F.col("c_custkey").alias("num_id")), "num_id").select("num_id", "dt", "day", "week")


@query(
    "complete_cases",
    f"WITH {inp.SQL_DAY} SELECT num_id, dt, round(view, 6) AS view, round(click, 6) AS click FROM panel WHERE view IS NOT NULL AND click IS NOT NULL",
)
def complete_cases(spark, sf):
    p = clean.complete_rows(inp.panel_day(spark, sf), ["view", "click"])
    return inp.rounded(p.select("num_id", "dt", "view", "click"), ["view", "click"])


@query(
    "column_completeness",
    f"WITH {inp.SQL_DAY} "
    + " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", count({c}) AS known, count(*) AS rows, CAST(count({c}) = 0 AS INTEGER) AS all_missing, "
        f"CAST(count({c}) = count(*) AS INTEGER) AS all_known FROM panel"
        for c in ("num_id", *inp.FEATURES)
    ),
)
def column_completeness(spark, sf):
    return clean.completeness(inp.panel_day(spark, sf), ["num_id", *inp.FEATURES])


@query(
    "coerce_numeric",
    "SELECT o_orderkey, TRY_CAST(CASE WHEN o_orderkey % 7 = 0 THEN 'n/a' ELSE CAST(o_totalprice AS VARCHAR) END AS DOUBLE) AS price, "
    "TRY_CAST(substr(o_orderpriority, 1, 1) AS DOUBLE) AS priority, TRY_CAST(o_orderstatus AS DOUBLE) AS status FROM orders",
)
def coerce_numeric(spark, sf):
    o = inp.table(spark, sf, "orders").select(
        "o_orderkey",
        F.when(F.col("o_orderkey") % 7 == 0, "n/a").otherwise(F.col("o_totalprice").cast("string")).alias("price"),
        F.substring("o_orderpriority", 1, 1).alias("priority"),
        F.col("o_orderstatus").alias("status"),
    )
    return clean.coerce_numeric(o, ["price", "priority", "status"])


@query(
    "item_sum",
    f"WITH {inp.SQL_DAY} SELECT num_id, dt, " + " + ".join(f"coalesce(CAST(trunc({c}) AS INTEGER), 0)" for c in inp.FEATURES) + " AS total FROM panel",
)
def item_sum(spark, sf):
    return inp.panel_day(spark, sf).select("num_id", "dt", X.item_total([F.col(c) for c in inp.FEATURES]).alias("total"))


@query(
    "clinical_flag",
    f"WITH {inp.SQL_DAY} SELECT num_id, dt, CAST(coalesce(view > 150, false) OR coalesce(click > 120, false) OR coalesce(signup > 100, false) "
    "OR coalesce(error > 150, false) AS INTEGER) AS bin_clin FROM panel",
)
def clinical_flag(spark, sf):
    limits = {"view": 150, "click": 120, "signup": 100, "error": 150}
    return inp.panel_day(spark, sf).select("num_id", "dt", X.any_true([F.col(c) > t for c, t in limits.items()]).alias("bin_clin"))


@query(
    "composite_key",
    f"WITH {inp.SQL_WEEKS} SELECT num_id, dt, concat_ws('_', num_id, day) AS idx, concat_ws('_', num_id, week) AS week_id FROM pw",
)
def composite_key(spark, sf):
    return inp.panel_weeks(spark, sf).select(
        "num_id", "dt",
        F.concat_ws("_", F.col("num_id").cast("string"), F.col("day").cast("string")).alias("idx"),
        F.concat_ws("_", F.col("num_id").cast("string"), F.col("week").cast("string")).alias("week_id"),
    )


_MONTHS = "CASE WHEN month(d) IN (9, 10, 11) THEN 'fall' WHEN month(d) IN (12, 1, 2) THEN 'winter' WHEN month(d) IN (3, 4, 5) THEN 'spring' ELSE 'summer' END"


@query(
    "calendar_parts",
    "SELECT o_orderkey, isodow(o_orderdate) AS day_of_week, month(o_orderdate) AS month FROM orders",
)
def calendar_parts(spark, sf):
    o = inp.table(spark, sf, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("dt"))
    return timeline.calendar_parts(o).select("o_orderkey", F.col("day_of_week").cast("long"), F.col("month").cast("long"))


@query(
    "season",
    f"WITH o AS (SELECT o_orderkey, o_orderdate AS d FROM orders), s AS (SELECT o_orderkey, {_MONTHS} AS season FROM o) "
    "SELECT o_orderkey, season, CASE season WHEN 'fall' THEN 1 WHEN 'winter' THEN 2 WHEN 'spring' THEN 3 WHEN 'summer' THEN 4 END AS season_num FROM s",
)
def season(spark, sf):
    o = inp.table(spark, sf, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("dt"))
    return timeline.calendar_parts(o).select("o_orderkey", "season", "season_num")


@query(
    "trunc_avg_bin",
    f"WITH {inp.SQL_WEEKS} SELECT num_id, week, CAST(trunc(avg(CASE WHEN view > 50 THEN 1.0 WHEN view <= 50 THEN 0.0 END)) AS INTEGER) AS bin_avg FROM pw GROUP BY num_id, week",
)
def trunc_avg_bin(spark, sf):
    bit = F.when(F.col("view") > 50, 1.0).when(F.col("view") <= 50, 0.0)
    return inp.panel_weeks(spark, sf).groupBy("num_id", "week").agg(F.avg(bit).cast("int").alias("bin_avg"))


@query(
    "log1p_safe",
    "SELECT c_custkey, c_acctbal, round(ln(1 + c_custkey), 6) AS key_log FROM customer",
)
def log1p_safe(spark, sf):
    c = inp.table(spark, sf, "customer").select("c_custkey", "c_acctbal", F.col("c_custkey").alias("key_log"))
    return inp.rounded(clean.log1p_safe(c, ["c_acctbal", "key_log"])[0], ["key_log"])


@query(
    "fix_nonfinite",
    "SELECT l_orderkey, l_linenumber, l_tax, CASE WHEN l_discount = 0 AND l_tax = 0 THEN 0.0 WHEN l_discount = 0 THEN 1.0 "
    "ELSE round(l_tax / l_discount, 6) END AS unit, CASE WHEN l_discount = 0 THEN NULL ELSE round(l_tax / l_discount, 6) END AS gap FROM lineitem",
)
def fix_nonfinite(spark, sf):
    li = inp.table(spark, sf, "lineitem")
    inf, nan = F.lit(float("inf")), F.lit(float("nan"))
    ratio = F.when((F.col("l_discount") == 0) & (F.col("l_tax") == 0), nan).when(F.col("l_discount") == 0, inf).otherwise(
        F.try_divide("l_tax", "l_discount")
    )
    out = li.select("l_orderkey", "l_linenumber", "l_tax", X.finite_or_unit(ratio).alias("unit"), X.finite_or_missing(ratio).alias("gap"))
    return inp.rounded(out, ["unit", "gap"])


@query(
    "survey_week_filter",
    f"WITH {inp.SQL_WEEKS}, s AS (SELECT e.num_id, pw.week, CASE e.event_type WHEN 'view' THEN 'phq9' WHEN 'click' THEN 'sds' WHEN 'signup' THEN 'sleep' ELSE 'gic' END AS survey "
    "FROM ev e JOIN pw ON pw.num_id = e.num_id AND pw.dt = e.dt) SELECT survey, week, count(*) AS n FROM s "
    "WHERE (survey = 'phq9' AND week IN (1,2,3,4,6,8,10,12)) OR (survey = 'sds' AND week IN (1,2,3,4)) OR (survey = 'sleep' AND week IN (0,4,8,12)) "
    "OR (survey = 'gic' AND week BETWEEN 0 AND 12) GROUP BY survey, week",
)
def survey_week_filter(spark, sf):
    e = inp.ev_raw(spark, sf).groupBy("num_id", "dt", "event_type").agg(F.count(F.lit(1)).alias("n"))
    weeks = inp.panel_weeks(spark, sf).select("num_id", "dt", "week")
    survey = F.when(F.col("event_type") == "view", "phq9").when(F.col("event_type") == "click", "sds").when(F.col("event_type") == "signup", "sleep").otherwise("gic")
    s = e.join(weeks, ["num_id", "dt"]).withColumn("survey", survey)
    return timeline.survey_weeks(s, spec.SURVEY_WEEKS, "survey").groupBy("survey", "week").agg(F.sum("n").alias("n"))


# The event panel with indicator copies of its sensors.
PANEL = spec.PanelSpec(features=tuple(inp.SENSORS), targets=("purchase",))
_ROLE_OF = {"num_id": ("id", "", 1), "dt": ("id", "", 0), "purchase": ("target", "", 1), **{c: ("feature", "", 1) for c in inp.SENSORS},
            **{f"{c}_indicator": ("feature", "_indicator", 1) for c in inp.SENSORS}}


@query(
    "column_catalogue",
    f"WITH {inp.SQL_DAY}, c AS (SELECT *, " + ", ".join(f"coalesce({c} > 0, false) AS {c}_indicator" for c in inp.SENSORS) + " FROM panel) "
    + " UNION ALL ".join(
        f"SELECT '{c}' AS column, '{role}' AS role, '{suffix}' AS suffix, {numeric} AS numeric, count({c}) AS known, count(*) - count({c}) AS gaps FROM c"
        for c, (role, suffix, numeric) in _ROLE_OF.items()),
)
def column_catalogue(spark, sf):
    p = clean.indicators(inp.panel_day(spark, sf), inp.SENSORS)
    return clean.catalogue(p.select(*_ROLE_OF), PANEL, ["_indicator"])


@query(
    "role_columns",
    f"WITH {inp.SQL_DAY} SELECT num_id, dt, " + ", ".join(f"CAST(coalesce({c} > 0, false) AS INTEGER) AS {c}_indicator" for c in inp.SENSORS) + ", purchase FROM panel",
)
def role_columns(spark, sf):
    """Ids, indicator copies of the features and the targets, chosen by role."""
    p = clean.indicators(inp.panel_day(spark, sf), clean.columns_of(inp.panel_day(spark, sf), PANEL, "feature"))
    chosen = [c for role, suffix in (("id", ""), ("feature", "_indicator"), ("target", "")) for c in clean.columns_of(p, PANEL, role, suffix)]
    return p.select(*chosen)
