"""Encoding, scaling, transforms and imputation."""

from __future__ import annotations

from pyspark.sql import functions as F

from dayspan.functions.columns import stable_hash
from dayspan.operators import encode, impute, transform
from dayspan.operators import timeline as tl
from dayspan.plans import inputs as inp
from dayspan.session import cut_lineage
from dayspan.plans.base import hash_sql, query, r6

_CODES = "SELECT *, dense_rank() OVER (ORDER BY c_mktsegment) - 1 AS seg, CASE WHEN region IS NULL THEN (SELECT count(DISTINCT region) FROM d) ELSE dense_rank() OVER (ORDER BY region NULLS LAST) - 1 END AS reg FROM d"
_D = f"{inp.SQL_DEMO}, d AS (SELECT num_id, c_mktsegment, CASE WHEN c_acctbal > 0 THEN r_name END AS region FROM demo)"


def _demo(spark, sf):
    return inp.demo(spark, sf).select("num_id", "c_mktsegment", F.when(F.col("c_acctbal") > 0, F.col("r_name")).alias("region"))


@query("label_encode", f"WITH {_D}, e AS ({_CODES}) SELECT num_id, seg AS c_mktsegment, reg AS region FROM e")
def label_encode(spark, sf):
    return encode.label_encode(_demo(spark, sf), ["c_mktsegment", "region"])[0]


@query("label_decode", f"WITH {_D} SELECT num_id, c_mktsegment, region FROM d")
def label_decode(spark, sf):
    coded, key = encode.label_encode(_demo(spark, sf), ["c_mktsegment", "region"])
    return encode.label_decode(coded, ["c_mktsegment", "region"], key)


@query(
    "zscore",
    "SELECT l_orderkey, l_linenumber, " + ", ".join(
        f"round(({c} - (SELECT avg({c}) FROM lineitem)) / (SELECT stddev_pop({c}) FROM lineitem), 6) AS {c}" for c in inp.LINE
    ) + " FROM lineitem",
)
def zscore(spark, sf):
    li = inp.line_numbers(spark, sf).select("l_orderkey", "l_linenumber", *inp.LINE)
    return inp.rounded(transform.zscore(li, inp.LINE), inp.LINE)


@query(
    "minmax_nonzero",
    "SELECT l_orderkey, l_linenumber, " + ", ".join(
        f"round((nullif({c}, 0) - (SELECT min(nullif({c}, 0)) FROM lineitem)) / (SELECT max(nullif({c}, 0)) - min(nullif({c}, 0)) FROM lineitem), 6) AS {c}"
        for c in ("l_discount", "l_tax")
    ) + " FROM lineitem",
)
def minmax_nonzero(spark, sf):
    cols = ["l_discount", "l_tax"]
    li = inp.line_numbers(spark, sf).select("l_orderkey", "l_linenumber", *cols)
    return inp.rounded(transform.minmax_nonzero(li, cols), cols)


@query("grubbs_outliers")
def grubbs_outliers(spark, sf):
    e = inp.table(spark, sf, "events").select("event_id", "user_id", "value")
    return transform.grubbs_outliers(e, ["value"])


@query("boxcox")
def boxcox(spark, sf):
    e = inp.table(spark, sf, "events").select("event_id", "value")
    return transform.boxcox(e, ["value"])[0]


_GRID0 = "SELECT 0.0 AS centre, 5.0 AS width"


def _refine(level: int) -> str:
    """One grid of 41 exponents around the best one so far."""
    return (
        f"g{level} AS (SELECT (centre - width) + width / 20 * i AS lam, width FROM b{level - 1}, range(0, 41) r(i)), "
        f"b{level} AS (SELECT arg_min(lam, v) AS centre, max(width) / 20 AS width FROM (SELECT lam, max(width) AS width, "
        f"var_pop(CASE WHEN abs(lam) < 1e-12 THEN z ELSE (exp(lam * z) - 1) / lam END) AS v FROM g{level}, z GROUP BY lam))"
    )


@query(
    "boxcox_lambda",
    f"WITH z AS (SELECT ln(value) - (SELECT avg(ln(value)) FROM events) AS z FROM events), b0 AS ({_GRID0}), {', '.join(_refine(i) for i in range(1, 6))} "
    "SELECT 'value' AS \"column\", round(centre, 3) AS lam FROM b5",
)
def boxcox_lambda(spark, sf):
    lams = transform.boxcox_lambdas(inp.table(spark, sf, "events").select("value"), ["value"])
    return spark.createDataFrame([(c, round(v, 3)) for c, v in lams.items()], "column string, lam double")


def _residual_sql(y: str) -> str:
    return (
        f"{y} - avg_{y} - b1_{y} * (l_discount - avg_d) - b2_{y} * (l_tax - avg_t)"
    )


_RES = (
    "WITH s AS (SELECT avg(l_discount) AS avg_d, avg(l_tax) AS avg_t, var_pop(l_discount) AS dd, var_pop(l_tax) AS tt, covar_pop(l_discount, l_tax) AS dt, "
    + ", ".join(f"avg({y}) AS avg_{y}, covar_pop(l_discount, {y}) AS d_{y}, covar_pop(l_tax, {y}) AS t_{y}" for y in ("l_quantity", "l_extendedprice"))
    + " FROM lineitem), b AS (SELECT *, "
    + ", ".join(
        f"(d_{y} * tt - t_{y} * dt) / (dd * tt - dt * dt) AS b1_{y}, (t_{y} * dd - d_{y} * dt) / (dd * tt - dt * dt) AS b2_{y}"
        for y in ("l_quantity", "l_extendedprice")
    )
    + " FROM s) "
)


@query(
    "residualise",
    _RES + f"SELECT l_orderkey, l_linenumber, round({_residual_sql('l_quantity')}, 6) AS l_quantity, round({_residual_sql('l_extendedprice')}, 6) AS l_extendedprice FROM lineitem, b",
)
def residualise(spark, sf):
    li = inp.line_numbers(spark, sf).select("l_orderkey", "l_linenumber", *inp.LINE)
    out = transform.residualise(li, ["l_quantity", "l_extendedprice"], ["l_discount", "l_tax"])
    return inp.rounded(out.drop("l_discount", "l_tax"), ["l_quantity", "l_extendedprice"])


# Row key of a person-day as one integer.
def keyed_panel(spark, sf):
    p = inp.panel_day(spark, sf)
    return p.withColumn("cell_row", F.col("num_id") * 100000 + F.datediff("dt", F.lit("2000-01-01")))


_KEYED = f"{inp.SQL_DAY}, kp AS (SELECT num_id * 100000 + date_diff('day', DATE '2000-01-01', dt) AS cell_row, num_id, dt, {', '.join(inp.FEATURES)} FROM panel)"


_CELLS = " UNION ALL ".join(f"SELECT cell_row, '{c}' AS \"column\", {c} AS value, {hash_sql(f'cell_row * 5 + {i}')} AS h FROM kp" for i, c in enumerate(inp.FEATURES))
_HIDDEN = (
    f"{_KEYED}, cells AS ({_CELLS}), hid AS (SELECT * FROM (SELECT *, row_number() OVER (ORDER BY h, cell_row, \"column\") AS pos FROM cells WHERE value IS NOT NULL) "
    f"WHERE pos <= (SELECT CAST(floor(count(*) * {len(inp.FEATURES)} * 0.1) AS BIGINT) FROM kp))"
)


@query(
    "simulate_missing",
    f"WITH {_HIDDEN} SELECT kp.cell_row, " + ", ".join(
        f"round(CASE WHEN kp.cell_row IN (SELECT cell_row FROM hid WHERE \"column\" = '{c}') THEN NULL ELSE kp.{c} END, 6) AS {c}" for c in inp.FEATURES
    ) + " FROM kp",
)
def simulate_missing(spark, sf):
    masked, _ = impute.simulate_missing(keyed_panel(spark, sf), "cell_row", inp.FEATURES)
    return inp.rounded(masked.select("cell_row", *inp.FEATURES), inp.FEATURES)


@query("simulate_missing_truth", f"WITH {_HIDDEN} SELECT cell_row, \"column\", round(value, 6) AS value FROM hid")
def simulate_missing_truth(spark, sf):
    return inp.rounded(impute.simulate_missing(keyed_panel(spark, sf), "cell_row", inp.FEATURES)[1], ["value"])


_ONE = (
    f"{_KEYED}, hid AS (SELECT cell_row FROM (SELECT cell_row, row_number() OVER (ORDER BY {hash_sql('cell_row')}, cell_row) AS pos FROM kp WHERE view IS NOT NULL) "
    "WHERE pos <= (SELECT CAST(floor(count(*) * 0.1) AS BIGINT) FROM kp))"
)


@query(
    "simulate_missing_col",
    f"WITH {_ONE} SELECT cell_row, round(CASE WHEN cell_row IN (SELECT cell_row FROM hid) THEN NULL ELSE view END, 6) AS view FROM kp",
)
def simulate_missing_col(spark, sf):
    masked, _ = impute.simulate_missing_col(keyed_panel(spark, sf), "cell_row", "view")
    return inp.rounded(masked.select("cell_row", "view"), ["view"])


_PAIRED = (
    f"{_HIDDEN}, pm AS (SELECT num_id, " + ", ".join(f"avg({c}) AS {c}" for c in inp.FEATURES) + " FROM kp GROUP BY 1), "
    "pairs AS (" + " UNION ALL ".join(
        f"SELECT hid.\"column\", hid.value, pm.{c} AS guess FROM hid JOIN kp ON kp.cell_row = hid.cell_row JOIN pm ON pm.num_id = kp.num_id WHERE hid.\"column\" = '{c}'"
        for c in inp.FEATURES
    ) + "), both_ AS (SELECT \"column\", value AS x, 1 AS a FROM pairs UNION ALL SELECT \"column\", guess, 0 FROM pairs), "
    "cum AS (SELECT DISTINCT \"column\", x, sum(a) OVER w AS ca, sum(1 - a) OVER w AS cb FROM both_ WINDOW w AS (PARTITION BY \"column\" ORDER BY x)), "
    "ks AS (SELECT \"column\", max(abs(CAST(ca AS DOUBLE) - cb)) AS gap, max(ca) AS n FROM cum GROUP BY 1), "
    "e AS (SELECT \"column\", count(*) AS cells, sqrt(avg((value - guess) ** 2)) / avg(value) AS rmse_scaled, 1 - avg((value - guess) ** 2) / var_pop(value) AS r2 FROM pairs GROUP BY 1), "
    "x AS (SELECT e.*, ks.gap / ks.n * sqrt(CAST(ks.n AS DOUBLE) / 2) AS lam FROM e JOIN ks ON ks.\"column\" = e.\"column\")"
)


@query(
    "imputation_error",
    f"WITH {_PAIRED} SELECT \"column\", cells, round(rmse_scaled, 6) AS rmse_scaled, round(r2, 6) AS r2, "
    "round(least(1.0, 2 * (SELECT sum((CASE WHEN k % 2 = 1 THEN 1 ELSE -1 END) * exp(-2.0 * k * k * lam * lam)) FROM range(1, 101) t(k))), 6) AS p_value FROM x",
)
def imputation_error(spark, sf):
    """Hidden cells guessed by the person's mean, scored per column."""
    p = cut_lineage(keyed_panel(spark, sf))
    _, truth = impute.simulate_missing(p, "cell_row", inp.FEATURES)
    means = p.groupBy("num_id").agg(*[F.avg(c).alias(c) for c in inp.FEATURES])
    guess = p.select("cell_row", "num_id").join(means, "num_id")
    errors = impute.imputation_error(impute.compare_cells(truth, guess, "cell_row", inp.FEATURES), ["column"])
    return inp.rounded(errors, ["rmse_scaled", "r2", "p_value"])


def known_panel(spark, sf):
    """Interpolated daily panel with a row key: dense enough for the imputation gates."""
    p = tl.interpolate_weekly(inp.panel_full(spark, sf), inp.FEATURES, 10.0)
    return p.select("num_id", "dt", (F.col("num_id") * 100000 + F.datediff("dt", F.lit("2000-01-01"))).alias("cell_row"), *[F.col(f"{c}_int").alias(c) for c in inp.FEATURES])


PLANTED = ("load", "steps", "rest")


def planted_panel(spark, sf):
    """The densified person-days with planted columns: ``steps`` and ``rest`` follow ``load``, ``chance`` follows nothing.

    Every fifth person has no structure, every seventh has most cells missing; an eighth of the other cells is missing.
    """
    days = inp.panel_full(spark, sf).select("num_id", "dt", (F.col("num_id") * 100000 + F.datediff("dt", F.lit("2000-01-01"))).alias("cell_row"))
    u = lambda seed: stable_hash(F.col("cell_row"), seed) / F.lit(float(1 << 32))
    load = 10 * u(101)
    loose = F.col("num_id") % 5 == 0
    values = {
        "load": load,
        "steps": F.when(loose, 30 * u(103)).otherwise(3 * load + u(102)),
        "rest": F.when(loose, 10 + 10 * u(105)).otherwise(20 - load + u(104)),
        "chance": 10 * u(106),
    }
    gap = F.when(F.col("num_id") % 7 == 3, F.lit(60)).otherwise(F.lit(12))
    cells = [F.when(stable_hash(F.col("cell_row"), 110 + i) % 100 >= gap, v).alias(c) for i, (c, v) in enumerate(values.items())]
    return days.select("num_id", "dt", "cell_row", *cells)


def _structured(spark, sf):
    return planted_panel(spark, sf).filter("num_id % 5 <> 0 and num_id % 7 <> 3")


@query("rf_impute")
def rf_impute(spark, sf):
    return impute.impute_table(_structured(spark, sf), "cell_row", PLANTED)[0]


@query("rf_impute_refused")
def rf_impute_refused(spark, sf):
    """The measured panel: its columns tell nothing of each other, so the ledger refuses it."""
    return impute.impute_table(known_panel(spark, sf), "cell_row", inp.FEATURES, 0.5)[1]


@query("rf_impute_by_person")
def rf_impute_by_person(spark, sf):
    return impute.impute_by_person(planted_panel(spark, sf), "cell_row", PLANTED)[0]


@query("rf_impute_by_column")
def rf_impute_by_column(spark, sf):
    return impute.impute_by_column(_structured(spark, sf), "cell_row", ("load", "steps", "chance"))[0]


@query("impute_column_ledger")
def impute_column_ledger(spark, sf):
    return impute.impute_by_column(_structured(spark, sf), "cell_row", ("load", "steps", "chance"))[1]


_GAPS = ", ".join(
    f"CASE WHEN {hash_sql('cell_row', 110 + i)} % 100 >= CASE WHEN num_id % 7 = 3 THEN 60 ELSE 12 END THEN 1 END AS {c}" for i, c in enumerate(PLANTED)
)
_LEDGER = (
    f"WITH {inp.SQL_FULL}, k AS (SELECT num_id, num_id * 100000 + date_diff('day', DATE '2000-01-01', dt) AS cell_row FROM pf), g AS (SELECT num_id, cell_row, {_GAPS} FROM k), "
    f"l AS (SELECT num_id, count(*) AS rows, ({' + '.join(f'count({c})' for c in PLANTED)}) / (count(*) * {len(PLANTED)}) AS share FROM g GROUP BY 1), "
    "e AS (SELECT *, CAST(rows >= 20 AND share >= 0.6 AS INTEGER) AS eligible FROM l), pool AS (SELECT g.* FROM g JOIN e USING (num_id) WHERE eligible = 1), "
    "c AS (" + " UNION ALL ".join(f"SELECT num_id, cell_row, '{c}' AS col, {hash_sql(f'(cell_row * {len(PLANTED)} + {i})')} AS h FROM pool WHERE {c} IS NOT NULL" for i, c in enumerate(PLANTED)) + "), "
    f"hid AS (SELECT num_id, row_number() OVER (ORDER BY h, cell_row, col) AS n FROM c), "
    f"cut AS (SELECT num_id, count(*) AS cells FROM hid WHERE n <= floor((SELECT count(*) FROM pool) * {len(PLANTED)} * CAST(0.1 AS DOUBLE)) GROUP BY 1) "
    "SELECT num_id, rows, round(share, 6) AS share, eligible, cells FROM e LEFT JOIN cut USING (num_id)"
)


@query("impute_ledger", _LEDGER)
def impute_ledger(spark, sf):
    ledger = impute.impute_by_person(planted_panel(spark, sf), "cell_row", PLANTED)[1]
    return inp.rounded(ledger.select("num_id", "rows", "share", "eligible", "cells"), ["share"])


@query("impute_verdicts")
def impute_verdicts(spark, sf):
    """Who is imputed: persons with structure and enough known cells are, the others keep their gaps."""
    ledger = impute.impute_by_person(planted_panel(spark, sf), "cell_row", PLANTED)[1]
    return ledger.select("num_id", "rmse_scaled", "r2", "p_value", "accepted")


@query("fill_zero", f"WITH {inp.SQL_DAY} SELECT num_id, dt, " + ", ".join(f"round(coalesce({c}, 0), 6) AS {c}" for c in inp.FEATURES) + " FROM panel")
def fill_zero(spark, sf):
    return inp.rounded(inp.panel_day(spark, sf).na.fill(0.0, list(inp.FEATURES)), inp.FEATURES)


@query("coalesce_cols", f"WITH {inp.SQL_DAY} SELECT num_id, dt, round(coalesce(view, click, signup), 6) AS first_known FROM panel")
def coalesce_cols(spark, sf):
    return inp.panel_day(spark, sf).select("num_id", "dt", r6(F.coalesce("view", "click", "signup")).alias("first_known"))
