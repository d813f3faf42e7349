"""Models, comparisons, metrics and attributions."""

from __future__ import annotations

from pyspark.ml.regression import DecisionTreeRegressor
from pyspark.sql import functions as F

from dayspan.operators import attribution, evaluation as ev, models as mo, neighbours, splits
from dayspan.plans import inputs as inp
from dayspan.plans.base import hash_sql, query
from dayspan.plans.preparing import _RES, known_panel
from dayspan.plans.time import _interp

LX = ["l_quantity", "l_discount", "l_tax"]


@query(
    "ols",
    _RES + ", f AS (SELECT l_extendedprice AS y, avg_l_extendedprice + b1_l_extendedprice * (l_discount - avg_d) + b2_l_extendedprice * (l_tax - avg_t) AS g FROM lineitem, b) "
    "SELECT 'intercept' AS term, round(avg_l_extendedprice - b1_l_extendedprice * avg_d - b2_l_extendedprice * avg_t, 6) AS value FROM b "
    "UNION ALL SELECT 'l_discount', round(b1_l_extendedprice, 6) FROM b UNION ALL SELECT 'l_tax', round(b2_l_extendedprice, 6) FROM b "
    "UNION ALL SELECT 'r2', round(1 - avg((y - g) ** 2) / var_pop(y), 6) FROM f",
)
def ols(spark, sf):
    return inp.rounded(mo.ols(inp.line_numbers(spark, sf), "l_extendedprice", ["l_discount", "l_tax"]), ["value"])


@query("mixed_lm")
def mixed_lm(spark, sf):
    return mo.mixed_lm(inp.line_numbers(spark, sf), "l_extendedprice", ["l_quantity", "l_discount"], "l_suppkey")


def panel_rows(spark, sf):
    """Complete person-days with row key, day and target, gaps of sensors filled by zero."""
    p = known_panel(spark, sf)
    day = F.datediff("dt", F.lit("2024-01-01"))
    return p.filter(F.col("purchase").isNotNull()).select(
        "num_id", "cell_row", day.alias("day"), *[F.coalesce(c, F.lit(0.0)).alias(c) for c in inp.SENSORS],
        "purchase", (F.col("purchase") > 50).cast("double").alias("high"),
    )


def split_table(spark, sf, target: str, folds: int = 3, grouped: bool = True):
    """Sensors, y, split and fold, computed once; persons never cross a split or a fold when grouped."""
    rows = panel_rows(spark, sf)
    if grouped:
        rows = mo.cut_lineage(rows)  # both draws and the join read it
        rows = rows.join(splits.group_split(rows), "num_id").join(splits.group_kfold(rows, k=folds).select("num_id", "fold"), "num_id")
    else:
        rows = splits.kfold(splits.row_split3(rows, "cell_row"), "cell_row", folds)
    # Equal parts: the slices that ranked the rows share partitions unevenly, and every fit would wait for the largest.
    rows = rows.repartition(2 * spark.sparkContext.defaultParallelism, "cell_row").sortWithinPartitions("cell_row")
    return mo.cut_lineage(rows.select("num_id", "cell_row", "day", *inp.SENSORS, F.col(target).alias("y"), "split", "fold"))


def with_vector(table, cols=inp.SENSORS):
    return mo.assemble(table, cols, ["num_id", "cell_row", "day", "y", "split", "fold"])


def split_rows(spark, sf, target: str, folds: int = 3, grouped: bool = True):
    """features, y, split and fold of ``split_table``."""
    return with_vector(split_table(spark, sf, target, folds, grouped))


@query("dt_regressor")
def dt_regressor(spark, sf):
    return mo.tree_regressor_report(split_rows(spark, sf, "purchase", grouped=False, folds=5))


@query("dt_classifier")
def dt_classifier(spark, sf):
    return mo.tree_classifier_report(split_rows(spark, sf, "high", grouped=False, folds=5))


def _tail_rows(spark, sf, target):
    rows = splits.tail_split(panel_rows(spark, sf), ["day", "num_id"]).withColumn("y", F.col(target))
    return mo.cut_lineage(mo.assemble(rows, inp.SENSORS, ["num_id", "y", "split"]))


@query("rf_regressor")
def rf_regressor(spark, sf):
    return mo.fit_and_score(mo.forest(trees=30), _tail_rows(spark, sf, "purchase"))


@query("rf_classifier")
def rf_classifier(spark, sf):
    return mo.fit_and_score(mo.forest(True, trees=30), _tail_rows(spark, sf, "high"), classify=True)


@query("walk_forward")
def walk_forward(spark, sf):
    out = mo.walk_forward(panel_rows(spark, sf), inp.SENSORS, "purchase", share=0.15)
    return mo.walk_forward_report(out)


@query("walk_forward_by_person")
def walk_forward_by_person(spark, sf):
    out = mo.walk_forward(panel_rows(spark, sf), inp.SENSORS, "purchase", share=0.15)
    return mo.walk_forward_report(out, ["num_id"])


@query(
    "expanding_forecast",
    "WITH r AS (SELECT o_custkey AS num_id, CAST(o_orderdate AS DATE) AS dt, avg(o_totalprice) AS y, CAST(count(*) AS DOUBLE) AS n FROM orders GROUP BY 1, 2), "
    "x AS (SELECT *, CAST(date_diff('day', DATE '1995-01-01', dt) AS DOUBLE) AS day FROM r) "
    "SELECT num_id, day, round(y, 6) AS y, round(CASE WHEN count(*) OVER w > 8 THEN regr_intercept(y, day) OVER w + regr_slope(y, day) OVER w * day END, 4) AS prediction "
    "FROM x WINDOW w AS (PARTITION BY num_id ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)",
)
def expanding_forecast(spark, sf):
    o = inp.table(spark, sf, "orders")
    daily = o.groupBy(F.col("o_custkey").alias("num_id"), F.to_date("o_orderdate").alias("dt")).agg(F.avg("o_totalprice").alias("price"))
    x = daily.withColumn("day", F.datediff("dt", F.lit("1995-01-01")).cast("double")).withColumn("at", F.col("day"))
    out = mo.expanding_forecast(x, "price", "at")
    return inp.rounded(out, ["y"]).withColumn("prediction", F.round(F.col("prediction") + 1e-9, 4))


def _small_grid(names, iterations=None, trees=100):
    """Some members of the grid, by default with all their rounds and trees."""
    return {n: m for n, m in mo.regressors(iterations, trees).items() if n in names}


@query("compare_regressors")
def compare_regressors(spark, sf):
    table = split_table(spark, sf, "purchase")
    data = {"sensors": with_vector(table), "view_click": with_vector(table, ["view", "click"])}
    return mo.compare(data, _small_grid(("linear", "decision_tree", "random_forest", "gbt_gradient")), 3)


@query("gbt_regressor")
def gbt_regressor(spark, sf):
    rows = split_rows(spark, sf, "purchase")
    return mo.compare({"sensors": rows}, _small_grid(("gbt_gradient", "gbt_hist", "gbt_xgb", "gbt_cat"), iterations=5, trees=10), 0)


@query("bagging_regressor")
def bagging_regressor(spark, sf):
    return mo.fit_and_score(mo.regressors()["bagging"], split_rows(spark, sf, "purchase"))


@query("adaboost_regressor")
def adaboost_regressor(spark, sf):
    rows = split_rows(spark, sf, "purchase")
    out = mo.adaboost_r2(rows.filter("split = 'train'"), rows.filter("split = 'test'"), rounds=5)
    return ev.regression_metrics(out)


@query("compare_classifiers")
def compare_classifiers(spark, sf):
    rows = split_rows(spark, sf, "high", grouped=False, folds=10)
    return mo.compare({"sensors": rows}, mo.classifiers(), 10, classify=True)


_VSQ = " + ".join(f"(a.x{i} - b.x{i}) ** 2" for i in range(1, inp.WIDTH + 1))
_TEST = f"{inp.SQL_VEC}, p AS (SELECT *, row_number() OVER (ORDER BY {hash_sql('vec_id')}, vec_id) AS pos, count(*) OVER () AS n FROM vec)"


@query(
    "knn_classify",
    f"WITH {_TEST}, te AS (SELECT * FROM p WHERE pos <= ceil(n * CAST(0.15 AS DOUBLE))), tr AS (SELECT * FROM p WHERE pos > ceil(n * CAST(0.15 AS DOUBLE))), "
    f"k AS (SELECT a.vec_id, b.label, row_number() OVER (PARTITION BY a.vec_id ORDER BY {_VSQ}, b.vec_id) AS rn FROM te a JOIN tr b ON true), "
    "c AS (SELECT vec_id, label, count(*) AS n FROM k WHERE rn <= 5 GROUP BY 1, 2) "
    "SELECT vec_id, label AS prediction FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY n DESC, label) AS rn FROM c) WHERE rn = 1",
)
def knn_classify(spark, sf):
    v = splits.row_split3(inp.vectors(spark, sf), "vec_id", 0.15, 0.0)
    return neighbours.knn_classify(v.filter("split != 'test'"), v.filter("split = 'test'"), "vec_id", [f"x{i}" for i in range(1, inp.WIDTH + 1)], "label")


@query("linear_svc")
def linear_svc(spark, sf):
    return mo.fit_and_score(mo.linear_svc(30), split_rows(spark, sf, "high"), classify=True)


def _units(spark, sf):
    return splits.window_split(panel_rows(spark, sf), (0, 17), (20, 29))


_KP = (
    f"{inp.SQL_FULL}, fi AS (SELECT num_id, dt, {', '.join(_interp(c, 10.0) for c in inp.FEATURES)} FROM pf), "
    "rows_ AS (SELECT num_id, date_diff('day', DATE '2024-01-01', dt) AS day, CASE WHEN purchase_int > 50 THEN 1.0 ELSE 0.0 END AS y, "
    + ", ".join(f"coalesce({c}_int, 0) AS x{i}" for i, c in enumerate(inp.SENSORS))
    + ", 1.0 AS x4 FROM fi WHERE purchase_int IS NOT NULL)"
)
_LOGIT = "1 / (1 + exp(-(" + " + ".join(f"x{i} * w{i}" for i in range(5)) + ")))"


def _adam(steps: int = 10, rate: float = 0.001) -> str:
    out = ["s0 AS (SELECT DISTINCT num_id, " + ", ".join(f"0.0::DOUBLE AS w{i}, 0.0::DOUBLE AS m{i}, 0.0::DOUBLE AS v{i}" for i in range(5)) + " FROM rows_ WHERE day BETWEEN 0 AND 17)"]
    for t in range(1, steps + 1):
        out.append(
            f"g{t} AS (SELECT num_id, " + ", ".join(f"avg(({_LOGIT} - y) * x{i}) AS g{i}" for i in range(5))
            + f" FROM rows_ JOIN s{t - 1} USING (num_id) WHERE day BETWEEN 0 AND 17 GROUP BY 1)"
        )
        out.append(
            f"h{t} AS (SELECT num_id, " + ", ".join(f"w{i}, 0.9::DOUBLE * m{i} + 0.1::DOUBLE * g{i} AS m{i}, 0.999::DOUBLE * v{i} + 0.001::DOUBLE * g{i} * g{i} AS v{i}" for i in range(5))
            + f" FROM s{t - 1} JOIN g{t} USING (num_id))"
        )
        a, b = 1 - 0.9**t, 1 - 0.999**t
        out.append(
            f"s{t} AS (SELECT num_id, " + ", ".join(f"w{i} - {rate}::DOUBLE * (m{i} / {a}::DOUBLE) / (sqrt(v{i} / {b}::DOUBLE) + 1e-8::DOUBLE) AS w{i}, m{i}, v{i}" for i in range(5)) + f" FROM h{t})"
        )
    return ", ".join(out)


@query(
    "per_person_logistic",
    f"WITH {_KP}, {_adam()}, e AS (SELECT num_id, y, {_LOGIT} AS p FROM rows_ JOIN s10 USING (num_id) WHERE day BETWEEN 20 AND 29) "
    "SELECT num_id, count(*) AS n, round(avg(CASE WHEN (p > 0.5) = (y = 1) THEN 1.0 ELSE 0.0 END), 6) AS accuracy, round(avg(-(y * ln(p) + (1 - y) * ln(1 - p))), 6) AS loss FROM e GROUP BY 1",
)
def per_person_logistic(spark, sf):
    rows = mo.cut_lineage(_units(spark, sf))
    w = mo.per_person_logistic(rows.filter("split = 'train'"), inp.SENSORS, "high")
    return inp.rounded(mo.logistic_accuracy(rows.filter("split = 'val'"), w, inp.SENSORS, "high"), ["accuracy", "loss"])


@query(
    "regression_metrics",
    f"WITH {inp.SQL_WEEKS}, g AS (SELECT week, purchase AS y, view AS f FROM pw WHERE purchase IS NOT NULL AND view IS NOT NULL) "
    "SELECT week, count(*) AS n, round(1 - avg((y - f) ** 2) / var_pop(y), 6) AS r2, round(avg(abs(y - f)), 6) AS mae, round(avg((y - f) ** 2), 6) AS mse, "
    "round(sqrt(avg((y - f) ** 2)), 6) AS rmse, round(corr(y, f), 6) AS pearson FROM g GROUP BY 1",
)
def regression_metrics(spark, sf):
    g = inp.panel_weeks(spark, sf).select("week", F.col("purchase").alias("y"), F.col("view").alias("prediction")).na.drop("any")
    return inp.rounded(ev.regression_metrics(g, ["week"]), ["r2", "mae", "mse", "rmse", "pearson"])


@query(
    "classification_metrics",
    "WITH g AS (SELECT l_linestatus AS s, CAST(l_returnflag = 'A' AS INTEGER) AS y, l_quantity / 50 AS p FROM lineitem), "
    "r AS (SELECT *, rank() OVER (PARTITION BY s ORDER BY p) + (count(*) OVER (PARTITION BY s, p) - 1) / 2.0 AS rk FROM g) "
    "SELECT s, count(*) AS n, round(avg(CAST(y = CAST(p > 0.5 AS INTEGER) AS INTEGER)), 6) AS accuracy, round(avg(p), 6) AS mean_probability, "
    "round((sum(CASE WHEN y = 1 THEN rk ELSE 0 END) - CAST(sum(y) AS DOUBLE) * (sum(y) + 1) / 2) / (CAST(sum(y) AS DOUBLE) * sum(1 - y)), 6) AS auc FROM r GROUP BY 1",
)
def classification_metrics(spark, sf):
    p = F.col("l_quantity") / 50
    g = inp.line_numbers(spark, sf).select(
        F.col("l_linestatus").alias("s"), (F.col("l_returnflag") == "A").cast("int").alias("y"), p.alias("probability"), (p > 0.5).cast("int").alias("prediction")
    )
    return inp.rounded(ev.classification_metrics(g, ["s"]), ["accuracy", "mean_probability", "auc"])


@query(
    "person_r2",
    f"WITH {inp.SQL_DAY}, g AS (SELECT num_id, purchase AS y, view AS f FROM panel WHERE purchase IS NOT NULL AND view IS NOT NULL), "
    "m AS (SELECT num_id, count(*) AS n, CASE WHEN var_pop(y) > 0 THEN 1 - avg((y - f) ** 2) / var_pop(y) END AS r2 FROM g GROUP BY 1) "
    "SELECT num_id, n, round(r2, 6) AS r2, CAST(coalesce(r2 > 0.5, false) AS INTEGER) AS strong FROM m",
)
def person_r2(spark, sf):
    return inp.rounded(ev.person_r2(inp.panel_day(spark, sf), "purchase", "view"), ["r2"])


@query(
    "flatten_results",
    " UNION ALL ".join(f"SELECT l_returnflag AS dataset, l_linestatus AS model, '{m}' AS metric, round({e}, 6) AS score FROM lineitem GROUP BY 1, 2" for m, e in (("mean", "avg(l_quantity)"), ("sd", "stddev_samp(l_quantity)"))),
)
def flatten_results(spark, sf):
    wide = inp.line_numbers(spark, sf).groupBy(F.col("l_returnflag").alias("dataset"), F.col("l_linestatus").alias("model")).agg(
        F.avg("l_quantity").alias("mean"), F.stddev_samp("l_quantity").alias("sd")
    )
    return inp.rounded(ev.flatten_results(wide, ["dataset", "model"], ["mean", "sd"]), ["score"])


@query("attribution_summary")
def attribution_summary(spark, sf):
    rows = mo.cut_lineage(panel_rows(spark, sf))
    model = mo.forest().fit(mo.assemble(rows, inp.SENSORS, [F.col("purchase").alias("y")]))
    return attribution.attribution_summary(model, rows, inp.SENSORS, "cell_row")


@query("dt_by_cluster")
def dt_by_cluster(spark, sf):
    """The depth-two tree refitted inside each market segment."""
    seg = inp.table(spark, sf, "customer").select(F.col("c_custkey").alias("num_id"), "c_mktsegment")
    rows = mo.cut_lineage(split_rows(spark, sf, "purchase", grouped=False, folds=5).join(seg, "num_id"))
    out = None
    for name in [r[0] for r in rows.select("c_mktsegment").distinct().orderBy("c_mktsegment").collect()]:
        part = rows.filter(F.col("c_mktsegment") == name)
        tree = DecisionTreeRegressor(labelCol="y", maxDepth=2, minInstancesPerNode=2, seed=42)
        got = mo.fit_and_score(tree, part).withColumn("c_mktsegment", F.lit(name))
        out = got if out is None else out.unionByName(got)
    return out
