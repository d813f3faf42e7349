"""Correlation structure, feature selection and reduction."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import functions as F

from dayspan.operators import aggregate as ag
from dayspan.operators import clean
from dayspan.operators import correlation as co
from dayspan.operators import reduction, selection
from dayspan.plans import inputs as inp
from dayspan.plans.base import query, r6
from dayspan.session import cut_lineage

_PAIRS = list(combinations(inp.FEATURES, 2))


def _union(pairs, expr, source, by=""):
    group = f" GROUP BY {by}" if by else ""
    head = f"{by}, " if by else ""
    return " UNION ALL ".join(
        f"SELECT {head}'{a}' AS var_i, '{b}' AS var_j, {expr.format(a=a, b=b)} FROM {source}{group}" for a, b in pairs
    )


_R = "round(CASE WHEN isnan(corr({a}, {b})) THEN NULL ELSE corr({a}, {b}) END, 6) AS r"


@query("corr_matrix", f"WITH {inp.SQL_DAY} " + _union(_PAIRS, _R, "panel"))
def corr_matrix(spark, sf):
    return inp.rounded(co.corr_matrix(inp.panel_day(spark, sf), inp.FEATURES), ["r"])


# Correlations inside a person over the densified, zero-filled days (all persons vary there).
def _filled(spark, sf):
    return inp.panel_full(spark, sf).select("num_id", "day", *[F.coalesce(c, F.lit(0.0)).alias(c) for c in inp.FEATURES])


_FILLED = f"{inp.SQL_FULL}, z AS (SELECT num_id, day, " + ", ".join(f"coalesce({c}, 0) AS {c}" for c in inp.FEATURES) + " FROM pf)"
_VARIES = "alive AS (SELECT num_id FROM z GROUP BY 1 HAVING " + " OR ".join(f"min({c}) < max({c})" for c in inp.FEATURES) + ")"
_C0 = "CASE WHEN coalesce(var_pop({a}), 0) * coalesce(var_pop({b}), 0) = 0 THEN 0 ELSE corr({a}, {b}) END"
_PC = f"{_FILLED}, {_VARIES}, pc AS (" + _union(_PAIRS, _C0 + " AS r", "(SELECT * FROM z WHERE num_id IN (SELECT num_id FROM alive))", "num_id") + ")"


@query("person_corr", f"WITH {_PC} SELECT num_id, var_i, var_j, round(r, 6) AS r FROM pc")
def person_corr(spark, sf):
    return inp.rounded(co.person_corr(_filled(spark, sf), inp.FEATURES), ["r"])


@query(
    "upper_triangle",
    f"WITH {_PC} SELECT num_id, " + ", ".join(
        f"round(max(CASE WHEN var_i = '{a}' AND var_j = '{b}' THEN r END), 6) AS v{i}" for i, (a, b) in enumerate(_PAIRS)
    ) + " FROM pc GROUP BY 1",
)
def upper_triangle(spark, sf):
    v = co.upper_triangle(co.person_corr(_filled(spark, sf), inp.FEATURES), inp.FEATURES)
    return v.select("num_id", *[r6(F.col("vector")[i]).alias(f"v{i}") for i in range(len(_PAIRS))])


@query("mean_corr_distance", f"WITH {_PC} SELECT var_i, var_j, round(1 - avg(r), 6) AS d FROM pc GROUP BY 1, 2")
def mean_corr_distance(spark, sf):
    return inp.rounded(co.mean_distance(co.person_corr(_filled(spark, sf), inp.FEATURES)), ["d"])


_COMPLETE = "cw AS (SELECT num_id, " + ", ".join(f"avg({c}) AS {c}" for c in inp.FEATURES) + " FROM wk WHERE " + " AND ".join(f"{c} IS NOT NULL" for c in inp.FEATURES) + " GROUP BY 1)"
_WEEKLY = f"{inp.SQL_WEEKS}, wk AS (SELECT num_id, week, " + ", ".join(f"avg({c}) AS {c}" for c in inp.FEATURES) + " FROM pw GROUP BY 1, 2)"


def weekly(spark, sf):
    return ag.weekly_panel(inp.panel_weeks(spark, sf), inp.FEATURES)


@query("person_mean_corr_distance", f"WITH {_WEEKLY}, {_COMPLETE} " + _union(_PAIRS, "round(1 - corr({a}, {b}), 6) AS d", "cw"))
def person_mean_corr_distance(spark, sf):
    return inp.rounded(co.person_mean_distance(weekly(spark, sf), inp.FEATURES), ["d"])


@query(
    "corr_edges",
    f"WITH {_PC}, e AS (SELECT num_id, var_i AS node_a, var_j AS node_b, r * 5 AS weight, CASE WHEN r < 0 THEN -1 ELSE 1 END AS sign FROM pc WHERE abs(r) > 0.3) "
    "SELECT num_id, node_a, node_b, round(weight, 6) AS weight, sign, round(CASE WHEN max(weight) OVER w = min(weight) OVER w THEN 5 "
    "ELSE (weight - min(weight) OVER w) / (max(weight) OVER w - min(weight) OVER w) * 9 + 1 END, 6) AS width FROM e WINDOW w AS (PARTITION BY num_id)",
)
def corr_edges(spark, sf):
    long = co.person_corr(_filled(spark, sf), inp.FEATURES)
    return inp.rounded(co.corr_edges(long, 0.3, scale=True, by=["num_id"]), ["weight", "width"])


@query(
    "variance_filter",
    " UNION ALL ".join(f"SELECT '{c}' AS variable, round(var_pop({c}), 6) AS variance, CAST(var_pop({c}) > 0.005 AS INTEGER) AS keep FROM lineitem" for c in inp.LINE),
)
def variance_filter(spark, sf):
    return inp.rounded(selection.variances(inp.line_numbers(spark, sf), inp.LINE), ["variance"])


_PR = ("quantity", "price", "unit", "discount", "net")
_LI = (
    "li AS (SELECT l_quantity AS quantity, l_extendedprice AS price, l_extendedprice / l_quantity AS unit, l_discount AS discount, "
    "l_extendedprice * (1 - l_discount) AS net, l_tax AS tax FROM lineitem)"
)
_PRP = list(combinations(_PR, 2))


def _lines(spark, sf):
    li = inp.line_numbers(spark, sf)
    q, p, d = F.col("l_quantity"), F.col("l_extendedprice"), F.col("l_discount")
    return li.select(q.alias("quantity"), p.alias("price"), (p / q).alias("unit"), d.alias("discount"), (p * (1 - d)).alias("net"), F.col("l_tax").alias("tax"))


@query(
    "prune_collinear",
    f"WITH {_LI}, c AS ({_union(_PRP, 'abs(corr({a}, {b})) AS r', 'li')}), s AS (SELECT * FROM c UNION ALL SELECT var_j, var_i, r FROM c), "
    "t AS (" + " UNION ALL ".join(f"SELECT '{c}' AS v, abs(corr({c}, tax)) AS t FROM li" for c in _PR) + ") "
    "SELECT DISTINCT CASE WHEN a.t >= b.t THEN var_j ELSE var_i END AS variable FROM s JOIN t a ON a.v = var_i JOIN t b ON b.v = var_j WHERE r > 0.9",
)
def prune_collinear(spark, sf):
    return selection.collinear_drops(_lines(spark, sf), "tax", _PR, 0.9)


@query("target_corr", f"WITH {_LI} " + " UNION ALL ".join(f"SELECT '{c}' AS variable, round(corr({c}, price), 6) AS r FROM li" for c in ("quantity", "unit", "discount", "net", "tax")))
def target_corr(spark, sf):
    return inp.rounded(co.target_corr(_lines(spark, sf), "price", ["quantity", "unit", "discount", "net", "tax"]), ["r"])


@query("stability_select")
def stability_select(spark, sf):
    d = inp.table(spark, sf, "documents").select("doc_id", "n_chars", F.size(F.split("text", " ")).alias("n_words"), F.size(F.split("text", "\n")).alias("n_lines"))
    lab = inp.table(spark, sf, "labels").select("doc_id", "toxic", "quality")
    from dayspan.operators.transform import zscore

    cols = ["n_chars", "n_words", "n_lines", "toxic"]
    xy = cut_lineage(d.join(lab, "doc_id").select("doc_id", "quality", *[F.col(c).cast("double").alias(c) for c in cols]))  # the texts are read once
    xy = zscore(xy, cols)
    return selection.stability_select(xy, "quality", cols, ["doc_id"])


_CL = {"view": 0, "click": 0, "signup": 1, "error": 1}


def _pc_sql(a: str, b: str, name: str) -> str:
    """First component of two variables in closed form, sign by the larger loading."""
    return (
        f"m{name} AS (SELECT avg({a}) AS ma, avg({b}) AS mb, var_samp({a}) AS aa, var_samp({b}) AS bb, covar_samp({a}, {b}) AS ab FROM cc), "
        f"l{name} AS (SELECT *, (aa + bb + sqrt((aa - bb) ** 2 + 4 * ab * ab)) / 2 AS lam FROM m{name}), "
        f"u{name} AS (SELECT *, CASE WHEN aa >= bb THEN lam - bb ELSE ab END AS x, CASE WHEN aa >= bb THEN ab ELSE lam - aa END AS y FROM l{name}), "
        f"v{name} AS (SELECT *, sqrt(x * x + y * y) * CASE WHEN abs(x) >= abs(y) THEN sign(x) ELSE sign(y) END AS nrm FROM u{name})"
    )


@query(
    "pca_by_cluster",
    f"WITH {_WEEKLY}, cc AS (SELECT num_id, week, view, click, signup, error FROM wk WHERE view IS NOT NULL AND click IS NOT NULL AND signup IS NOT NULL AND error IS NOT NULL), "
    f"{_pc_sql('view', 'click', '0')}, {_pc_sql('signup', 'error', '1')} SELECT num_id, week, "
    "round(((view - v0.ma) * v0.x + (click - v0.mb) * v0.y) / v0.nrm, 6) AS c0_PC1, round(((signup - v1.ma) * v1.x + (error - v1.mb) * v1.y) / v1.nrm, 6) AS c1_PC1 FROM cc, v0, v1",
)
def pca_by_cluster(spark, sf):
    p = weekly(spark, sf).select("num_id", "week", *inp.SENSORS)
    scores, _ = reduction.pca_by_cluster(p, _CL, ["num_id", "week"])
    return inp.rounded(scores, ["c0_PC1", "c1_PC1"])


def _model_sql(i: int, a: str, b: str) -> str:
    rows = [
        f"SELECT {i} AS cluster, 'PC1' AS component, '{v}' AS variable, round({x} / nrm, 6) AS loading, round({m}, 6) AS mean, round(lam / (aa + bb), 6) AS explained FROM v{i}"
        for v, x, m in ((a, "x", "ma"), (b, "y", "mb"))
    ]
    return " UNION ALL ".join(rows)


@query(
    "pca_model",
    f"WITH {_WEEKLY}, cc AS (SELECT num_id, week, view, click, signup, error FROM wk WHERE view IS NOT NULL AND click IS NOT NULL AND signup IS NOT NULL AND error IS NOT NULL), "
    f"{_pc_sql('view', 'click', '0')}, {_pc_sql('signup', 'error', '1')} {_model_sql(0, 'view', 'click')} UNION ALL {_model_sql(1, 'signup', 'error')}",
)
def pca_model(spark, sf):
    p = weekly(spark, sf).select("num_id", "week", *inp.SENSORS)
    return inp.rounded(reduction.pca_by_cluster(p, _CL, ["num_id", "week"])[1], ["loading", "mean", "explained"])


def _leading_sql(name: str, matrix: str, squarings: int = 26) -> str:
    """Leading eigenvector of a matrix (i, j, v): squared again and again it becomes the outer product of it."""
    steps = [f"{name}0 AS MATERIALIZED (SELECT i, j, v / (SELECT sum(v) FROM {matrix} WHERE i = j) AS v FROM {matrix})"]
    for k in range(squarings):
        steps.append(
            f"{name}s{k} AS MATERIALIZED (SELECT a.i, b.j, sum(a.v * b.v) AS v FROM {name}{k} a JOIN {name}{k} b ON a.j = b.i GROUP BY 1, 2), "
            f"{name}{k + 1} AS MATERIALIZED (SELECT i, j, v / (SELECT sum(v) FROM {name}s{k} WHERE i = j) AS v FROM {name}s{k})"
        )
    last = f"{name}{squarings}"
    steps.append(
        f"{name}u AS (SELECT i, v FROM {last} WHERE j = (SELECT arg_max(i, v) FROM {last} WHERE i = j)), "
        f"{name} AS MATERIALIZED (SELECT i, v / (SELECT sqrt(sum(v * v)) FROM {name}u) * (SELECT sign(arg_max(v, abs(v))) FROM {name}u) AS v FROM {name}u)"
    )
    return ", ".join(steps)


@query(
    "pca2_projection",
    f"WITH lng AS (SELECT vec_id, label, unnest(range(1, {inp.WIDTH + 1})) AS i, unnest(embedding)::DOUBLE AS x FROM embeddings), mu AS (SELECT i, avg(x) AS m FROM lng GROUP BY i), "
    "cen AS MATERIALIZED (SELECT vec_id, label, i, x - m AS x FROM lng JOIN mu USING (i)), cov AS MATERIALIZED (SELECT a.i, b.i AS j, sum(a.x * b.x) AS v FROM cen a JOIN cen b USING (vec_id) GROUP BY 1, 2), "
    f"{_leading_sql('e', 'cov')}, lam AS (SELECT sum(a.v * c.v * b.v) AS l FROM cov c JOIN e a ON c.i = a.i JOIN e b ON c.j = b.i), "
    "rest AS MATERIALIZED (SELECT c.i, c.j, c.v - (SELECT l FROM lam) * a.v * b.v AS v FROM cov c JOIN e a ON c.i = a.i JOIN e b ON c.j = b.i), "
    f"{_leading_sql('f', 'rest')} SELECT vec_id, CAST(label AS BIGINT) AS label, round(sum(x * e.v), 5) AS PC1, round(sum(x * f.v), 5) AS PC2 FROM cen JOIN e USING (i) JOIN f USING (i) GROUP BY 1, 2",
)
def pca2_projection(spark, sf):
    out = reduction.project(inp.vectors(spark, sf), [f"x{i}" for i in range(1, inp.WIDTH + 1)], ["vec_id", "label"], 2)
    return out.select("vec_id", "label", *[F.round(F.col(c) + 1e-9, 5).alias(c) for c in ("PC1", "PC2")])


@query("keep_from_group", f"WITH {inp.SQL_DAY} SELECT num_id, dt, round(click, 6) AS click, round(purchase, 6) AS purchase FROM panel")
def keep_from_group(spark, sf):
    p = clean.keep_from_group(inp.panel_day(spark, sf), inp.SENSORS, ["click"])
    return inp.rounded(p, ["click", "purchase"])


@query(
    "pc_corr",
    f"WITH {inp.SQL_WEEKS}, s AS (SELECT (view - click) / 2 AS a, (signup + error) / 2 AS b, (view + click) / 2 AS c FROM (SELECT num_id, week, avg(view) AS view, avg(click) AS click, avg(signup) AS signup, avg(error) AS error FROM pw GROUP BY 1, 2)) "
    "SELECT 'pc_a' AS var_i, 'pc_b' AS var_j, round(corr(a, b), 6) AS r FROM s UNION ALL SELECT 'pc_a', 'pc_c', round(corr(a, c), 6) FROM s UNION ALL SELECT 'pc_b', 'pc_c', round(corr(b, c), 6) FROM s",
)
def pc_corr(spark, sf):
    w = weekly(spark, sf)
    v, c, s, e = (F.col(x) for x in inp.SENSORS)
    pcs = w.select(((v - c) / 2).alias("pc_a"), ((s + e) / 2).alias("pc_b"), ((v + c) / 2).alias("pc_c"))
    return inp.rounded(co.corr_matrix(pcs, [x for x in pcs.columns if x.startswith("pc_")]), ["r"])


@query(
    "skew_kurtosis",
    " UNION ALL ".join(
        f"SELECT '{c}' AS variable, n, round(m3 / m2 ** 1.5, 6) AS skew, round(m4 / (m2 * m2) - 3, 6) AS kurtosis, round(m3 / m2 ** 1.5 * sqrt(CAST(n AS DOUBLE) * (n - 1)) / (n - 2), 6) AS skew_adjusted "
        f"FROM (SELECT count({c}) AS n, avg(({c} - m) ** 2) AS m2, avg(({c} - m) ** 3) AS m3, avg(({c} - m) ** 4) AS m4 FROM lineitem, (SELECT avg({c}) AS m FROM lineitem))"
        for c in inp.LINE
    ),
)
def skew_kurtosis(spark, sf):
    return inp.rounded(co.shape_stats(inp.line_numbers(spark, sf), inp.LINE), ["skew", "kurtosis", "skew_adjusted"])
