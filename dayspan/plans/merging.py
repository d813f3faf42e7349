"""Joins and set operations."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import functions as F

from dayspan.operators import merge, reduction
from dayspan.plans import inputs as inp
from dayspan.plans.base import query, r6


def _daily(spark, sf, kinds):
    """One table per event type: person, day and that type's mean; unique on (num_id, dt)."""
    e = inp.ev_raw(spark, sf)
    return [
        e.filter(F.col("event_type") == k).groupBy("num_id", "dt").agg(r6(F.avg(k)).alias(k)) for k in kinds
    ]


_PARTS = ", ".join(
    f"t_{k} AS (SELECT user_id AS num_id, CAST(ts AS DATE) AS dt, round(avg(value), 6) AS {k} FROM events WHERE event_type = '{k}' GROUP BY 1, 2)"
    for k in inp.FEATURES
)
_OUTER = " ".join(f"FULL JOIN t_{k} USING (num_id, dt)" for k in inp.FEATURES[1:])


@query(
    "outer_merge_shared",
    f"WITH {_PARTS}, d AS (SELECT c_custkey AS num_id, c_mktsegment FROM customer) "
    f"SELECT num_id, dt, {', '.join(inp.FEATURES)}, c_mktsegment FROM t_view {_OUTER} FULL JOIN d USING (num_id)",
)
def outer_merge_shared(spark, sf):
    d = inp.table(spark, sf, "customer").select(F.col("c_custkey").alias("num_id"), "c_mktsegment")
    return merge.merge_all([*_daily(spark, sf, inp.FEATURES), d])


@query(
    "outer_merge_union",
    f"WITH {_PARTS} SELECT num_id, dt, {', '.join(inp.FEATURES)} FROM t_view {_OUTER}",
)
def outer_merge_union(spark, sf):
    return merge.merge_all(_daily(spark, sf, inp.FEATURES), ["num_id", "dt"], unique=True)


@query(
    "merge_collisions",
    "SELECT column_name AS \"column\", table_a, table_b FROM (VALUES ('value', 'view', 'click'), ('value', 'view', 'error')) t(column_name, table_a, table_b) "
    "WHERE (SELECT count(*) FROM events) > 0",
)
def merge_collisions(spark, sf):
    e = inp.table(spark, sf, "events")
    tables = {k: e.filter(F.col("event_type") == k).select(F.col("user_id").alias("num_id"), "value") for k in ("view", "click", "error")}
    found = merge.collisions(tables, ["num_id"])
    rows = [F.struct(*[F.lit(v).alias(n) for v, n in zip(r, ("column", "table_a", "table_b"))]) for r in found]
    return e.agg(F.count(F.lit(1)).alias("n")).filter("n > 0").select(F.explode(F.array(*rows)).alias("r")).select("r.*")


@query(
    "left_join_dims",
    "SELECT DISTINCT o_custkey AS num_id, c_mktsegment, n_name, r_name FROM orders LEFT JOIN customer ON o_custkey = c_custkey "
    "LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey",
)
def left_join_dims(spark, sf):
    people = inp.table(spark, sf, "orders").select(F.col("o_custkey").alias("num_id")).distinct()
    c = inp.table(spark, sf, "customer").select(F.col("c_custkey").alias("num_id"), "c_mktsegment", F.col("c_nationkey").alias("n_nationkey"))
    n = inp.table(spark, sf, "nation").select("n_nationkey", "n_name", F.col("n_regionkey").alias("r_regionkey"))
    r = inp.table(spark, sf, "region").select("r_regionkey", "r_name")
    return merge.attach_dims(people, [(c, "num_id"), (n, "n_nationkey"), (r, "r_regionkey")]).select("num_id", "c_mktsegment", "n_name", "r_name")


@query(
    "pseudonymise",
    "WITH k AS (SELECT DISTINCT c_name AS participant_id, c_custkey AS num_id FROM customer), "
    "s AS (SELECT c_name AS participant_id, c_mktsegment FROM customer WHERE c_acctbal > 0) "
    "SELECT c_mktsegment, num_id FROM s FULL JOIN k USING (participant_id)",
)
def pseudonymise(spark, sf):
    c = inp.table(spark, sf, "customer")
    key = c.select(F.col("c_name").alias("participant_id"), F.col("c_custkey").alias("num_id")).distinct()
    survey = c.filter("c_acctbal > 0").select(F.col("c_name").alias("participant_id"), "c_mktsegment")
    return merge.pseudonymise(survey, key, "participant_id")


def _labels(spark, sf):
    return inp.table(spark, sf, "customer").filter("c_acctbal > 0").select(
        F.col("c_custkey").alias("num_id"), F.col("c_nationkey").alias("cluster"), "c_mktsegment"
    )


_LAB = "lab AS (SELECT c_custkey AS num_id, c_nationkey AS cluster FROM customer WHERE c_acctbal > 0)"


@query(
    "attach_labels_inner",
    f"WITH {inp.SQL_DAY}, {_LAB} SELECT num_id, dt, cluster, round(view, 6) AS view FROM panel JOIN lab USING (num_id)",
)
def attach_labels_inner(spark, sf):
    p = inp.rounded(inp.panel_day(spark, sf).select("num_id", "dt", "view"), ["view"])
    return merge.attach_columns(p, _labels(spark, sf), ["num_id"], ["cluster"], "inner")


@query(
    "attach_labels_left",
    f"WITH {inp.SQL_DAY}, {_LAB} SELECT num_id, dt, cluster, round(view, 6) AS view FROM panel LEFT JOIN lab USING (num_id)",
)
def attach_labels_left(spark, sf):
    p = inp.rounded(inp.panel_day(spark, sf).select("num_id", "dt", "view"), ["view"])
    return merge.attach_columns(p, _labels(spark, sf), ["num_id"], ["cluster"])


@query(
    "merge_pcs",
    f"WITH {inp.SQL_WEEKS}, s AS (SELECT num_id, day, (view - click) / 2 AS c0_PC1, (signup + error) / 2 AS c1_PC1 FROM pw WHERE view IS NOT NULL AND click IS NOT NULL) "
    "SELECT pw.num_id, pw.day, round(c0_PC1, 6) AS pc_contrast, round(c1_PC1, 6) AS pc_level FROM pw JOIN s ON s.num_id = pw.num_id AND s.day = pw.day",
)
def merge_pcs(spark, sf):
    p = inp.panel_weeks(spark, sf)
    scores = clean_scores(p)
    out = reduction.merge_scores(p.select("num_id", "day"), scores, ["num_id", "day"], {"c0_PC1": "pc_contrast", "c1_PC1": "pc_level"})
    return inp.rounded(out, ["pc_contrast", "pc_level"])


def clean_scores(p):
    return p.na.drop("any", subset=["view", "click"]).select(
        "num_id", "day", ((F.col("view") - F.col("click")) / 2).alias("c0_PC1"), ((F.col("signup") + F.col("error")) / 2).alias("c1_PC1")
    )


@query(
    "semi_keep_ids",
    f"WITH {inp.SQL_DAY} SELECT num_id, dt FROM panel WHERE num_id IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)",
)
def semi_keep_ids(spark, sf):
    return merge.keep_ids(inp.panel_day(spark, sf), _labels(spark, sf), "num_id").select("num_id", "dt")


_PAIRS = list(combinations(inp.FEATURES, 2))


@query(
    "pair_join",
    f"WITH {inp.SQL_MEANS} "
    + " UNION ALL ".join(
        f"SELECT num_id, '{a}' AS var_i, '{b}' AS var_j, round({a}, 6) AS mean_i, round({b}, 6) AS mean_j FROM means" for a, b in _PAIRS
    ),
)
def pair_join(spark, sf):
    """Pairs i<j of variables per person. Variables are columns, so the pairs are an array, not a join."""
    m = inp.rounded(inp.person_means(spark, sf), inp.FEATURES)
    pairs = F.array(
        *[
            F.struct(F.lit(a).alias("var_i"), F.lit(b).alias("var_j"), F.col(a).alias("mean_i"), F.col(b).alias("mean_j"))
            for a, b in _PAIRS
        ]
    )
    return m.select("num_id", F.explode(pairs).alias("p")).select("num_id", "p.*")


@query(
    "union_by_name",
    "SELECT user_id AS num_id, value, NULL AS props FROM events WHERE event_type = 'view' UNION ALL SELECT user_id, NULL, props FROM events WHERE event_type = 'click'",
)
def union_by_name(spark, sf):
    e = inp.table(spark, sf, "events").withColumnRenamed("user_id", "num_id")
    a = e.filter("event_type = 'view'").select("num_id", "value")
    b = e.filter("event_type = 'click'").select("num_id", "props")
    return a.unionByName(b, allowMissingColumns=True)


@query(
    "join_xy",
    f"WITH {inp.SQL_DAY} SELECT num_id, dt, round(view, 6) AS view, round(click, 6) AS click, round(purchase, 6) AS purchase FROM panel WHERE purchase IS NOT NULL",
)
def join_xy(spark, sf):
    p = inp.rounded(inp.panel_day(spark, sf), inp.FEATURES)
    x = p.select("num_id", "dt", "view", "click")
    y = p.filter(F.col("purchase").isNotNull()).select("num_id", "dt", "purchase")
    return x.join(y, ["num_id", "dt"])


@query("distinct_rows", "SELECT DISTINCT o_custkey, o_orderstatus, o_orderpriority FROM orders")
def distinct_rows(spark, sf):
    return inp.table(spark, sf, "orders").select("o_custkey", "o_orderstatus", "o_orderpriority").distinct()


@query(
    "split_overlap",
    "WITH a AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderstatus = 'F'), b AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderstatus = 'O'), "
    "c AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderstatus = 'P') "
    "SELECT 'f' AS set_a, 'o' AS set_b, (SELECT count(*) FROM a JOIN b USING (k)) AS shared UNION ALL "
    "SELECT 'f', 'p', (SELECT count(*) FROM a JOIN c USING (k)) UNION ALL SELECT 'o', 'p', (SELECT count(*) FROM b JOIN c USING (k))",
)
def split_overlap(spark, sf):
    o = inp.table(spark, sf, "orders")
    return merge.overlap({s.lower(): o.filter(F.col("o_orderstatus") == s) for s in "FOP"}, "o_custkey")
