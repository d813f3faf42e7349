"""Distances, embeddings and clusterings."""

from __future__ import annotations

from pyspark.sql import functions as F

from dayspan.operators import aggregate as ag
from dayspan.operators import clustering as cl
from dayspan.operators import correlation as co
from dayspan.operators import distance as di
from dayspan.operators import encode, merge
from dayspan.plans import inputs as inp
from dayspan.plans.base import query
from dayspan.plans.structure import _PC, _filled
from dayspan.session import cut_lineage

WEEKS = (0, 1, 2, 3, 4)
W = [f"w{w}" for w in WEEKS]
# Activity per week: number of recorded events, complete for most persons.
_SERIES = (
    "e AS (SELECT user_id AS num_id, CAST(ts AS DATE) AS dt FROM events), f AS (SELECT num_id, dt, floor(date_diff('day', min(dt) OVER (PARTITION BY num_id), dt) / 7) AS week FROM e), "
    "s AS (SELECT num_id, " + ", ".join(f"CAST(nullif(count(*) FILTER (week = {w}), 0) AS DOUBLE) AS w{w}" for w in WEEKS) + " FROM f GROUP BY 1), "
    "v AS (SELECT min(num_id) AS id, count(*) AS copies, " + ", ".join(W) + " FROM s WHERE " + " AND ".join(f"{w} IS NOT NULL" for w in W) + f" GROUP BY {', '.join(W)})"
)

_PERSONS = f"{_SERIES}, p AS (SELECT num_id AS id, {', '.join(W)} FROM s WHERE " + " AND ".join(f"{w} IS NOT NULL" for w in W) + ")"


def series(spark, sf):
    """Person by week event counts; a week without events is missing."""
    from dayspan.operators import timeline as tl

    days = inp.table(spark, sf, "events").groupBy(F.col("user_id").alias("num_id"), F.to_date("ts").alias("dt")).agg(F.count(F.lit(1)).alias("n"))
    weekly = tl.assign_week(days)
    return weekly.groupBy("num_id").agg(
        *[F.sum(F.when(F.col("week") == w, F.col("n"))).cast("double").alias(f"w{w}") for w in WEEKS]
    )


_SQ = " + ".join(f"(a.{w} - b.{w}) ** 2" for w in W)
EPS = 4.0
LAST = f"c{len(W) - 1}{len(W) - 1}"  # the last cell of the warping table


@query("pair_euclid", f"WITH {_PERSONS} SELECT a.id AS id_a, b.id AS id_b, round(sqrt({_SQ}), 6) AS d FROM p a JOIN p b ON a.id < b.id WHERE sqrt({_SQ}) <= {EPS}")
def pair_euclid(spark, sf):
    return inp.rounded(di.person_pairs(series(spark, sf), "num_id", W, EPS), ["d"])


def _dtw_sql(series: str = "v") -> str:
    cells, n = [], len(W)
    for i in range(n):
        for j in range(n):
            cost = f"abs(a.w{i} - b.w{j})"
            before = [f"c{x}{y}" for x, y in ((i - 1, j), (i, j - 1), (i - 1, j - 1)) if x >= 0 and y >= 0]
            cells.append(f"{cost}{' + least(' + ', '.join(before) + ')' if before else ''} AS c{i}{j}")
    return f"SELECT a.id AS id_a, b.id AS id_b, {', '.join(cells)} FROM {series} a JOIN {series} b ON a.id < b.id"


@query("pair_dtw", f"WITH {_PERSONS}, t AS ({_dtw_sql('p')}) SELECT id_a, id_b, round({LAST}, 6) AS d FROM t WHERE {LAST} <= {EPS}")
def pair_dtw(spark, sf):
    return inp.rounded(di.person_pairs(series(spark, sf), "num_id", W, EPS, "dtw"), ["d"])


@query("copy_members", f"WITH {_SERIES} SELECT s.num_id, v.id FROM s JOIN v USING ({', '.join(W)})")
def copy_members(spark, sf):
    return di.copy_members(series(spark, sf), "num_id", W).withColumnRenamed("rep", "id")


@query("mds_embed")
def mds_embed(spark, sf):
    return di.landmark_mds(series(spark, sf), "num_id", W)


@query("mds_stress")
def mds_stress(spark, sf):
    s = cut_lineage(series(spark, sf))  # placed first, then measured
    return di.landmark_stress(s, di.landmark_mds(s, "num_id", W), "num_id", W)


@query("kmeans_sweep")
def kmeans_sweep(spark, sf):
    return cl.kmeans_sweep(inp.vectors(spark, sf), [f"x{i}" for i in range(1, inp.WIDTH + 1)], range(2, 200))


_X = [f"x{i}" for i in range(1, inp.WIDTH + 1)]
_VSQ = " + ".join(f"(a.{x} - b.{x}) ** 2" for x in _X)
_CEN = ", ".join(f"avg({x}) AS {x}" for x in _X)
_SIL = (
    f"s1 AS (SELECT a.vec_id, a.label AS own, b.label AS other, sum({_VSQ}) AS t, count(*) AS n FROM vec a JOIN vec b ON true GROUP BY 1, 2, 3), "
    "s2 AS (SELECT vec_id, max(CASE WHEN own = other THEN t / nullif(n - 1, 0) END) AS a, min(CASE WHEN own <> other THEN t / n END) AS b FROM s1 GROUP BY 1), "
    "sil AS (SELECT avg(CASE WHEN a IS NULL OR greatest(a, b) = 0 THEN 0 ELSE (b - a) / greatest(a, b) END) AS silhouette FROM s2)"
)
_DB = (
    f"cen AS (SELECT label, {_CEN} FROM vec GROUP BY 1), sp AS (SELECT a.label, avg(sqrt({_VSQ})) AS s FROM vec a JOIN cen b ON a.label = b.label GROUP BY 1), "
    f"rat AS (SELECT a.label, max((p.s + q.s) / sqrt({_VSQ})) AS m FROM cen a JOIN cen b ON a.label <> b.label JOIN sp p ON p.label = a.label JOIN sp q ON q.label = b.label GROUP BY 1), "
    "dbi AS (SELECT avg(m) AS davies_bouldin FROM rat)"
)


@query("silhouette", f"WITH {inp.SQL_VEC}, {_SIL} SELECT round(silhouette, 6) AS silhouette FROM sil")
def silhouette(spark, sf):
    value = cl.silhouette(inp.vectors(spark, sf), "label", _X)
    return inp.rounded(spark.createDataFrame([(value,)], "silhouette double"), ["silhouette"])


@query("davies_bouldin", f"WITH {inp.SQL_VEC}, {_DB} SELECT round(davies_bouldin, 6) AS davies_bouldin FROM dbi")
def davies_bouldin(spark, sf):
    value = cl.davies_bouldin(inp.vectors(spark, sf), "label", _X)
    return inp.rounded(spark.createDataFrame([(value,)], "davies_bouldin double"), ["davies_bouldin"])


EPS_SWEEP = (2.0, 4.0, 8.0)
_HEAD = f"WITH RECURSIVE {_SERIES}, t AS ({_dtw_sql()})"


def _density(eps: float) -> str:
    """Labels of all persons at one radius: neighbours, core points, reachable core points, borders."""
    return (
        f"near AS (SELECT id_a AS p, id_b AS q FROM t WHERE {LAST} <= {eps} UNION ALL SELECT id_b, id_a FROM t WHERE {LAST} <= {eps}), "
        "core AS (SELECT v.id FROM v LEFT JOIN (SELECT p, sum(w.copies) AS m FROM near JOIN v w ON w.id = q GROUP BY 1) n ON n.p = v.id WHERE v.copies + coalesce(m, 0) >= 10), "
        "link AS (SELECT p, q FROM near WHERE p IN (FROM core) AND q IN (FROM core)), "
        "walk AS (SELECT id, id AS root FROM core UNION SELECT link.q, walk.root FROM walk JOIN link ON link.p = walk.id), "
        "comp AS (SELECT id, min(root) AS c FROM walk GROUP BY 1), "
        "lab AS (SELECT v.id, coalesce(comp.c, (SELECT min(k.c) FROM near JOIN comp k ON k.id = near.q WHERE near.p = v.id), -1) AS c FROM v LEFT JOIN comp ON comp.id = v.id), "
        f"person AS (SELECT s.*, lab.c AS cluster FROM s JOIN v USING ({', '.join(W)}) JOIN lab ON lab.id = v.id)"
    )


def _density_row(eps: float) -> str:
    pairs = f"s1 AS (SELECT a.num_id, a.cluster AS own, b.cluster AS other, sum({_SQ}) AS t, count(*) AS n FROM person a JOIN person b ON a.cluster >= 0 AND b.cluster >= 0 GROUP BY 1, 2, 3)"
    score = "s2 AS (SELECT num_id, max(CASE WHEN own = other THEN t / nullif(n - 1, 0) END) AS a, min(CASE WHEN own <> other THEN t / n END) AS b FROM s1 GROUP BY 1)"
    return (
        f"SELECT * FROM ({_HEAD}, {_density(eps)}, {pairs}, {score} SELECT CAST({eps} AS DOUBLE) AS eps, "
        "(SELECT count(DISTINCT cluster) FROM person WHERE cluster >= 0) AS clusters, (SELECT round(avg(CAST(cluster < 0 AS INTEGER)), 6) FROM person) AS noise_ratio, "
        "CASE WHEN (SELECT count(DISTINCT cluster) FROM person WHERE cluster >= 0) > 1 THEN (SELECT round(avg(CASE WHEN a IS NULL OR greatest(a, b) = 0 THEN 0 ELSE (b - a) / greatest(a, b) END), 6) FROM s2) ELSE 0.0 END AS silhouette)"
    )


@query("dbscan", " UNION ALL ".join(_density_row(e) for e in EPS_SWEEP))
def dbscan(spark, sf):
    sweep = cl.dbscan_sweep(series(spark, sf), "num_id", W, EPS_SWEEP, 10)
    return inp.rounded(sweep, ["noise_ratio", "silhouette"])


@query("dbscan_labels", f"{_HEAD}, {_density(EPS)} SELECT num_id, cluster FROM person")
def dbscan_labels(spark, sf):
    return cl.dbscan(series(spark, sf), "num_id", W, EPS, 10)


def variable_distances(spark, sf):
    long = co.person_corr(_filled(spark, sf), inp.FEATURES, diagonal=True)
    return co.mean_distance(long)


def _rows_sql() -> str:
    """Rows of the mean distance matrix, its diagonal included: (a, b, v) by place of the variables."""
    n = len(inp.FEATURES)
    off = " UNION ALL ".join(
        f"SELECT {i} AS a, {j} AS b, 1 - avg(r) AS v FROM pc WHERE var_i = '{inp.FEATURES[i]}' AND var_j = '{inp.FEATURES[j]}'" for i in range(n) for j in range(i + 1, n)
    )
    own = " UNION ALL ".join(f"SELECT {i} AS a, {i} AS b, 1 - avg(CASE WHEN lo < hi THEN 1.0 ELSE 0.0 END) AS v FROM (SELECT num_id, min({c}) AS lo, max({c}) AS hi FROM z WHERE num_id IN (SELECT num_id FROM alive) GROUP BY 1)" for i, c in enumerate(inp.FEATURES))
    return f"{_PC}, off AS ({off}), m AS MATERIALIZED (SELECT a, b, v FROM off UNION ALL SELECT b, a, v FROM off UNION ALL {own})"


def _average_steps(merges: int) -> str:
    """Cluster of each variable after each merge of the two with the least mean distance; a cluster is named by its first member."""
    steps = ["gap AS MATERIALIZED (SELECT x.a AS i, y.a AS j, sqrt(sum((x.v - y.v) ** 2)) AS d FROM m x JOIN m y ON x.b = y.b GROUP BY 1, 2)", "c0 AS (SELECT DISTINCT a AS item, a AS c FROM m)"]
    for k in range(merges):
        steps.append(
            f"w{k} AS MATERIALIZED (SELECT x.c AS i, y.c AS j, avg(d) AS d FROM gap JOIN c{k} x ON x.item = gap.i JOIN c{k} y ON y.item = gap.j WHERE x.c < y.c GROUP BY 1, 2 ORDER BY 3, 1, 2 LIMIT 1), "
            f"c{k + 1} AS MATERIALIZED (SELECT item, CASE WHEN c = (SELECT j FROM w{k}) THEN (SELECT i FROM w{k}) ELSE c END AS c FROM c{k})"
        )
    return ", ".join(steps)


def _ward_steps() -> str:
    """All merges by the growth of squared distances to the centroids; ``node`` numbers merged clusters after the variables."""
    n = len(inp.FEATURES)
    steps = ["c0 AS (SELECT DISTINCT a AS item, a AS c, a AS node FROM m)"]
    for k in range(n - 1):
        steps.append(
            f"n{k} AS MATERIALIZED (SELECT c, any_value(node) AS node, count(*) AS n FROM c{k} GROUP BY c), "
            f"g{k} AS MATERIALIZED (SELECT c, b, avg(v) AS v FROM c{k} JOIN m ON m.a = c{k}.item GROUP BY 1, 2), "
            f"w{k} AS MATERIALIZED (SELECT p.c AS i, q.c AS j, any_value(p.node) AS a, any_value(q.node) AS b, any_value(p.n + q.n) AS size, "
            f"sqrt(any_value(2.0 * p.n * q.n / (p.n + q.n)) * sum((x.v - y.v) ** 2)) AS d FROM n{k} p JOIN n{k} q ON p.c < q.c JOIN g{k} x ON x.c = p.c JOIN g{k} y ON y.c = q.c AND x.b = y.b GROUP BY 1, 2 ORDER BY d, 1, 2 LIMIT 1), "
            f"c{k + 1} AS MATERIALIZED (SELECT item, CASE WHEN c = (SELECT j FROM w{k}) THEN (SELECT i FROM w{k}) ELSE c END AS c, "
            f"CASE WHEN c IN (SELECT i FROM w{k} UNION ALL SELECT j FROM w{k}) THEN {n + k} ELSE node END AS node FROM c{k})"
        )
    return ", ".join(steps)


_NAMED = "CASE item " + " ".join(f"WHEN {i} THEN '{c}'" for i, c in enumerate(inp.FEATURES)) + " END"


@query("cluster_variables", f"WITH {_rows_sql()}, {_average_steps(len(inp.FEATURES) - 3)} SELECT {_NAMED} AS variable, dense_rank() OVER (ORDER BY c) - 1 AS cluster FROM c{len(inp.FEATURES) - 3}")
def cluster_variables(spark, sf):
    return cl.cluster_variables(variable_distances(spark, sf), inp.FEATURES, 3, "average")[0]


@query(
    "variable_merge_tree",
    f"WITH {_rows_sql()}, {_ward_steps()} " + " UNION ALL ".join(f"SELECT {k} AS step, a AS item_a, b AS item_b, round(d, 6) AS height, size FROM w{k}" for k in range(len(inp.FEATURES) - 1)),
)
def variable_merge_tree(spark, sf):
    return inp.rounded(cl.cluster_variables(variable_distances(spark, sf), inp.FEATURES, 3, "ward")[1], ["height"])


_MERGED = f"c{len(inp.FEATURES) - 3}"


@query(
    "silhouette_given",
    f"WITH {_rows_sql()}, {_average_steps(len(inp.FEATURES) - 3)}, k AS (SELECT m.a, x.c AS own, y.c AS theirs, avg(v) AS d FROM m JOIN {_MERGED} x ON x.item = m.a JOIN {_MERGED} y ON y.item = m.b WHERE m.a <> m.b GROUP BY 1, 2, 3), "
    "s AS (SELECT a, max(CASE WHEN own = theirs THEN d END) AS i, min(CASE WHEN own <> theirs THEN d END) AS o FROM k GROUP BY 1) "
    f"SELECT count(*) AS items, (SELECT count(DISTINCT c) FROM {_MERGED}) AS clusters, round(avg(CASE WHEN i IS NULL OR o IS NULL OR greatest(i, o) = 0 THEN 0 ELSE (o - i) / greatest(i, o) END), 6) AS silhouette FROM s",
)
def silhouette_given(spark, sf):
    """How well three groups of variables fit the mean correlation distance they were made from."""
    far = cut_lineage(variable_distances(spark, sf))
    labels = cl.cluster_variables(far, inp.FEATURES, 3, "average")[0]
    return inp.rounded(cl.silhouette_given(far, labels, "var_i", "var_j", "d", "variable"), ["silhouette"])


def coded_demo(spark, sf):
    """Label-encoded demographics, the table that persons are clustered on."""
    coded, _ = encode.label_encode(inp.demo(spark, sf).select("num_id", "c_mktsegment", "n_name", "r_name"), ["c_mktsegment", "n_name", "r_name"])
    return coded


def _linkage_sql(k: int) -> str:
    """Bottleneck ranks between all distinct points by repeated squaring; an edge of the tree is its own bottleneck."""
    codes = ", ".join(f"dense_rank() OVER (ORDER BY {c}) - 1 AS {c}" for c in ("c_mktsegment", "n_name", "r_name"))
    gap = " + ".join(f"(a.{c} - b.{c}) ** 2" for c in ("c_mktsegment", "n_name", "r_name"))
    steps = ", ".join(f"m{i + 1} AS (SELECT x.a, y.b, min(greatest(x.t, y.t)) AS t FROM m{i} x JOIN m{i} y ON x.b = y.a GROUP BY 1, 2)" for i in range(8))
    return (
        f"WITH {inp.SQL_DEMO}, coded AS (SELECT num_id, {codes} FROM demo), p AS (SELECT min(num_id) AS id, c_mktsegment, n_name, r_name FROM coded GROUP BY ALL), "
        f"e AS (SELECT a.id AS a, b.id AS b, row_number() OVER (ORDER BY sqrt({gap}), a.id, b.id) AS t FROM p a JOIN p b ON a.id < b.id), "
        f"m0 AS (SELECT a, b, t FROM e UNION ALL SELECT b, a, t FROM e UNION ALL SELECT id, id, 0 FROM p), {steps}, "
        f"tree AS (SELECT e.t FROM e JOIN m8 ON e.a = m8.a AND e.b = m8.b AND e.t = m8.t), "
        f"cut AS (SELECT coalesce(max(t), 0) AS t FROM (SELECT t, row_number() OVER (ORDER BY t) AS n FROM tree) WHERE n <= (SELECT count(*) FROM p) - {k}), "
        "lab AS (SELECT a AS id, min(b) AS c FROM m8 WHERE t <= (SELECT t FROM cut) GROUP BY 1) "
        "SELECT num_id, dense_rank() OVER (ORDER BY lab.c) - 1 AS cluster FROM coded JOIN p USING (c_mktsegment, n_name, r_name) JOIN lab USING (id)"
    )


@query("single_linkage_persons", _linkage_sql(7))
def single_linkage_persons(spark, sf):
    return cl.single_linkage(coded_demo(spark, sf), "num_id", ["c_mktsegment", "n_name", "r_name"], 7)


@query("cluster_person_networks")
def cluster_person_networks(spark, sf):
    v = co.upper_triangle(co.person_corr(_filled(spark, sf), inp.FEATURES), inp.FEATURES)
    return cl.kmeans_vectors(v, "vector", 3).select("num_id", "cluster")


@query("cluster_trajectory")
def cluster_trajectory(spark, sf):
    """Weekly mean line of each k-means cluster of the week vectors."""
    s = series(spark, sf).na.drop("any", subset=W)
    labelled, _ = cl.kmeans_labels(s, W, 3)
    long = labelled.unpivot(["num_id", "cluster"], W, "week", "x")
    return ag.group_stats(long, ["cluster", "week"], "x")


@query("cluster_sizes", "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY 1, 2")
def cluster_sizes(spark, sf):
    return inp.line_numbers(spark, sf).groupBy("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"))


NAMES = ("quiet", "early", "late", "steady", "rising", "falling", "weekend", "bursty", "mixed", "busy")


@query(
    "cluster_names",
    "SELECT vec_id, CASE label " + " ".join(f"WHEN {i} THEN '{n}'" for i, n in enumerate(NAMES)) + " END AS name FROM embeddings",
)
def cluster_names(spark, sf):
    names = spark.createDataFrame(list(enumerate(NAMES)), "label long, name string")
    return inp.vectors(spark, sf).select("vec_id", "label").join(merge.small_side(names, 1000), "label", "left").select("vec_id", "name")
