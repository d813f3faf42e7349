"""Train, validation and test splits and folds."""

from __future__ import annotations

from pyspark.sql import functions as F

from dayspan.operators import splits
from dayspan.plans import inputs as inp
from dayspan.plans.base import hash_sql, query
from dayspan.plans.preparing import keyed_panel

_PEOPLE = f"p AS (SELECT num_id, row_number() OVER (ORDER BY {hash_sql('num_id')}, num_id) AS pos, count(*) OVER () AS n FROM (SELECT DISTINCT user_id AS num_id FROM events))"


def _people(spark, sf):
    return inp.table(spark, sf, "events").select(F.col("user_id").alias("num_id"))


@query("group_split", f"WITH {_PEOPLE} SELECT num_id, CASE WHEN pos <= ceil(n * CAST(0.15 AS DOUBLE)) THEN 'test' ELSE 'train' END AS split FROM p")
def group_split(spark, sf):
    return splits.group_split(_people(spark, sf))


def _three(source: str, cols: str) -> str:
    t = "ceil(n * CAST(0.15 AS DOUBLE))"
    return (
        f"SELECT {cols}, CASE WHEN pos <= {t} THEN 'test' WHEN pos <= {t} + ceil((n - {t}) * CAST(0.2 AS DOUBLE)) THEN 'val' ELSE 'train' END AS split FROM {source}"
    )


@query("group_split3", f"WITH {_PEOPLE} {_three('p', 'num_id')}")
def group_split3(spark, sf):
    return splits.group_split3(_people(spark, sf))


@query(
    "row_split3",
    f"WITH p AS (SELECT event_id, row_number() OVER (ORDER BY {hash_sql('event_id')}, event_id) AS pos, count(*) OVER () AS n FROM events) {_three('p', 'event_id')}",
)
def row_split3(spark, sf):
    return splits.row_split3(inp.table(spark, sf, "events").select("event_id"), "event_id")


@query(
    "tail_split",
    f"WITH {inp.SQL_WEEKS}, r AS (SELECT num_id, day, row_number() OVER (ORDER BY day, num_id) AS pos, count(*) OVER () AS n FROM pw) "
    "SELECT num_id, day, CASE WHEN pos > n - floor(n * CAST(0.15 AS DOUBLE)) THEN 'val' ELSE 'train' END AS split FROM r",
)
def tail_split(spark, sf):
    return splits.tail_split(inp.panel_weeks(spark, sf).select("num_id", "day"), ["day", "num_id"])


@query(
    "window_split",
    f"WITH {inp.SQL_WEEKS} SELECT num_id, day, CASE WHEN day BETWEEN 0 AND 14 THEN 'train' ELSE 'val' END AS split FROM pw WHERE day BETWEEN 0 AND 14 OR day BETWEEN 18 AND 24",
)
def window_split(spark, sf):
    return splits.window_split(inp.panel_weeks(spark, sf).select("num_id", "day"), (0, 14), (18, 24))


@query(
    "group_kfold",
    f"WITH s AS (SELECT user_id AS num_id, count(*) AS rows FROM events GROUP BY 1), r AS (SELECT *, (row_number() OVER (ORDER BY rows DESC, {hash_sql('num_id')}, num_id) - 1) % 10 AS turn FROM s) "
    "SELECT num_id, rows, CAST(CASE WHEN turn < 5 THEN turn ELSE 9 - turn END AS INTEGER) AS fold FROM r",
)
def group_kfold(spark, sf):
    return splits.group_kfold(_people(spark, sf), k=5)


@query(
    "kfold",
    f"SELECT cell_row, CAST((row_number() OVER (ORDER BY {hash_sql('cell_row')}, cell_row) - 1) % 10 AS INTEGER) AS fold FROM "
    "(SELECT DISTINCT user_id * 100000 + date_diff('day', DATE '2000-01-01', CAST(ts AS DATE)) AS cell_row FROM events)",
)
def kfold(spark, sf):
    return splits.kfold(keyed_panel(spark, sf).select("cell_row"), "cell_row", 10)


@query(
    "feature_target",
    f"WITH {inp.SQL_DAY} SELECT num_id, dt, round(view, 6) AS view, round(click, 6) AS click, round(purchase, 6) AS y FROM panel",
)
def feature_target(spark, sf):
    p = inp.panel_day(spark, sf).select(
        "num_id", "dt", "view", "click", F.col("purchase").alias("phq2_sum"), F.col("signup").alias("phq2_1"), F.col("error").alias("phq9_bin")
    )
    return inp.rounded(splits.feature_target(p)[0], ["view", "click", "y"])
