"""Panel tables derived from the driver's tables, once in Spark and once as SQL.

The raw panel is ``events``: person = user_id, day = date of ts, one nullable
column per event type. ``purchase`` stands for the target, the others for sensors.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dayspan.operators import timeline as tl
from dayspan.sources.tables import load_table

SENSORS = ("view", "click", "signup", "error")
TARGET = "purchase"
FEATURES = (*SENSORS, TARGET)


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return load_table(spark, sf, name)


def ev_raw(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    return e.select(
        F.col("user_id").alias("num_id"),
        F.to_date("ts").alias("dt"),
        "ts",
        "event_id",
        "event_type",
        *[F.when(F.col("event_type") == t, F.col("value")).alias(t) for t in FEATURES],
    )


def panel_day(spark: SparkSession, sf: str) -> DataFrame:
    return tl.combine_same_day(ev_raw(spark, sf), "num_id", "ts", ["ts", "event_id"], FEATURES)


def panel_full(spark: SparkSession, sf: str) -> DataFrame:
    """Densified panel with day number and week."""
    dense = tl.densify_days(panel_day(spark, sf))
    return tl.day_number(tl.assign_week(dense))


def panel_weeks(spark: SparkSession, sf: str) -> DataFrame:
    """Recorded person-days (not densified) with day offset and week."""
    return tl.day_number(tl.assign_week(panel_day(spark, sf)))


def person_means(spark: SparkSession, sf: str) -> DataFrame:
    """One row per person: mean of every feature over the recorded days."""
    p = panel_day(spark, sf)
    return p.groupBy("num_id").agg(*[F.avg(c).alias(c) for c in FEATURES])


def demo(spark: SparkSession, sf: str) -> DataFrame:
    """Demographics: customer with nation and region."""
    c, n, r = (table(spark, sf, t) for t in ("customer", "nation", "region"))
    return (
        c.join(n, c.c_nationkey == n.n_nationkey)
        .join(r, n.n_regionkey == r.r_regionkey)
        .select(F.col("c_custkey").alias("num_id"), "c_name", "c_mktsegment", "n_name", "r_name", "c_acctbal")
    )


def line_numbers(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber",
        "l_quantity", "l_extendedprice", "l_discount", "l_tax",
        "l_returnflag", "l_linestatus",
    )


LINE = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")


# Positions of an embedding.
WIDTH = 64


def vectors(spark: SparkSession, sf: str, width: int = WIDTH) -> DataFrame:
    """Embedding positions 1..width as double columns x1.."""
    e = table(spark, sf, "embeddings")
    return e.select(
        "vec_id",
        F.col("label").cast("long").alias("label"),
        *[F.element_at("embedding", i).cast("double").alias(f"x{i}") for i in range(1, width + 1)],
    )


# ---- the same tables as SQL -------------------------------------------------

_F = ", ".join(FEATURES)


def _fill(c: str) -> str:
    w = "PARTITION BY num_id, dt ORDER BY ts, event_id ROWS BETWEEN"
    return (
        f"coalesce(last_value({c} IGNORE NULLS) OVER ({w} UNBOUNDED PRECEDING AND CURRENT ROW), "
        f"first_value({c} IGNORE NULLS) OVER ({w} CURRENT ROW AND UNBOUNDED FOLLOWING)) AS {c}"
    )


SQL_EV = (
    "ev AS (SELECT user_id AS num_id, CAST(ts AS DATE) AS dt, ts, event_id, event_type, "
    + ", ".join(f"CASE WHEN event_type = '{t}' THEN value END AS {t}" for t in FEATURES)
    + " FROM events)"
)
SQL_FILL = f"{SQL_EV}, filled AS (SELECT num_id, dt, ts, event_id, event_type, {', '.join(map(_fill, FEATURES))} FROM ev)"
SQL_DAY = (
    f"{SQL_FILL}, panel AS (SELECT num_id, dt, "
    + ", ".join(f"avg({c}) AS {c}" for c in FEATURES)
    + " FROM filled GROUP BY num_id, dt)"
)
_WEEK = "CAST(floor(date_diff('day', min(dt) OVER (PARTITION BY num_id), dt) / 7) AS INTEGER) AS week"
_DAYNO = "CAST(row_number() OVER (PARTITION BY num_id ORDER BY dt) - 1 AS INTEGER) AS day"
SQL_WEEKS = f"{SQL_DAY}, pw AS (SELECT num_id, dt, {_F}, {_WEEK}, {_DAYNO} FROM panel)"
SQL_FULL = (
    f"{SQL_DAY}, bounds AS (SELECT num_id, min(dt) AS a, max(dt) AS b FROM panel GROUP BY num_id), "
    "cal AS (SELECT num_id, CAST(unnest(generate_series(CAST(a AS TIMESTAMP), CAST(b AS TIMESTAMP), INTERVAL 1 DAY)) AS DATE) AS dt FROM bounds), "
    f"dense AS (SELECT cal.num_id, cal.dt, {_F} FROM cal LEFT JOIN panel ON panel.num_id = cal.num_id AND panel.dt = cal.dt), "
    f"pf AS (SELECT num_id, dt, {_F}, {_WEEK}, {_DAYNO} FROM dense)"
)
SQL_MEANS = (
    f"{SQL_DAY}, means AS (SELECT num_id, " + ", ".join(f"avg({c}) AS {c}" for c in FEATURES) + " FROM panel GROUP BY num_id)"
)
SQL_DEMO = (
    "demo AS (SELECT c_custkey AS num_id, c_name, c_mktsegment, n_name, r_name, c_acctbal FROM customer "
    "JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"
)
SQL_VEC = (
    "vec AS (SELECT vec_id, CAST(label AS BIGINT) AS label, "
    + ", ".join(f"CAST(embedding[{i}] AS DOUBLE) AS x{i}" for i in range(1, WIDTH + 1))
    + " FROM embeddings)"
)


def r6(*cols: str) -> str:
    return ", ".join(f"round({c}, 6) AS {c}" for c in cols)


def rounded(df: DataFrame, cols) -> DataFrame:
    from dayspan.operators.clean import replace_columns
    from dayspan.plans.base import r6 as six

    return replace_columns(df, {c: six(c) for c in cols})
