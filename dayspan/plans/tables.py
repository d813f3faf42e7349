"""Reading, writing and choosing tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from dayspan.functions import columns as X
from dayspan.operators import clean, encode
from dayspan.plans import inputs as inp
from dayspan.plans.base import query
from dayspan.session import shared_folder
from dayspan.sources import tables as src


@query(
    "scan_tables",
    "SELECT 'customer' AS name, count(*) AS n, max(c_acctbal) AS top FROM customer UNION ALL "
    "SELECT 'orders', count(*), max(o_totalprice) FROM orders UNION ALL "
    "SELECT 'events', count(*), max(value) FROM events",
)
def scan_tables(spark, sf):
    t = src.load_tables(spark, sf, ["customer", "orders", "events"])
    tops = {"customer": "c_acctbal", "orders": "o_totalprice", "events": "value"}
    parts = [
        t[n].agg(F.count(F.lit(1)).alias("n"), F.max(c).alias("top")).select(F.lit(n).alias("name"), "n", "top")
        for n, c in tops.items()
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query(
    "sink_roundtrip",
    "SELECT CASE WHEN user_id % 2 = 0 THEN 'V1' ELSE 'V2' END AS v, event_id, user_id AS num_id, "
    "CAST(ts AS DATE) AS dt, value FROM events",
)
def sink_roundtrip(spark, sf):
    e = inp.table(spark, sf, "events").select(
        F.when(F.col("user_id") % 2 == 0, "V1").otherwise("V2").alias("v"),
        "event_id", F.col("user_id").alias("num_id"), F.to_date("ts").alias("dt"), "value",
    )
    folder = f"{shared_folder(spark)}/roundtrip-{uuid.uuid4().hex}"
    return spark.read.parquet(src.save_table(e, folder, "panel", ["v"]))


@query("project_drop_like", "SELECT o_orderkey, o_custkey, o_totalprice FROM orders")
def project_drop_like(spark, sf):
    marked = inp.table(spark, sf, "orders").withColumnsRenamed({"o_orderdate": "o_date_int", "o_orderstatus": "Unnamed: 0"})
    return clean.drop_like(marked, "^Unnamed", "_int$", "priority$")


@query("scan_fallback", "SELECT r_regionkey, r_name FROM region")
def scan_fallback(spark, sf):
    return src.load_first(spark, [f"{sf}/region_scaled.parquet", f"{sf}/region.parquet"]).select("r_regionkey", "r_name")


@query(
    "encoder_key",
    "WITH d AS (SELECT 'c_mktsegment' AS \"column\", c_mktsegment AS label FROM customer UNION SELECT 'n_name', n_name FROM nation "
    "UNION SELECT 'r_name', r_name FROM region) SELECT \"column\", row_number() OVER (PARTITION BY \"column\" ORDER BY label) - 1 AS encoding, label FROM d",
)
def encoder_key(spark, sf):
    key = encode.encoder_key(inp.demo(spark, sf), ["c_mktsegment", "n_name", "r_name"])
    folder = f"{shared_folder(spark)}/keys-{uuid.uuid4().hex}"
    paths = src.write_keys({"encoder_key": key}, folder)
    return spark.read.parquet(paths["encoder_key"])


@query(
    "id_key",
    "SELECT DISTINCT c_name AS participant_id, c_custkey AS num_id, CASE WHEN contains(c_name, '00001') THEN 'V2' ELSE 'V1' END AS v FROM customer",
)
def id_key(spark, sf):
    d = inp.table(spark, sf, "customer").select(
        F.col("c_name").alias("participant_id"), F.col("c_custkey").alias("num_id"),
        X.cohort(F.col("c_name"), "00001").alias("v"),
    )
    return src.id_key(d, "participant_id", "num_id", "v")
