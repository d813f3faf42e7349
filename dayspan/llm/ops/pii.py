"""Query of the pseudonyms."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dayspan.llm import pii
from dayspan.llm.queries import query, table

KEY = "corpus-2024"  # a cluster passes its own secret


def masked(docs: DataFrame, key: str = KEY) -> DataFrame:
    return pii.pseudonymised(docs, "text", key)


@query("op6_pseudonyms")
def op6_pseudonyms(spark: SparkSession, sf: str) -> DataFrame:
    out = masked(table(spark, sf, "documents").select("doc_id", "text"))
    return out.select("row.doc_id", F.size("kinds").cast("long").alias("n_values"), "kinds", F.col("masked").alias("text"))
