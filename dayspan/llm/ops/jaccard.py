"""Query of the n-gram Jaccard join."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dayspan.llm import jaccard
from dayspan.llm.queries import query, table

N, PERCENT = 3, 90


def groups(docs: DataFrame, n: int = N, percent: int = PERCENT) -> DataFrame:
    return jaccard.linked(docs.select("doc_id", "text"), n, percent)


@query("op8_ngram_jaccard")
def op8_ngram_jaccard(spark: SparkSession, sf: str) -> DataFrame:
    out = groups(table(spark, sf, "documents"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.col("component").alias("component_id"))
