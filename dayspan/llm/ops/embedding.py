"""Query of the quality classifier on subword vectors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dayspan.llm import embedding
from dayspan.llm.queries import query, table

FOLDS, HELD = 3, 1


def held_out(doc_id: Column) -> Column:
    """Ids whose labels are never learned; a null id counts as an empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % FOLDS == HELD


@query("op11_subword_quality")
def op11_subword_quality(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text")
    model = embedding.train(docs, table(spark, sf, "labels").select("doc_id", "quality"), ~held_out(F.col("doc_id")))
    rows = embedding.scored(docs, "text", model).select("row.doc_id", "score")
    return rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
