"""Query of the quality rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from dayspan.llm import quality
from dayspan.llm.queries import query, table


def judged(docs: DataFrame, documents: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` judged by a model that labelled rows of ``documents`` trained."""
    return quality.judge(docs, "text", quality.train(documents.select("doc_id", "text"), labels))


@query("op2_quality_rules")
def op2_quality_rules(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text")
    out = judged(docs, docs, table(spark, sf, "labels"))
    return out.select("row.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "probability")
