"""Query of the main text of pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from dayspan.llm import html_text
from dayspan.llm.queries import query, table


@query("op9_main_text")
def op9_main_text(spark: SparkSession, sf: str) -> DataFrame:
    out = html_text.extract(table(spark, sf, "pages"), "html")
    return out.select("row.page_id", "row.url", "text", "n_chars")
