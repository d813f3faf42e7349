"""Query of the line dedup."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dayspan.llm import lines
from dayspan.llm.queries import query, table

WORDS = 50

SQL = rf"""
WITH every AS (
  SELECT doc_id, i - 1 AS line, content, regexp_replace(content, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g') AS bare,
    len(regexp_extract_all(content, '[^\x20\x09-\x0D]+')) AS words
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS content, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents)),
summed AS (SELECT *, sum(words) OVER (PARTITION BY doc_id ORDER BY line) AS after FROM every WHERE words > 0),
made AS (
  SELECT doc_id, unnest([
    {{'first': min(line) OVER f, 'last': max(line) OVER f, 'size': sum(words) OVER f, 'run': array_to_string(list(bare) OVER f, chr(10))}},
    {{'first': min(line) OVER b, 'last': max(line) OVER b, 'size': sum(words) OVER b, 'run': array_to_string(list(bare) OVER b, chr(10))}}]) AS w
  FROM summed WINDOW f AS (PARTITION BY doc_id ORDER BY after - words RANGE BETWEEN CURRENT ROW AND {WORDS - 1} FOLLOWING),
    b AS (PARTITION BY doc_id ORDER BY after RANGE BETWEEN {WORDS - 1} PRECEDING AND CURRENT ROW)),
windows AS (SELECT doc_id, w.first AS first, w.last AS last, w.run AS run FROM made WHERE w.size >= {WORDS}),
later AS (
  SELECT doc_id, first, last FROM (SELECT *, rank() OVER (PARTITION BY run ORDER BY doc_id, first) AS k FROM windows) WHERE k > 1),
gone AS (SELECT DISTINCT e.doc_id, e.line FROM every e JOIN later l ON e.doc_id = l.doc_id AND e.line BETWEEN l.first AND l.last WHERE e.words > 0),
marked AS (SELECT e.*, g.line IS NOT NULL AS gone FROM every e LEFT JOIN gone g ON e.doc_id = g.doc_id AND e.line = g.line),
kept AS (
  SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_removed, coalesce(string_agg(content, chr(10) ORDER BY line) FILTER (NOT gone), '') AS text
  FROM marked GROUP BY doc_id)
SELECT doc_id, coalesce(n_lines, 0)::BIGINT AS n_lines, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(length(k.text), 0)::BIGINT AS kept_chars,
  sha256(coalesce(k.text, '')) AS kept_sha256
FROM documents LEFT JOIN kept k USING (doc_id)
"""


@query("op1_line_dedup", SQL)
def op1_line_dedup(spark: SparkSession, sf: str) -> DataFrame:
    out = lines.without_repeats(table(spark, sf, "documents").select("doc_id", "text"), "doc_id", "text", WORDS)
    kept = F.coalesce("kept", F.lit(""))
    return out.select(
        "row.doc_id", F.col("n_lines").cast("long").alias("n_lines"), F.col("n_removed").cast("long").alias("n_removed"),
        F.length(kept).cast("long").alias("kept_chars"), F.sha2(kept, 256).alias("kept_sha256"))
