"""Query of the URL rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from dayspan.llm import urls
from dayspan.llm.queries import query, table

RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]
OTHERWISE = "allow"

SQL = f"""
WITH rules(host, path, verdict) AS (VALUES {", ".join(str(r) for r in RULES)}),
rest AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
split AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM rest),
hosts AS (SELECT DISTINCT s.host, r.host AS rule_host, r.path AS rule_path, r.verdict
  FROM (SELECT DISTINCT host FROM split) s JOIN rules r ON s.host = r.host OR ends_with(s.host, '.' || r.host)),
fits AS (
  SELECT s.page_id, s.host, s.path, h.rule_host || h.rule_path AS rule, h.verdict,
    row_number() OVER (PARTITION BY s.page_id, s.host, s.path ORDER BY length(h.rule_host || h.rule_path) DESC, length(h.rule_host) DESC) AS k
  FROM split s JOIN hosts h ON s.host = h.host AND starts_with(s.path, h.rule_path))
SELECT s.page_id, s.host, s.path, f.rule, coalesce(f.verdict, '{OTHERWISE}') AS verdict
FROM split s LEFT JOIN fits f ON f.k = 1 AND f.page_id = s.page_id
"""


@query("op7_url_rules", SQL)
def op7_url_rules(spark: SparkSession, sf: str) -> DataFrame:
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    return urls.judge(table(spark, sf, "pages").select("page_id", "url"), "url", rules, OTHERWISE).select("page.page_id", "host", "path", "rule", "verdict")
