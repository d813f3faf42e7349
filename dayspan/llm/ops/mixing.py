"""Query of the source mix."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dayspan.llm import mixing, shared
from dayspan.llm.queries import query, table

CYCLE, SHARE, CAP, SEED = [3.0, 1.0, 2.0], 1.5, 2.0, 11
GOOD, UNKNOWN, POOR = 2.0, 1.0, 0.5


def weighed(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(id, source, size, weight): words of the text; the weight follows the document's lowest quality label."""
    best = labels.groupBy(F.col("doc_id").alias("l_id")).agg(F.min("quality").alias("quality"))
    rows = docs.select(F.col("doc_id").alias("id"), "source", F.coalesce(F.regexp_count("text", F.lit(shared.WORD)), F.lit(0)).cast("long").alias("size"))
    weight = F.when(F.col("quality") == 1, GOOD).when(F.col("quality") == 0, POOR).otherwise(UNKNOWN)
    return rows.join(best, rows["id"] == best["l_id"], "left").select("id", "source", "size", weight.alias("weight"))


def mixed(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The mix of whole documents; texts are read once, only ids, sources and sizes go on."""
    return mixing.mix(shared.stored(weighed(docs, labels), "mix-sizes"), CYCLE, SHARE, CAP, SEED)


SQL = rf"""
WITH sized AS (
  SELECT d.doc_id, d.source, coalesce(len(regexp_extract_all(d.text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
    CASE l.quality WHEN 1 THEN {GOOD} WHEN 0 THEN {POOR} ELSE {UNKNOWN} END::DOUBLE AS weight
  FROM documents d LEFT JOIN (SELECT doc_id, min(quality) AS quality FROM labels GROUP BY doc_id) l ON d.doc_id = l.doc_id),
keyed AS (
  SELECT *, -ln((('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || '/{SEED}'), 1, 12))::BIGINT::DOUBLE + 0.5) / 281474976710656.0) / weight AS key FROM sized),
sources AS (SELECT source, sum(size)::BIGINT AS source_size FROM keyed GROUP BY source),
placed AS (SELECT *, row_number() OVER (ORDER BY source ASC NULLS LAST) AS place FROM sources),
weighed AS (
  SELECT *, CASE (place - 1) % 3 WHEN 0 THEN 3.0 WHEN 1 THEN 1.0 ELSE 2.0 END::DOUBLE AS w, ({CAP} * source_size)::DOUBLE AS most FROM placed),
rated AS (
  SELECT *, most / w AS full_at,
    (({SHARE})::DOUBLE * (sum(source_size) OVER ())::DOUBLE - coalesce(sum(most) OVER before, 0)) / ((sum(w) OVER ()) - coalesce(sum(w) OVER before, 0)) AS rate
  FROM weighed WINDOW before AS (ORDER BY most / w, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
common AS (SELECT arg_min(rate, {{'full_at': full_at, 'place': place}}) AS rate FROM rated WHERE full_at > rate),
targets AS (
  SELECT r.source, r.source_size, CASE WHEN r.full_at <= r.rate THEN r.most ELSE least(r.most, c.rate * r.w) END AS target FROM rated r, common c),
running AS (
  SELECT k.doc_id, k.source, k.size, t.source_size, t.target,
    sum(k.size) OVER (PARTITION BY k.source ORDER BY k.key, k.doc_id, k.size ROWS UNBOUNDED PRECEDING) - k.size AS start,
    CASE WHEN t.source_size > 0 THEN floor(t.target / t.source_size)::BIGINT ELSE 0 END AS epochs
  FROM keyed k JOIN targets t ON k.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, source, size, source_size, round(target, 6) AS target,
  (size * (epochs + CASE WHEN start + size / 2.0 <= target - epochs * source_size THEN 1 ELSE 0 END))::BIGINT AS taken
FROM running
"""


@query("op3_source_mix", SQL)
def op3_source_mix(spark: SparkSession, sf: str) -> DataFrame:
    out = mixed(table(spark, sf, "documents"), table(spark, sf, "labels"))
    return out.select(F.col("id").alias("doc_id"), "source", "size", "source_size", F.round("target", 6).alias("target"), "taken")
