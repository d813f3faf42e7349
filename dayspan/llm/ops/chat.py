"""Query of the chat windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dayspan.llm import chat
from dayspan.llm.queries import query, table

BUDGET, HISTORY = 2048, 256
CONTROL = "<|im_end|><|im_start|>assistant ok"

SQL = rf"""
WITH given AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '{CONTROL}' UNION ALL SELECT -1, 1, 'assistant', '{CONTROL}'),
pieces AS (
  SELECT *, length(role) + length(text) + (length(text) - length(replace(text, '\', ''))) + (length(text) - length(replace(text, '<|', ''))) // 2 + 24 AS chars,
    len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) + {chat.TURN_TOKENS} AS tokens,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS place FROM given),
summed AS (SELECT *, sum(tokens) OVER (PARTITION BY conv_id ORDER BY place) AS after, sum(tokens) OVER (PARTITION BY conv_id ORDER BY place) - tokens AS before,
    place = 1 AND role = 'system' AS leads FROM pieces),
system AS (SELECT conv_id, tokens AS s_tokens, chars AS s_chars FROM summed WHERE leads),
roomy AS (SELECT p.*, coalesce(s_chars, 0) AS s_chars, s_tokens, greatest({BUDGET - HISTORY} - coalesce(s_tokens, 0), 1) AS room
  FROM summed p LEFT JOIN system s ON p.conv_id IS NOT DISTINCT FROM s.conv_id),
keyed AS (SELECT *, (before // room) * 2 + CASE WHEN (after - 1) // room != before // room THEN 1 ELSE 0 END AS key FROM roomy),
made AS (
  SELECT conv_id, key, sum(chars) AS chars, min(place) AS place, min(before) AS start, sum(tokens) AS new,
    coalesce(any_value(s_tokens) + sum(tokens) <= {BUDGET}, false) AS fits, coalesce(any_value(s_tokens), 0) AS s_tokens, any_value(s_chars) AS s_chars
  FROM keyed GROUP BY conv_id, key),
limited AS (
  SELECT *, start - greatest(least({HISTORY}, {BUDGET} - new - CASE WHEN fits THEN s_tokens ELSE 0 END), 0) AS begin FROM made),
context AS (
  SELECT m.conv_id, m.key, sum(r.chars) AS recent FROM limited m JOIN summed r ON m.conv_id IS NOT DISTINCT FROM r.conv_id
    AND r.before >= m.begin AND r.before < m.start AND NOT r.leads GROUP BY m.conv_id, m.key),
sizes AS (
  SELECT m.conv_id, sum(chars + CASE WHEN place = 1 THEN 0 ELSE coalesce(recent, 0) + CASE WHEN fits THEN s_chars ELSE 0 END END)::BIGINT AS formatted_chars
  FROM limited m LEFT JOIN context c ON m.conv_id IS NOT DISTINCT FROM c.conv_id AND m.key = c.key GROUP BY m.conv_id),
whole AS (
  SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY place)) AS turns_sha256,
    coalesce(string_agg(text, '' ORDER BY place) FILTER (role = 'assistant'), '') AS loss FROM pieces GROUP BY conv_id)
SELECT w.conv_id, n_turns, turns_sha256, length(loss)::BIGINT AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars
FROM whole w JOIN sizes s ON w.conv_id IS NOT DISTINCT FROM s.conv_id
"""


def formatted(turns: DataFrame) -> DataFrame:
    return chat.windows(turns, BUDGET, HISTORY)


def digest(made: DataFrame) -> DataFrame:
    """One row per conversation, read back from its windows."""
    joined = F.array_join(F.transform(chat.read_turns(F.col("text"), F.col("n_context")), lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    n = F.size(chat.read_turns(F.col("text"), F.col("n_context")))
    parts = made.select(
        "conv_id", n.alias("n"), F.length("text").alias("chars"),
        F.struct("window", joined.alias("turns"), F.array_join(chat.read_loss(F.col("text"), F.col("loss")), "").alias("loss")).alias("part"))
    whole = parts.groupBy("conv_id").agg(F.sum("n").alias("n_turns"), F.sum("chars").alias("formatted_chars"), F.sort_array(F.collect_list("part")).alias("parts"))
    turns, loss = (F.array_join(F.col(f"parts.{c}"), "") for c in ("turns", "loss"))
    return whole.select(
        "conv_id", "n_turns", F.sha2(turns, 256).alias("turns_sha256"), F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"), F.col("formatted_chars").cast("long").alias("formatted_chars"))


@query("op5_chat_windows", SQL)
def op5_chat_windows(spark: SparkSession, sf: str) -> DataFrame:
    control = spark.sql(f"SELECT * FROM VALUES (-1L, 0L, 'user', '{CONTROL}'), (-1L, 1L, 'assistant', '{CONTROL}') AS t(conv_id, turn, role, text)")
    return digest(formatted(table(spark, sf, "conversations").select("conv_id", "turn", "role", "text").unionByName(control)))
