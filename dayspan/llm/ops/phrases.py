"""Query of the collocations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from dayspan.llm import phrases
from dayspan.llm.queries import query, table

SQL = r"""
WITH pieces AS (
    SELECT coalesce(lang, 'und') AS lang,
        unnest(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
    FROM documents
),
listed AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM pieces),
single AS (SELECT lang, unnest(ws) AS w FROM listed),
f1 AS (SELECT lang, w, count(*) AS f FROM single GROUP BY ALL),
totals AS (SELECT lang, sum(f)::BIGINT AS n FROM f1 GROUP BY lang),
doubled AS (SELECT lang, unnest(list_transform(range(1, len(ws)), lambda i: [ws[i], ws[i + 1]])) AS g FROM listed),
f2 AS (SELECT lang, g[1] AS w1, g[2] AS w2, count(*) AS f FROM doubled GROUP BY ALL HAVING count(*) >= 10),
tripled AS (SELECT lang, unnest(list_transform(range(1, len(ws) - 1), lambda i: [ws[i], ws[i + 1], ws[i + 2]])) AS g FROM listed),
f3 AS (SELECT lang, g[1] AS w1, g[2] AS w2, g[3] AS w3, count(*) AS f FROM tripled GROUP BY ALL HAVING count(*) >= 10),
inside AS (
    SELECT lang, w1, w2, max(f) AS longer FROM (SELECT lang, w1, w2, f FROM f3 UNION ALL SELECT lang, w2, w3, f FROM f3) GROUP BY ALL
),
two AS (
    SELECT p.lang, p.w1 || ' ' || p.w2 AS phrase, p.f AS a, x.f AS l, y.f AS r, (1000000::HUGEINT * p.f * p.f // (x.f::HUGEINT * y.f))::BIGINT AS score
    FROM f2 p JOIN f1 x ON p.lang = x.lang AND p.w1 = x.w JOIN f1 y ON p.lang = y.lang AND p.w2 = y.w
    LEFT JOIN inside i ON p.lang = i.lang AND p.w1 = i.w1 AND p.w2 = i.w2
    WHERE 100 * coalesce(i.longer, 0) < 50 * p.f
),
three_cuts AS (
    SELECT t.lang, t.w1 || ' ' || t.w2 || ' ' || t.w3 AS phrase, t.f AS a, x.f AS l1, q.f AS r1, p.f AS l2, y.f AS r2,
        (1000000::HUGEINT * t.f * t.f // (x.f::HUGEINT * q.f))::BIGINT AS s1, (1000000::HUGEINT * t.f * t.f // (p.f::HUGEINT * y.f))::BIGINT AS s2
    FROM f3 t JOIN f1 x ON t.lang = x.lang AND t.w1 = x.w JOIN f2 q ON t.lang = q.lang AND t.w2 = q.w1 AND t.w3 = q.w2
    JOIN f2 p ON t.lang = p.lang AND t.w1 = p.w1 AND t.w2 = p.w2 JOIN f1 y ON t.lang = y.lang AND t.w3 = y.w
),
scored AS (
    SELECT * FROM two
    UNION ALL
    SELECT lang, phrase, a, CASE WHEN s1 <= s2 THEN l1 ELSE l2 END, CASE WHEN s1 <= s2 THEN r1 ELSE r2 END, least(s1, s2) FROM three_cuts
),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM scored)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN totals USING (lang) WHERE rank <= 2000
"""


@query("op13_collocations", SQL)
def op13_collocations(spark: SparkSession, sf: str) -> DataFrame:
    return phrases.mined(table(spark, sf, "documents").select("lang", "text"))
