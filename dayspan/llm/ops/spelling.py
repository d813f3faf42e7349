"""Query of the spelling variants."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from dayspan.llm import spelling
from dayspan.llm.queries import query, table

ACCENTED = "".join(chr(c) for c in range(0xC0, 0x100))
# one ASCII sign for each accented letter, none of them a small letter: levenshtein() counts bytes
SIGNS = "".join(chr(c) for c in range(0x23, 0x61) if chr(c) not in "'\\")[:60] + "{|}~"

SQL = f"""
WITH RECURSIVE table_steps(i, k, v) AS (
    SELECT i, 0, i FROM range(256) r(i)
    UNION ALL
    SELECT i, k + 1, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END FROM table_steps WHERE k < 8
),
crc AS (SELECT list(v ORDER BY i) AS tab FROM table_steps WHERE k = 8),
runs AS (
    SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-zÀ-ÿ]+')) AS run
    FROM documents
),
long_runs AS (SELECT doc_id, run, count(*) AS n FROM runs WHERE length(run) >= 6 GROUP BY ALL),
spelled AS (
    SELECT run, n, list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(coalesce(doc_id::VARCHAR, '') || ':' || run, ''),
        lambda c: CASE WHEN unicode(c) < 128 THEN [unicode(c)::BIGINT] ELSE [195::BIGINT, (unicode(c) - 64)::BIGINT] END))) AS bytes
    FROM long_runs
),
digests AS (
    SELECT run, n, xor(list_reduce(bytes, lambda s, b: xor(s >> 8, tab[(xor(s, b) & 255) + 1])), 4294967295) AS h FROM spelled, crc
),
kept AS (
    SELECT CASE WHEN h % 199 = 0 THEN substr(run, 1, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2) ELSE run END AS word, n FROM digests
),
words AS (
    SELECT word, sum(n)::BIGINT AS n, translate(word, '{ACCENTED}', '{SIGNS}') AS plain FROM kept WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5
),
shorter AS (
    SELECT word, n, plain, plain AS part FROM words
    UNION
    SELECT word, n, plain, unnest(list_transform(range(1, length(plain) + 1), lambda i: substr(plain, 1, i - 1) || substr(plain, i + 1))) FROM words
),
near AS (
    SELECT DISTINCT a.word, a.n, b.word AS other, b.n AS other_n FROM shorter a JOIN shorter b USING (part)
    WHERE a.plain <> b.plain AND levenshtein(a.plain, b.plain) = 1
),
best AS (SELECT word, count(*) AS n_near, first(other ORDER BY other_n DESC, other) AS form, max(other_n) AS form_n FROM near GROUP BY word),
forms AS (
    SELECT w.word, w.n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN form_n >= 5 * w.n THEN form END AS form,
        CASE WHEN form_n >= 5 * w.n THEN form_n END AS form_n
    FROM words w LEFT JOIN best USING (word)
),
paths(word, place) AS (
    SELECT word, word FROM forms
    UNION ALL
    SELECT p.word, f.form FROM paths p JOIN forms f ON p.place = f.word WHERE f.form IS NOT NULL
),
roots AS (SELECT p.word, p.place AS root FROM paths p JOIN forms f ON p.place = f.word WHERE f.form IS NULL)
SELECT word, form, root, n, n_near, form_n FROM forms JOIN roots USING (word)
"""


@query("op12_spelling_variants", SQL)
def op12_spelling_variants(spark: SparkSession, sf: str) -> DataFrame:
    out = spelling.variants(table(spark, sf, "documents").select("doc_id", "text"))
    return out.select("word", "form", "root", "n", "n_near", "form_n")
