"""Repeated runs of lines, found by winnowing and removed where they come again.

Lines with a word are hashed (white space at their ends apart). A window is the shortest run of
lines from a line on, or up to a line, that has at least ``words`` words; its fingerprint is the
place of its smallest line hash. Two equal runs of that many words hold equal windows, so they
share a fingerprint for certain. Fingerprints of one place only lead nowhere; the windows
around the others are compared: equal ones with the earliest (by document, then line). Windows from a line and up to a line overlap along an equal run in
both directions, so the lines of all windows that have an earlier copy are exactly the maximal
equal runs of that many words, without their first occurrence.

The rest of a document stays as it is. Null texts have no lines and stay null; a document whose
lines are all removed keeps an empty text. Rows with equal id and text are one document and get
the same result; rows with equal id and another text are told apart by a hash of the text. Null
ids come first. Columns are kept inside ``row``; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dayspan.llm import shared

SECOND = 7  # what the second hash of a line and of a run begins with
EDGE = r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$"


def line_rows(docs: DataFrame) -> DataFrame:
    """(doc, line, h, h2, words) of all lines with a word of (doc, text), one document in one place; two hashes, 128 bits, name a line."""
    rows = docs.select("doc", F.posexplode(F.split("text", "\n")).alias("line", "content"))
    rows = rows.select("doc", "line", F.regexp_replace("content", EDGE, "").alias("bare"), F.regexp_count("content", F.lit(shared.WORD)).alias("words"))
    rows = rows.select("doc", "line", F.xxhash64("bare").alias("h"), F.xxhash64(F.lit(SECOND), "bare").alias("h2"), "words")
    one = [F.any_value(c).alias(c) for c in ("h", "h2", "words")]
    return rows.filter("words > 0").repartition("doc").groupBy("doc", "line").agg(*one)


def windows(lines: DataFrame, words: int) -> DataFrame:
    """(doc, first, last, mark, at, run, run2, n): all windows from a line and up to a line.

    ``mark`` and ``at`` are hash and line of the fingerprint, ``run``, ``run2`` and ``n`` hashes and number of the lines.
    """
    order = Window.partitionBy("doc").orderBy("line")
    rows = lines.withColumn("after", F.sum("words").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.withColumn("before", F.col("after") - F.col("words"))
    forward = Window.partitionBy("doc").orderBy("before").rangeBetween(0, words - 1)
    backward = Window.partitionBy("doc").orderBy("after").rangeBetween(-(words - 1), 0)
    sides = [
        F.struct(
            F.min("line").over(w).alias("first"), F.max("line").over(w).alias("last"), F.sum("words").over(w).alias("size"),
            F.min(F.struct("h", "line")).over(w).alias("least"), F.collect_list("h").over(w).alias("hashes"),
            F.collect_list("h2").over(w).alias("hashes2"))
        for w in (forward, backward)
    ]
    rows = rows.select("doc", sides[0].alias("f"), sides[1].alias("b")).select("doc", F.inline(F.array("f", "b"))).filter(F.col("size") >= words)
    return rows.select("doc", "first", "last", F.col("least.h").alias("mark"), F.col("least.line").alias("at"), F.xxhash64("hashes").alias("run"), F.xxhash64(F.lit(SECOND), "hashes2").alias("run2"), F.size("hashes").alias("n"))


def repeated(lines: DataFrame, words: int) -> DataFrame:
    """(doc, first, last) of all windows that come earlier too."""
    made = windows(lines, words)
    place = F.struct("doc", "at")
    several = made.groupBy("mark").agg(F.min(place).alias("low"), F.max(place).alias("high")).filter("low <> high").select("mark")
    near = made.join(several, "mark", "left_semi")
    here = F.struct("doc", "first")
    same = ["run", "run2", "n"]
    earliest = near.groupBy(*same).agg(F.min(here).alias("original"), F.max(here).alias("latest")).filter("original <> latest").drop("latest")
    return near.join(earliest, same).filter(here > F.col("original")).select("doc", "first", "last")


def without_repeats(docs: DataFrame, key: str, text: str, words: int) -> DataFrame:
    """(row, n_lines, n_removed, kept): ``kept`` is the text without its repeated runs of lines."""
    doc = F.struct(F.col(key).alias("id"), F.xxhash64(text).alias("hash"))
    spans = repeated(line_rows(docs.select(doc.alias("doc"), F.col(text).cast("string").alias("text"))), words)
    spans = merged(spans).groupBy("doc").agg(F.sort_array(F.collect_list(F.struct("first", "last"))).alias("spans")).withColumnRenamed("doc", "s_doc")
    rows = docs.select(F.struct("*").alias("row"), doc.alias("doc")).join(spans, F.col("doc") == F.col("s_doc"), "left")
    body = F.col(f"row.`{text}`").cast("string")
    rows = rows.select("row", F.coalesce(F.size(F.split(body, "\n")), F.lit(0)).alias("n_lines"), removed(body, F.col("spans")).alias("done"))
    return rows.select("row", F.greatest("n_lines", F.lit(0)).alias("n_lines"), F.col("done.n").alias("n_removed"), F.col("done.kept").alias("kept"))


def merged(spans: DataFrame) -> DataFrame:
    """(doc, first, last): spans of a document that overlap or touch as one, so that no line is in two."""
    order = Window.partitionBy("doc").orderBy("first", "last")
    reached = F.max("last").over(order.rowsBetween(Window.unboundedPreceding, -1))
    rows = spans.distinct().withColumn("opens", (reached.isNull() | (F.col("first") > reached + 1)).cast("int"))
    rows = rows.withColumn("island", F.sum("opens").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy("doc", "island").agg(F.min("first").alias("first"), F.max("last").alias("last")).drop("island")


def removed(text: Column, spans: Column) -> Column:
    """(n, kept): a text without the lines of its disjoint spans that have a word; each line is looked at once."""
    parts = F.split(text, "\n")

    def piece(span: Column, i: Column) -> Column:
        """The lines between the span before and this one, and this one's lines without a word."""
        begin = F.when(i > 0, F.get(spans, i - 1)["last"] + 1).otherwise(0)
        inside = F.slice(parts, span["first"] + 1, span["last"] - span["first"] + 1)
        return F.concat(F.slice(parts, begin + 1, span["first"] - begin), F.filter(inside, lambda x: ~F.regexp_like(x, F.lit(shared.WORD))))

    end = F.element_at(spans, -1)["last"] + 1
    stays = F.concat(F.flatten(F.transform(spans, piece)), F.slice(parts, end + 1, F.greatest(F.size(parts) - end, F.lit(0))))
    return F.when(spans.isNull(), F.struct(F.lit(0).alias("n"), text.alias("kept"))).otherwise(
        F.struct((F.size(parts) - F.size(stays)).alias("n"), F.array_join(stays, "\n").alias("kept")))
