"""Corpus pipeline: documents through the text operators, stage by stage.

1. quality rules: rejected documents go;
2. n-gram Jaccard join (five words, similarity 0.8): of each group of near duplicates the
   document with the smallest id stays, of rows with one id one stays;
3. benchmark decontamination: documents that hold a benchmark window go;
4. mixing: a document stays as often as the mix takes it, at most twice;
5. token output: what is left is written to token files and read back, one row per document.

Every stage but the last returns the columns of its input. ``run`` writes each stage's rows to
the shared folder and reads them as the next one's documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from dayspan.llm import shared
from dayspan.llm.ops import decontaminate, jaccard, mixing, quality, tokens
from dayspan.llm.queries import table

NEAR_WORDS, NEAR_PERCENT = 5, 80
ORACLE_SQL = None  # trained weights, see tests/llm/test_pipeline.py


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.judged(docs, docs, table(spark, sf_dir, "labels")).filter("kept").select("row.*")


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows with a null id are kept: nothing names their group."""
    first = jaccard.groups(docs, NEAR_WORDS, NEAR_PERCENT).filter("doc_id = component").select(F.col("doc_id").alias("kept_id")).distinct()
    one = Window.partitionBy("doc_id").orderBy(F.xxhash64("text"))
    rows = docs.join(first, F.col("doc_id") == F.col("kept_id"), "left").filter("kept_id is not null or doc_id is null").withColumn("kept_row", F.row_number().over(one))
    return rows.filter("kept_row = 1 or doc_id is null").select(*docs.columns)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.found(docs, table(spark, sf_dir, "benchmark")).filter("n_hit = 0").select("row.*")


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    taken = mixing.mixed(docs, table(spark, sf_dir, "labels")).filter("copies > 0").select(F.col("id").alias("taken_id"), "copies")
    taken = taken.groupBy("taken_id").agg(F.max("copies").alias("copies"))
    rows = docs.join(taken, F.col("doc_id").eqNullSafe(F.col("taken_id")))
    return rows.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies"))).select(*docs.columns)


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return tokens.digest(docs)


STAGES = [
    ("quality rules", quality_stage),
    ("ngram jaccard join", near_duplicate_stage),
    ("benchmark decontamination", decontamination_stage),
    ("mixing sources", mixing_stage),
    ("token output", token_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = shared.stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
