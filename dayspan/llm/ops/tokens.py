"""Query of the token files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from dayspan.llm import shared, token_files
from dayspan.llm.queries import query, table

TOKENIZER, END_ID = "byte_bpe_50k.json", 0


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def digest(docs: DataFrame) -> DataFrame:
    """Writes all texts to token files in the shared folder and reads them back."""
    folder = shared.scratch(docs.sparkSession, "token-files")
    token_files.write(docs, folder, tokenizer_path(), END_ID)
    return token_files.read_digest(docs.sparkSession, folder)


@query("op10_token_files")
def op10_token_files(spark: SparkSession, sf: str) -> DataFrame:
    return digest(table(spark, sf, "documents"))
