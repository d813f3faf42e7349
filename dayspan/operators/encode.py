"""Label encoding with a saved key, and its inverse."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from dayspan.functions.ordered import number_rows
from dayspan.operators.merge import small_side

# A category table above this many values is joined by shuffle, not broadcast.
CATEGORY_BOUND = 100_000


def _number_many(values: DataFrame, col: str) -> DataFrame:
    """(label, encoding) of very many distinct values, without sorting them in one task.

    Numbers order themselves. For texts the bytes after the prefix that all values share order the texts; two six-byte
    numbers of them place the range slices, the text itself settles the rest.
    """
    if isinstance(values.schema[col].dataType, NumericType):
        present = values.filter(F.col(col).isNotNull())
        numbered = number_rows(present, [col], "_at").select(F.col(col).cast("string").alias("label"), (F.col("_at") - 1).cast("long").alias("encoding"))
        last = F.lit(present.count()).cast("long").alias("encoding")
        return numbered.unionByName(values.filter(F.col(col).isNull()).select(F.col(col).cast("string").alias("label"), last))
    known = values.filter(F.col(col).isNotNull()).select(F.col(col).cast("string").alias("label"))
    ends = known.agg(F.min("label"), F.max("label"), F.count(F.lit(1))).first()
    low, high = (x.encode() for x in ends[:2])
    shared = next((i for i, (x, y) in enumerate(zip(low, high)) if x != y), min(len(low), len(high)))

    def six_bytes(start: int):
        digits = F.rpad(F.hex(F.substring(F.encode("label", "UTF-8"), start, 6)), 12, "0")
        return F.conv(digits, 16, 10).cast("double")

    coded = known.select("label", six_bytes(shared + 1).alias("_a"), six_bytes(shared + 7).alias("_b"))
    numbered = number_rows(coded, ["_a", "_b", "label"], "_at").select("label", (F.col("_at") - 1).cast("long").alias("encoding"))
    missing = values.filter(F.col(col).isNull()).select(F.col(col).cast("string").alias("label"), F.lit(ends[2]).cast("long").alias("encoding"))
    return numbered.unionByName(missing)


def encoder_key(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(column, encoding, label): codes by sorted value, a missing value takes the last code.

    A category of usual size is ranked by one small window over its distinct
    values; one with very many, such as a person id, is ranked in range slices.
    """
    parts = []
    for c in cols:
        values = df.select(c).distinct()
        if values.limit(CATEGORY_BOUND + 1).count() > CATEGORY_BOUND:
            ranked = _number_many(values, c)
        else:
            place = Window.partitionBy(F.lit(1)).orderBy(F.col(c).asc_nulls_last())
            ranked = values.select(F.col(c).cast("string").alias("label"), (F.row_number().over(place) - 1).cast("long").alias("encoding"))
        parts.append(ranked.select(F.lit(c).alias("column"), "encoding", "label"))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def label_encode(df: DataFrame, cols: Sequence[str], key: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Replace each column by its code; returns the frame and the key table."""
    key = key if key is not None else encoder_key(df, cols)
    for c in cols:
        codes = small_side(
            key.filter(F.col("column") == c).select(F.col("label").alias("_label"), F.col("encoding").alias("_code")),
            CATEGORY_BOUND,
        )
        df = df.join(codes, df[c].cast("string").eqNullSafe(codes["_label"]), "left").select(
            *[F.col("_code").alias(c) if x == c else df[x] for x in df.columns]
        )
    return df, key


def label_decode(df: DataFrame, cols: Sequence[str], key: DataFrame) -> DataFrame:
    """Codes back to labels through the key table."""
    for c in cols:
        labels = small_side(
            key.filter(F.col("column") == c).select(F.col("encoding").alias("_code"), F.col("label").alias("_label")),
            CATEGORY_BOUND,
        )
        df = df.join(labels, df[c] == labels["_code"], "left").select(
            *[F.col("_label").alias(c) if x == c else df[x] for x in df.columns]
        )
    return df
