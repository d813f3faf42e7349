"""Named tables in a folder: Parquet or CSV in, Parquet out."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def load_table(
    spark: SparkSession, folder: str, name: str, fmt: str = "parquet", schema: StructType | None = None
) -> DataFrame:
    """One table; a CSV needs its schema stated, because inferring it costs a scan."""
    path = f"{folder}/{name}.{fmt}"
    if fmt == "csv":
        if schema is None:
            raise ValueError(f"{name}: a CSV source needs an explicit schema")
        return spark.read.schema(schema).option("header", True).csv(path)
    return spark.read.format(fmt).load(path)


def load_tables(
    spark: SparkSession,
    folder: str,
    names: Iterable[str],
    fmt: str = "parquet",
    schemas: Mapping[str, StructType] | None = None,
) -> dict[str, DataFrame]:
    """A folder of named tables as lazy scans."""
    schemas = schemas or {}
    return {n: load_table(spark, folder, n, fmt, schemas.get(n)) for n in names}


def load_first(spark: SparkSession, paths: Iterable[str], fmt: str = "parquet") -> DataFrame:
    """The first path that exists, on whatever file system the path names."""
    tried = list(paths)
    for path in tried:
        try:
            return spark.read.format(fmt).load(path)
        except AnalysisException as err:
            if err.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
                raise
    raise FileNotFoundError(f"none of {tried} exists")


def save_table(df: DataFrame, folder: str, name: str, partition_by: Iterable[str] = ()) -> str:
    """Write one named Parquet table, partitioned by e.g. the cohort so that scans prune."""
    path = f"{folder}/{name}.parquet"
    writer = df.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return path


def save_table_csv(df: DataFrame, folder: str, name: str) -> str:
    """Write a named table as a CSV folder with a header, without an index column."""
    path = f"{folder}/{name}.csv"
    df.write.mode("overwrite").option("header", True).csv(path)
    return path


def write_keys(keys: Mapping[str, DataFrame], folder: str) -> dict[str, str]:
    """Save the lookup tables (encoder, id and season keys) next to the panel."""
    return {name: save_table(df, folder, name) for name, df in keys.items()}


def id_key(df: DataFrame, natural: str, number: str, *extra: str) -> DataFrame:
    """Distinct (natural id, number, ...) rows: the pseudonym key."""
    return df.select(natural, number, *extra).distinct()


def season_key(spark: SparkSession) -> DataFrame:
    """Season labels and their codes."""
    from dayspan.functions.columns import season, season_code

    months = spark.range(1, 13).select(F.col("id").cast("int").alias("month"))
    return months.select("month", season(F.col("month")).alias("season")).withColumn(
        "season_num", season_code(F.col("season"))
    )
