"""Running a batch function over the texts of a table, with all columns of the rows kept."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dayspan.llm.shared import giving_back, text_batches


def scan(df: DataFrame, column: str, added: str, work: Callable[[], Callable[[pa.Array], list[pa.Array]]]) -> DataFrame:
    """(row, added columns): ``row`` holds the input's columns, so no added name can clash.

    ``work`` is called once per partition; what it returns turns the texts of a batch into
    the added columns.
    """
    place = df.columns.index(column)
    extra = T._parse_datatype_string(added)
    schema = T.StructType([T.StructField("row", df.schema), *extra.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = work()
        for batch in batches:
            rows = batch.column(0)
            yield pa.RecordBatch.from_arrays([rows, *step(rows.field(place))], names=["row", *extra.names])

    return text_batches(df).select(F.struct("*").alias("row")).mapInArrow(giving_back(run), schema)
