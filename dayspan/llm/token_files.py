"""Token files: ids of all texts, canonical Huffman coded, in blocks that are read on their own.

``write`` leaves two tables in a folder:

* ``codebook``: (id, length), one row per id that occurs; lengths give the canonical code.
* ``blocks``: (slice, block, start, doc_ids, sizes, marks, data), texts in ascending doc_id
  order. ``start`` counts the ids of all texts before the block, ``data`` holds the codes
  (each text starts on a byte) and ``marks`` the bit length of every segment of ids, from
  which any segment's bit offset follows.

Null texts are empty and get the end id only; null doc_ids come first; equal doc_ids keep
one entry each, in order of their ids; an empty table gives empty tables. Other columns of
the input are not read.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dayspan.llm import shared
from dayspan.llm.huffman import SEGMENT, Code, code_lengths
from dayspan.session import shuffle_width

BLOCK_IDS = 1 << 18
SLICE_ROWS = 250_000


def _cuts(docs: DataFrame) -> list[int]:
    """Doc_ids that part the rows into slices of similar size, one file part each."""
    rows = docs.count()
    n = max(shuffle_width(docs), -(-rows // SLICE_ROWS))
    found = docs.select(F.col("doc_id").cast("double").alias("x")).approxQuantile("x", [i / n for i in range(1, n)], 1 / (4 * n))
    return sorted({int(x) for x in found})


def token_ids(docs: DataFrame, tokenizer: str, end_id: int, cuts: list[int]) -> DataFrame:
    """(slice, doc_id, n_tokens, ids, tally): ids as little-endian integers; tally, on one row of a
    partition, counts the partition's ids as pairs of 64-bit integers."""
    edges = np.array(cuts, np.int64)

    def encode(batches):
        from dayspan.llm.tokenizing import encoder

        tool = encoder(tokenizer)
        tally, held = np.zeros(max(tool.size, end_id + 1), np.int64), None
        for batch in batches:
            keys, texts = batch.column(0), batch.column(1)
            cells, sizes = [], []
            for _, _, ids, n in tool.encode(texts, end_id):
                tally += np.bincount(ids, minlength=len(tally))
                at = np.concatenate([[0], np.cumsum(n)]) * tool.dtype.itemsize
                data = ids.astype(tool.dtype, copy=False).tobytes()
                cells += [data[a:b] for a, b in zip(at[:-1].tolist(), at[1:].tolist())]
                sizes.append(n)
            if not cells:
                continue
            if held:
                yield held
            number = keys.fill_null(-(1 << 63)).to_numpy(zero_copy_only=False)
            held = pa.RecordBatch.from_arrays(
                [pa.array(np.searchsorted(edges, number, "right"), pa.int32()), keys, pa.array(np.concatenate(sizes), pa.int64()),
                 pa.array(cells, pa.binary()), pa.nulls(len(cells), pa.binary())],
                names=["slice", "doc_id", "n_tokens", "ids", "tally"])
        if held:
            known = np.flatnonzero(tally)
            pairs = np.stack([known, tally[known]], 1).astype("<u8").tobytes()
            yield held.set_column(4, "tally", pa.array([pairs] + [None] * (held.num_rows - 1), pa.binary()))

    rows = shared.text_batches(docs).select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInArrow(shared.giving_back(encode), "slice int, doc_id long, n_tokens long, ids binary, tally binary")


def id_counts(ids: DataFrame) -> DataFrame:
    """(id, n): how often each id occurs in all texts."""

    def unpack(batches):
        total: dict[int, int] = {}
        for batch in batches:
            for cell in batch.column(0).to_pylist():
                for i, n in np.frombuffer(cell, "<u8").reshape(-1, 2).tolist():
                    total[i] = total.get(i, 0) + n
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int64()), pa.array(list(total.values()), pa.int64())], names=["id", "n"])

    return ids.filter(F.col("tally").isNotNull()).select("tally").mapInArrow(shared.giving_back(unpack), "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))


def _coded(ids: DataFrame, code: Code, item: str) -> DataFrame:
    """Every text's codes and marks in place of its ids."""

    def encode(batches):
        for batch in batches:
            step = 256
            for low in range(0, batch.num_rows, step):
                part = batch.slice(low, step)
                sizes = part.column(2).to_numpy()
                flat = np.frombuffer(b"".join(part.column(3).to_pylist()), item).astype(np.int64)
                data, n_bytes, marks, n_marks = code.encode(flat, sizes)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), part.column(2), _cells(data, n_bytes), _cells(marks.astype("<u2").view(np.uint8), 2 * n_marks)],
                    names=["slice", "doc_id", "n_tokens", "data", "marks"])

    return ids.select("slice", "doc_id", "n_tokens", "ids").mapInArrow(shared.giving_back(encode), "slice int, doc_id long, n_tokens long, data binary, marks binary")


def _cells(data: np.ndarray, sizes: np.ndarray) -> pa.Array:
    at, raw = np.concatenate([[0], np.cumsum(sizes)]).tolist(), data.tobytes()
    return pa.array([raw[a:b] for a, b in zip(at[:-1], at[1:])], pa.binary())


BLOCKS = "slice int, block int, start long, doc_ids array<long>, sizes array<long>, marks binary, data binary"


def _packed(coded: DataFrame, before: dict[int, int]) -> DataFrame:
    """Blocks of about ``BLOCK_IDS`` ids from rows that are sorted by slice and doc_id."""

    def pack(batches):
        held, count, current, number, start = [], 0, None, 0, 0

        def block():
            rows = pa.Table.from_batches(held).combine_chunks()
            sizes = rows.column(2)
            return pa.RecordBatch.from_arrays(
                [pa.array([current], pa.int32()), pa.array([number], pa.int32()), pa.array([start], pa.int64()),
                 pa.array([rows.column(1).to_pylist()], pa.list_(pa.int64())), pa.array([sizes.to_pylist()], pa.list_(pa.int64())),
                 pa.array([b"".join(rows.column(4).to_pylist())], pa.binary()), pa.array([b"".join(rows.column(3).to_pylist())], pa.binary())],
                names=["slice", "block", "start", "doc_ids", "sizes", "marks", "data"])

        for batch in batches:
            slices, sizes = batch.column(0).to_pylist(), batch.column(2).to_pylist()
            low = 0
            for i, (at, n) in enumerate(zip(slices, sizes)):
                full = count + n > BLOCK_IDS and count
                if at != current or full:
                    if i > low:
                        held.append(batch.slice(low, i - low))
                    if held:
                        yield block()
                    start, number = (start + count, number + 1) if at == current else (before[at], 0)
                    held, count, current, low = [], 0, at, i
                count += n
            held.append(batch.slice(low))
        if held:
            yield block()

    return coded.mapInArrow(shared.giving_back(pack), BLOCKS)


def write(docs: DataFrame, folder: str, tokenizer: str, end_id: int) -> None:
    """Encodes every whole text once, counts all ids, and writes the coded blocks below ``folder``."""
    spark = docs.sparkSession
    ids = shared.stored(token_ids(docs, tokenizer, end_id, _cuts(docs)), "token-ids")
    counts = id_counts(ids).toPandas()  # at most one row per id of the vocabulary
    known, n = counts["id"].to_numpy(np.int64), counts["n"].to_numpy(np.int64)
    order = np.argsort(known)
    known, lengths = known[order], code_lengths(n[order])
    rows = list(zip(known.tolist(), lengths.tolist()))
    spark.createDataFrame(rows, "id long, length int").coalesce(1).write.parquet(f"{folder}/codebook")
    totals = {r[0]: r[1] for r in ids.groupBy("slice").agg(F.sum("n_tokens")).collect()}  # one row per slice
    before, at = {}, 0
    for key in sorted(totals):
        before[key], at = at, at + totals[key]
    item = "<u2" if _vocabulary(tokenizer) <= 1 << 16 else "<u4"
    coded = _coded(ids, Code(known, lengths), item)
    ordered = coded.repartition(max(shuffle_width(docs), len(totals)), "slice").sortWithinPartitions("slice", "doc_id")
    _packed(ordered, before).write.option("compression", "uncompressed").parquet(f"{folder}/blocks")


def _vocabulary(tokenizer: str) -> int:
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer).get_vocab_size()


def read(spark: SparkSession, folder: str, visit, schema: str) -> DataFrame:
    """Decodes all blocks; ``visit(doc_ids, starts, sizes, ids)`` turns one block into a record batch."""
    book = spark.read.parquet(f"{folder}/codebook").toPandas()  # at most one row per id of the vocabulary
    code = Code(book["id"].to_numpy(np.int64), book["length"].to_numpy(np.int64)) if len(book) else None

    def decode(batches):
        for batch in batches:
            for start, keys, sizes, marks, data in zip(*(batch.column(i) for i in range(5))):
                n = sizes.values.to_numpy()
                ids = code.decode(np.frombuffer(data.as_buffer(), np.uint8), n, np.frombuffer(marks.as_buffer(), "<u2"))
                yield visit(keys.values, start.as_py() + np.cumsum(n) - n, n, ids)

    blocks = spark.read.schema(BLOCKS).parquet(f"{folder}/blocks")
    return blocks.select("start", "doc_ids", "sizes", "marks", "data").mapInArrow(shared.giving_back(decode), schema)


def read_ids(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, start, ids) of all texts."""

    def visit(keys, starts, sizes, ids):
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(ids.astype(np.int64)))
        return pa.RecordBatch.from_arrays([keys, pa.array(starts), lists], names=["doc_id", "start", "ids"])

    return read(spark, folder, visit, "doc_id long, start long, ids array<long>")


def read_digest(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of all texts; the checksum is over ids as unsigned 32-bit integers."""

    def visit(keys, starts, sizes, ids):
        data = ids.astype("<u4").tobytes()
        ends = np.cumsum(sizes) * 4
        sums = [zlib.crc32(data[a:b]) for a, b in zip((ends - 4 * sizes).tolist(), ends.tolist())]
        return pa.RecordBatch.from_arrays([keys, pa.array(starts), pa.array(sizes), pa.array(sums, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return read(spark, folder, visit, "doc_id long, start long, n_tokens long, ids_crc32 long")


__all__ = ["BLOCK_IDS", "SEGMENT", "read", "read_digest", "read_ids", "token_ids", "write"]
