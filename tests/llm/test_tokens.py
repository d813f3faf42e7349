import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from dayspan.llm import huffman, token_files, tokenizing
from dayspan.llm.ops import tokens
from dayspan.llm.shared import scratch


def plain(texts):
    tool = tokenizing.encoder(tokens.tokenizer_path()).tokenizer
    return [e.ids + [0] for e in tool.encode_batch([t or "" for t in texts], add_special_tokens=False)]


def odd_texts():
    rng = random.Random(2)
    signs = [" ", "  ", "\n", "\n\n", "\t", "\r\n", "\u00a0", "\u3000", "\u2028", "a", "It's", "é", "ñ.", "“q”", "3.5", "X", "'ll", "**", "<|endoftext|>", "<|endof", "日本", "\u0301", "🙂", ",", "\x00", "\x1c", "\x85"]
    texts = ["".join(rng.choice(signs) for _ in range(rng.randint(0, 30))) for _ in range(1500)]
    return texts + [None, "", "x" * 100_000, "word " * 40_000, " ", "\n"]


def test_pieces_give_the_tokenizers_ids():
    texts = odd_texts()
    got = []
    tool = tokenizing.Encoder(tokens.tokenizer_path())
    for low in range(0, len(texts), 400):  # later batches meet pieces of earlier ones
        for _, _, ids, sizes in tool.encode(pa.array(texts[low:low + 400], pa.string()), 0):
            got += [x.tolist() for x in np.split(ids, np.cumsum(sizes)[:-1])]
    assert got == plain(texts)


@pytest.mark.parametrize("n", [1, 2, 3, 300, 50_257, 130_000])
def test_code_is_optimal_prefix_free_and_limited(n):
    rng = np.random.default_rng(n)
    counts = np.maximum(1, (1e6 / (np.arange(n) + 1.0) ** 1.5).astype(np.int64))
    lengths = huffman.code_lengths(counts)
    assert lengths.max() <= huffman.longest(n) and sum(2.0 ** -lengths) <= 1
    if 1 < n <= 300:  # the unlimited code is within the limit here
        heap = sorted(counts.tolist())
        total = 0
        while len(heap) > 1:
            a, b = heap.pop(0), heap.pop(0)
            total += a + b
            heap = sorted([*heap, a + b])
        if lengths.max() < huffman.LIMIT:
            assert total == int((lengths * counts).sum())
    code = huffman.Code(np.arange(n) * 3, lengths)
    ids, sizes = rng.integers(0, n, 5000) * 3, np.array([1, 127, 128, 129, 1000, 3615])
    data, n_bytes, marks, n_marks = code.encode(ids, sizes)
    assert (code.decode(data, sizes, marks) == ids).all() and n_bytes.sum() == len(data) and n_marks.sum() == len(marks)


def test_files_round_trip(spark, monkeypatch):
    monkeypatch.setattr(token_files, "BLOCK_IDS", 500)
    texts = odd_texts()
    rows = [(i * 7 % 1511, t, "x") for i, t in enumerate(texts)] + [(None, "no id", "x"), (5, "again", "x"), (5, "again", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, start string").repartition(5)
    folder = scratch(spark, "tokens-test")
    token_files.write(df, folder, tokens.tokenizer_path(), 0)
    want = {}
    for (key, _, _), ids in zip(rows, plain([r[1] for r in rows])):
        want.setdefault(key, []).append(ids)
    got, at = {}, 0
    found = sorted(token_files.read_ids(spark, folder).collect(), key=lambda r: r.start)
    for r in found:
        assert r.start == at
        at += len(r.ids)
        got.setdefault(r.doc_id, []).append(list(r.ids))
    assert [r.doc_id is not None for r in found] == sorted(r.doc_id is not None for r in found)
    keys = [r.doc_id for r in found if r.doc_id is not None]
    assert keys == sorted(keys) and {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}
    sums = {(r.doc_id, r.n_tokens, r.ids_crc32) for r in token_files.read_digest(spark, folder).collect()}
    assert sums == {(k, len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for k, v in want.items() for x in v}


def test_empty(spark):
    assert tokens.digest(spark.createDataFrame([], "doc_id long, text string")).count() == 0
