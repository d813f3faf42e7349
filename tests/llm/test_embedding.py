import zlib
from collections import Counter

import numpy as np
import pytest

from dayspan.llm import embedding
from dayspan.llm import textscan as ts
from dayspan.llm.ops.embedding import op11_subword_quality

SF = "/root/testdata/sf0.01"


def one(text):
    raw = np.frombuffer(text.encode(), np.uint8)
    return embedding.Texts(raw, np.array([0, len(raw)]))


def test_held_out_accuracy_and_fold(spark):
    rows = op11_subword_quality(spark, SF).collect()
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    assert len(rows) == spark.read.parquet(f"{SF}/documents.parquet").count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows)
    held = [(r.score, labels[r.doc_id], r.predicted) for r in rows if r.held_out and r.doc_id in labels]
    good, bad = [s for s, y, _ in held if y], [s for s, y, _ in held if not y]
    assert np.mean([y == p for _, y, p in held]) > 0.95
    assert np.mean([[g > b for b in bad] for g in good]) > 0.98


def test_held_out_labels_do_not_matter(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    labels = spark.createDataFrame([(i, i % 2) for i in range(120)], "doc_id long, quality int")
    turned = spark.createDataFrame([(i, i % 2 if i % 4 else 1 - i % 2) for i in range(120)], "doc_id long, quality int")
    a, b = (embedding.train(docs, x, "doc_id % 4 <> 0") for x in (labels, turned))
    assert np.array_equal(a.weights, b.weights) and a.odds == b.odds


def test_subwords_by_definition():
    texts = one("aé b")
    words = ["aé", "b"]
    grams = Counter(("<" + w + ">")[i:i + k] for w in words for k in (3, 4, 5) for i in range(len(w) + 2 - k + 1))
    assert sum(grams.values()) == 4  # <aé, aé>, <aé> and <b>
    slots, times = texts.counts()[0]
    assert times.sum() == 2 + 4 + 1  # words, character n-grams, the pair
    assert (slots < embedding.WORD_SLOTS).sum() == 3
    twice = one("aé b aé b").counts()[0]
    assert twice[1].sum() == 4 + 8 + 3 and set(slots) <= set(twice[0])


def test_margin_is_the_softmax_of_the_average():
    rng = np.random.default_rng(2)
    vectors = rng.normal(size=(embedding.SLOTS, embedding.DIMENSIONS)).astype(np.float32)
    layer = rng.normal(size=(2, embedding.DIMENSIONS)).astype(np.float32)
    model = embedding.Model(embedding.slot_weights(vectors, layer), 0.0)
    for text in ("the of and the of", "x", "Ünï 漢字 word! word!"):
        made = one(text)
        slots, times = made.counts()[0]
        out = layer @ ((times / times.sum()) @ vectors[slots])
        assert abs(model.scores(made)[0] - np.exp(out[1]) / np.exp(out).sum()) < 1e-5


def test_gradient_step_lowers_the_loss():
    rows = [one(t).counts()[0] for t in ("good words here", "bad $$$ junk", "good more here", "junk $$$ more")]
    good = np.array([1, 0, 1, 0])
    vectors, layer = embedding.train_vectors(rows, good, epochs=40)
    w = embedding.slot_weights(vectors, layer)
    margin = [(t * w[s]).sum() / t.sum() for s, t in rows]
    assert min(margin[0], margin[2]) > 0 > max(margin[1], margin[3])


def test_edge_rows(spark):
    docs = spark.createDataFrame([(1, None, 0.1), (2, "", 0.2), (None, "a b", 0.3), (3, " \n", 0.4), (3, "x" * 400_000, 0.5), (3, "y " * 100_000, 0.6)], "doc_id long, text string, score double")
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert embedding.train(docs.select("doc_id", "text"), none) is None
    assert embedding.train(docs.select("doc_id", "text"), spark.createDataFrame([(1, 1), (2, None), (None, 0), (3, 7)], "doc_id long, quality int")) is None
    flat = embedding.scored(docs, "text", None)
    assert [r.score for r in flat.collect()] == [0.5] * 6
    rng = np.random.default_rng(1)
    model = embedding.Model(rng.normal(size=embedding.SLOTS).astype(np.float32), 1.0)
    rows = embedding.scored(docs, "text", model).collect()
    empty = 1 / (1 + np.exp(-1.0))
    assert sorted(r.row.score for r in rows) == [0.1, 0.2, 0.3, 0.4, 0.5, 0.6]
    assert all(abs(r.score - empty) < 1e-9 for r in rows if not (r.row.text or "").strip())
    assert embedding.scored(docs.limit(0), "text", model).collect() == []


def test_repeated_ids_are_one_row_of_the_sample(spark):
    docs = spark.createDataFrame([(i, f"w{i % 7} v{i % 5}") for i in range(60)] * 30, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, quality int")
    a, b = embedding.train(docs, labels), embedding.train(docs.distinct(), labels)
    assert np.array_equal(a.weights, b.weights)


def test_chunks_do_not_change_scores():
    texts = ["one two three", "", "two three four", "Ünï"]
    raw = np.frombuffer("".join(texts).encode(), np.uint8)
    at = np.concatenate([[0], np.cumsum([len(t.encode()) for t in texts])])
    w = np.random.default_rng(3).normal(size=embedding.SLOTS).astype(np.float32)
    whole = embedding.Texts(raw, at).margins(w)
    parts = np.concatenate([embedding.Texts(p, o).margins(w) for _, _, p, o in ts.chunks(raw, at, 10)])
    assert np.allclose(whole, parts)
    with pytest.raises(IndexError):
        one("x").counts()[1]
