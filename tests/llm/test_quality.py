import re
from collections import Counter

import numpy as np

from dayspan.llm import quality
from dayspan.llm.ops.quality import judged

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def counts(text):
    text = text or ""
    w = WORD.findall(text)
    grams = Counter(tuple(w[i:i + 3]) for i in range(len(w) - 2))
    covered = {i + j for i in range(len(w) - 2) if grams[tuple(w[i:i + 3])] > 1 for j in range(3)}
    rows = [x for x in text.split("\n") if WORD.search(x)]
    return (sum(map(len, w)), len(w), len(re.findall(r"[#*$%&|<>]", text)), len(rows) - len(set(rows)), len(covered))


def test_rules_equal_brute_force(spark, sf):
    texts = [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").select("text").collect()]
    texts += [None, "", " \n\t", "a b c a b c a b c", "x\nx\n\nx \n", "é ü x #|", "a" * 300_000, "one two " * 60_000, "\n\n\n"]
    df = spark.createDataFrame([(i, t, 7, "x") for i, t in enumerate(texts)], "doc_id int, text string, n_words int, kept string")
    for r in quality.judge(df, "text", None).collect():
        want = counts(texts[r.row.doc_id])
        assert (r.word_chars, r.n_words, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[1] < 50 or 100 * want[4] > 50 * want[1])
        assert r.kept == (not r.base_failed) and r.probability is None and r.row.kept == "x"
    assert quality.judge(df.limit(0), "text", None).count() == 0


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    some, rest = labels.filter("doc_id % 3 <> 0"), labels.filter("doc_id % 3 = 0")
    model = quality.train(docs, some)
    got = quality.judge(docs, "text", model).filter("not base_failed").select("row.doc_id", "kept", "probability").join(rest, "doc_id").collect()
    right = np.mean([r.kept == (r.quality == 1) for r in got])
    assert len(got) > 80 and right > 0.95


def test_no_labels_or_one_class(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert quality.train(docs, none) is None
    assert quality.train(docs, spark.createDataFrame([(1, 1), (2, None), (None, 0), (3, 5)], "doc_id long, quality int")) is None
    assert judged(docs, docs, none).filter("kept = base_failed").count() == 0


def test_platt_is_monotone():
    rng = np.random.default_rng(1)
    score = rng.normal(size=400)
    slope, shift = quality.platt(score, (rng.random(400) < 1 / (1 + np.exp(-2 * score + 1))).astype(int))
    assert 1.2 < slope < 3 and -1.7 < shift < -0.4
