import re
import zlib

import numpy as np
import pytest

import corpus_pipeline as cp
from dayspan.llm.ops import tokens
from dayspan.llm.shared import stored
from dayspan.llm.tokenizing import encoder
from tests_helpers import near_components, window_hits

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def steps(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs]
    for name, stage in cp.STAGES:
        out.append(stored(stage(spark, out[-1], SF), "test-stage"))
    return out


def test_names_and_columns(steps):
    assert [n for n, _ in cp.STAGES] == ["quality rules", "ngram jaccard join", "benchmark decontamination", "mixing sources", "token output"]
    assert all(df.columns == steps[0].columns for df in steps[:-1])


def test_quality_keeps_clean_documents(spark, steps):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    kept = {r.doc_id for r in steps[1].collect()}
    long = [r for r in steps[0].collect() if len(re.findall(r"[^\x20\x09-\x0D]+", r.text)) >= 60 and r.doc_id in labels]
    right = np.mean([(r.doc_id in kept) == (labels[r.doc_id] == 1) for r in long])
    assert right > 0.95


def test_one_of_each_near_duplicate_group_stays(steps):
    before = [(r.doc_id, r.text) for r in steps[1].collect()]
    component = near_components(before, cp.NEAR_WORDS, cp.NEAR_PERCENT)
    assert sorted(r.doc_id for r in steps[2].collect()) == sorted({component[i] for i, _ in before})


def test_contaminated_documents_go(spark, steps):
    items = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    want = sorted(r.doc_id for r in steps[2].collect() if not window_hits(r.text, items, 10))
    assert sorted(r.doc_id for r in steps[3].collect()) == want


def test_mix_comes_near_one_and_a_half_times(steps):
    n = lambda rows: sum(len(re.findall(r"[^\x20\x09-\x0D]+", r.text)) for r in rows)
    before, after = steps[3].collect(), steps[4].collect()
    times = {}
    for r in after:
        times[r.doc_id] = times.get(r.doc_id, 0) + 1
    assert max(times.values()) <= 2 and set(times) <= {r.doc_id for r in before}
    largest = sum(max(len(r.text.split()) for r in before if r.source == s) / 2 for s in {r.source for r in before})
    assert abs(n(after) - 1.5 * n(before)) <= largest


def test_token_rows_equal_the_tokenizer(steps):
    rows, tool = steps[4].orderBy("doc_id").collect(), encoder(tokens.tokenizer_path()).tokenizer
    start, want = 0, []
    for r in rows:
        ids = tool.encode(r.text, add_special_tokens=False).ids + [0]
        want.append((r.doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted(map(tuple, steps[5].collect())) == want


def test_empty_documents(spark, tmp_path):
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{SF}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert cp.run(spark, str(tmp_path)).count() == 0


def test_null_and_repeated_rows_pass_all_stages(spark, tmp_path):
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{SF}/{name}.parquet").write.parquet(f"{tmp_path}/{name}.parquet")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = spark.createDataFrame([(None, None, None, None, None), (7, None, "en", "src1", 1), (None, "a " * 99, None, None, 2), (9001, "word " * 20_000, "en", None, 3)], docs.schema)
    docs.union(docs.limit(20)).union(odd).write.parquet(f"{tmp_path}/documents.parquet")
    assert cp.run(spark, str(tmp_path)).count() > 0
