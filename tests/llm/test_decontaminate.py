import random
import re

from dayspan.llm import decontaminate

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def brute(text, items, size):
    w, hit, found = WORD.findall(lower(text)), set(), set()
    for key, item in items:
        v = WORD.findall(lower(item))
        n = min(len(v), size)
        for i in range(len(v) - n + 1 if v else 0):
            for s in range(len(w) - n + 1):
                if w[s:s + n] == v[i:i + n]:
                    hit |= set(range(s, s + n))
                    found.add("" if key is None else str(key))
    return len(w), len(hit), sorted(found)


def cases():
    rng = random.Random(5)
    vocabulary = ["a", "b", "c", "É", "dd", "x1", "ñu", "THE", "of"]
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(n))) for i, n in enumerate([1, 2, 3, 4, 5, 6, 7, 9, 12, 15, 12])]
    items += [(3, "a b, c! dd"), (None, "x1 x1 the the"), (90, None), (91, ""), (92, "..."), (93, items[8][1])]
    texts = [" ".join(rng.choice(vocabulary) for _ in range(rng.randint(0, 60))) for _ in range(60)]
    texts += [None, "", "?!", items[9][1].upper() + "; " + items[8][1], "A-b.C/dd\n" * 50, "q " * 40_000 + items[9][1]]
    texts.append("no such words here " * 3)
    return items, texts


def test_equals_brute_force_in_one_and_many_blocks(spark):
    items, texts = cases()
    bench = spark.createDataFrame(items, "item_id long, text string")
    df = spark.createDataFrame([(i, t, "c", 5) for i, t in enumerate(texts)], "doc_id int, text string, items string, n_words int").repartition(3)
    want = {i: brute(t, items, 6) for i, t in enumerate(texts)}
    for limit in (2_000_000, 30):
        got = decontaminate.find(df, "text", bench, "item_id", "text", 6, limit).collect()
        assert {r.row.doc_id: (r.n_words, r.n_hit, list(r["items"])) for r in got} == want
        assert all(r.row["items"] == "c" and r.n_hit == sum(s.end - s.first for s in r.spans) for r in got)


def test_empty_benchmark_and_table(spark):
    df = spark.createDataFrame([(1, "some words"), (2, None)], "doc_id int, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    got = {r.row.doc_id: (r.n_words, r.n_hit) for r in decontaminate.find(df, "text", none, "item_id", "text").collect()}
    assert got == {1: (2, 0), 2: (0, 0)}
    bench = spark.createDataFrame([(1, "some words")], "item_id long, text string")
    assert decontaminate.find(df.limit(0), "text", bench, "item_id", "text").count() == 0
