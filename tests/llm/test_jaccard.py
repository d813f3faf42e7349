import random
import re

import pytest

from dayspan.llm import graph, jaccard

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def gram_set(text, k):
    w = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[i:i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def brute(texts, k, percent):
    sets = [(i, gram_set(t, k)) for i, t in texts]
    root = {i: i for i, _ in texts}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, (i, x) in enumerate(sets):
        for j, y in sets[:a]:
            both = len(x & y)
            if both and 100 * both >= percent * len(x | y):
                low, high = sorted((find(i), find(j)))
                root[high] = low
    return {i: (len(s), find(i)) for i, s in sets}


def corpus():
    rng = random.Random(8)
    words = [f"w{i}" for i in range(300)] + ["The", "é", "ñ,"]
    base = [[rng.choice(words) for _ in range(rng.randint(20, 90))] for _ in range(12)]
    texts = []
    for b in base:
        for _ in range(rng.randint(1, 14)):
            w = list(b)
            for _ in range(rng.randint(0, 4)):
                w[rng.randrange(len(w))] = rng.choice(words)
            texts.append(" ".join(w).upper() if rng.random() < 0.2 else "\n".join(w))
    # a chain: each like the next one, its ends apart
    line = [rng.choice(words) for _ in range(100)]
    for i in range(0, 30, 2):
        texts.append(" ".join([f"n{j}" if j < i else x for j, x in enumerate(line)]))
    texts += [None, "", " ", "one", "ONE", "one two", "one two", "one two three", "a a a a a", "a a a", "b b b b b b b b", "z" * 100_000, "q " * 30_000, "common line of words " * 2]
    rng.shuffle(texts)
    return [(i * 3 + 5, t) for i, t in enumerate(texts)]


@pytest.mark.parametrize("k,percent", [(3, 90), (5, 80), (3, 50)])
def test_equals_brute_force(spark, k, percent):
    texts = corpus()
    df = spark.createDataFrame(texts, "doc_id long, text string").repartition(4)
    got = jaccard.linked(df, k, percent).collect()
    assert len(got) == len(texts)
    assert {r.doc_id: (r.n, r.component) for r in got} == brute(texts, k, percent)


def test_group_around_one_base_and_copies(spark):
    """Copies of one base that are only like the base, many equal texts, and members just out of reach."""
    base = [f"b{i}" for i in range(120)]
    texts = [(0, " ".join(base))]
    for i in range(1, 400):
        w = list(base)
        for j in range(1 + i % 3):
            w[(i * 7 + j * 40) % 120] = f"u{i}_{j}"
        texts.append((i, " ".join(w) if i % 5 else " ".join(base)))
    df = spark.createDataFrame(texts, "doc_id long, text string").repartition(8)
    assert {r.doc_id: (r.n, r.component) for r in jaccard.linked(df, 3, 90).collect()} == brute(texts, 3, 90)


def test_equal_and_null_ids_and_empty_table(spark):
    df = spark.createDataFrame([(1, "a b c d"), (1, "e f g h"), (2, "e f g h"), (None, "a b c d"), (None, "x y z")], "doc_id long, text string")
    got = sorted(((r.doc_id, r.component) for r in jaccard.linked(df, 3, 90).collect()), key=repr)
    assert got == sorted([(1, 1), (1, 1), (2, 1), (None, 1), (None, None)], key=repr)
    assert jaccard.linked(df.limit(0), 3, 90).count() == 0


def test_components_of_a_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(7, i) for i in range(1000, 1400)] + [(3, 1399)]
    got = {r.node: r.component for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 100 for i in range(100, 161)} | {i: 3 for i in (3, 7, *range(1000, 1400))}
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0
