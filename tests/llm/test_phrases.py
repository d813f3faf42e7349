import re
from collections import Counter

import numpy as np
import pytest

from dayspan.llm import phrases

SCHEMA = "lang string, text string, rank int, n string"


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)


def brute(docs, top):
    count, total = Counter(), Counter()
    for lang, text in docs:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\x0A-\x0D]", lower(text or "")):
            w = re.findall("[^\x20\x09]+", piece)
            total[lang] += len(w)
            for k in (1, 2, 3):
                for i in range(len(w) - k + 1):
                    count[(lang, *w[i:i + k])] += 1
    cand = {p: a for p, a in count.items() if len(p) > 2 and a >= 10}
    rows = []
    for p, a in cand.items():
        lang, w = p[0], p[1:]
        longer = [q for q in ((lang, *x[1:]) for x in cand if x[0] == lang and len(x) == 4) if len(w) == 2 and w in (q[1:3], q[2:4])]
        if any(100 * cand[q] >= 50 * a for q in longer):
            continue
        cuts = []
        for k in range(1, len(w)):
            x, y = count[(lang, *w[:k])], count[(lang, *w[k:])]
            cuts.append((1_000_000 * a * a // (x * y), k, x, y))
        score, _, x, y = min(cuts)
        rows.append((lang, " ".join(w), a, x, y, total[lang], score))
    out = []
    for lang in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == lang), key=lambda r: (-r[6], -r[2], r[1].encode()))
        out += [(r[0], i + 1, *r[1:]) for i, r in enumerate(own[:top])]
    return sorted(out)


def corpus():
    rng = np.random.default_rng(4)
    words = ["the", "The", "of", "é", "naïve", "ñ", "x|", "ice", "cream", "new", "york", "a b", "漢字"]
    share = np.array([8, 2, 5, 1, 1, 1, 1, 2, 2, 2, 2, 1, 1], float)
    docs = []
    for i in range(60):
        made = []
        for w in rng.choice(words, int(rng.integers(0, 80)), p=share / share.sum()):
            made += [str(w), ["", ".", ",", "\n", ";", "\t", "\x0b", "?!"][int(rng.integers(0, 30)) % 8 if rng.random() < 0.2 else 0]]
            if rng.random() < 0.1:
                made.append(" new york city ")
        docs.append((["en", "de", None, ""][i % 4], " ".join(made)))
    return docs + [("en", None), (None, ""), ("fr", "bon jour " * 9), ("fr", "\n.\n"), docs[0], docs[0]]


def got(spark, docs, top=2000):
    df = spark.createDataFrame([(a, b, 1, "x") for a, b in docs], SCHEMA)
    return sorted(tuple(r) for r in phrases.mined(df, top).collect())


@pytest.mark.parametrize("block", [None, 7])
def test_mined_equals_brute_force(spark, monkeypatch, block):
    if block:  # blocks end inside pieces, merged stripes are merged again
        monkeypatch.setattr(phrases, "BLOCK_WORDS", block)
        monkeypatch.setattr(phrases, "MERGE_ENTRIES", 50)
    docs = corpus()
    want = brute(docs, 2000)
    assert len(want) > 40
    assert got(spark, docs) == want


def test_top_and_ties(spark):
    docs = corpus()
    assert got(spark, docs, 5) == brute(docs, 5)


def test_nothing_to_find(spark):
    assert got(spark, [("en", None), (None, "one two"), ("de", "")]) == []
    assert phrases.mined(spark.createDataFrame([], SCHEMA)).collect() == []


def test_one_very_long_text(spark):
    docs = [("en", "alpha beta gamma delta, " * 60_000)]
    assert got(spark, docs) == brute(docs, 2000)


def test_scores_are_exact_beyond_64_bits(spark):
    rows = spark.createDataFrame([(3_000_000_007, 3_000_000_019, 3_000_000_021)], "a long, l long, r long")
    a, x, y = 3_000_000_007, 3_000_000_019, 3_000_000_021
    assert rows.select(phrases.score("l", "r")).first()[0] == 1_000_000 * a * a // (x * y)


def test_frequent_first_words_are_cut(spark):
    totals = spark.createDataFrame([(b"en", b"the", 600), (b"en", b"of", 300), (b"en", b"x", 100)], "lang binary, word binary, n long")
    assert phrases.segments(totals, 4) == {(b"en", b"the"): 3, (b"en", b"of"): 2}
    assert phrases.segments(totals.limit(0), 4) == {}
