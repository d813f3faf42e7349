import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from dayspan.llm import spelling

LETTERS = re.compile("[A-Za-zÀ-ÿ]+")
SCHEMA = "doc_id long, text string, word string, n int"


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)


def near(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    long, short = (a, b) if len(a) > len(b) else (b, a)
    return any(long[:i] + long[i + 1:] == short for i in range(len(long)))


def brute(docs):
    count = Counter()
    for i, text in docs:
        for run in LETTERS.findall(text or ""):
            run = lower(run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 199 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            count[run] += 1
    words = {w: n for w, n in count.items() if len(w) >= 6 and n >= 5}
    out = {}
    for w, n in words.items():
        others = [v for v in words if near(v, w)]
        best = min(others, key=lambda v: (-words[v], v), default=None)
        form = best if best and words[best] >= 5 * n else None
        out[w] = [form, n, len(others), words[form] if form else None]
    for w, row in out.items():
        root = w
        while out[root][0]:
            root = out[root][0]
        row.insert(1, root)
    return {w: tuple(row) for w, row in out.items()}


def corpus():
    rng = np.random.default_rng(3)
    base = ["garden", "gardén", "straße", "lanternes", "aaaaaaa", "Ünïcodé", "stream", "master", "z" * 60, "y" * 3000]
    words = []
    for b in base:
        words += [b] * int(rng.integers(5, 400))
        for _ in range(12):
            i, kind, c = int(rng.integers(0, len(b))), int(rng.integers(0, 3)), "abzé÷"[int(rng.integers(0, 5))]
            v = b[:i] + c + b[i:] if kind == 0 else b[:i] + b[i + 1:] if kind == 1 else b[:i] + c + b[i + 1:]
            words += [v] * int(rng.integers(3, 60))
    rng.shuffle(words)
    docs = [(int(rng.integers(0, 40)), " ".join(words[i:i + 50])) for i in range(0, len(words), 50)]
    return docs + [docs[0], (None, "Lanternes lanternes"), (5, None), (6, ""), (7, "a1b2 _x_ 漢字lantern漢 STREAMstream")]


def frame(spark, docs):
    return spark.createDataFrame([(i, t, "x", 1) for i, t in docs], SCHEMA)


def got(spark, docs):
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in spelling.variants(frame(spark, docs)).collect()}


@pytest.mark.parametrize("limits", [None, (20, 40)])
def test_variants_equal_brute_force(spark, monkeypatch, limits):
    if limits:  # every node is split on and on, and blocks end inside nodes
        monkeypatch.setattr(spelling, "NODE_WORDS", limits[0])
        monkeypatch.setattr(spelling, "BLOCK_ROWS", limits[1])
    docs = corpus()
    want = brute(docs)
    assert len(want) > 60 and sum(1 for r in want.values() if r[0]) > 10
    assert got(spark, docs) == want


def test_words_of_one_letter_group_stay_complete(spark):
    letters = "etanio"
    rng = np.random.default_rng(5)
    docs = [(1, " ".join([w] * 5)) for w in {"".join(rng.permutation(list(letters))) for _ in range(150)}]
    docs += [(2, " ".join(["etanioe", "etani", "etanix"] * 30))]
    assert got(spark, docs) == brute(docs)


def test_no_words(spark):
    assert got(spark, [(1, None), (2, ""), (3, "abc 12")]) == {}
    assert spelling.variants(frame(spark, [(1, "x")]).limit(0)).collect() == []


def test_one_very_long_text(spark):
    docs = [(3, "garden gardens " * 80_000 + "gardan " * 7)]
    assert got(spark, docs) == brute(docs)


def test_crc_and_distance_by_definition():
    raw = np.frombuffer(b"hello world, again", np.uint8)
    starts, ends = np.array([0, 6, 6, 18]), np.array([5, 11, 18, 18])
    prefix = np.array([zlib.crc32(b"7:"), zlib.crc32(b"12345:"), zlib.crc32(b":"), zlib.crc32(b"9:")], np.uint32)
    want = [zlib.crc32(raw[a:b].tobytes(), int(p)) for a, b, p in zip(starts, ends, prefix)]
    assert spelling.crc32_on(prefix, raw, starts, ends).tolist() == want
    rng = np.random.default_rng(1)
    for _ in range(500):
        a = bytes(rng.integers(97, 100, int(rng.integers(1, 6))).tolist())
        b = bytes(rng.integers(97, 100, int(rng.integers(1, 6))).tolist())
        assert spelling.one_apart(a, b) == near(a, b)


def test_counts_of_words():
    made = spelling.word_counts(pa.array([b"tea", "é".encode("latin-1")], pa.binary()))
    assert made[0, :4].tolist() == [2, 0, 1, 0] and made[0].sum() == 6 and made[1].sum() == 2
