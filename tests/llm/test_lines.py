import random

from dayspan.llm import lines

SCHEMA = "doc_id long, text string, row string"


def brute(texts, words):
    """A line goes if it lies in an equal run of that many words that starts earlier elsewhere."""
    known = []
    for key in sorted(set(texts), key=lambda k: (k[0] is not None, k[0], k[1] or "")):
        known.append((key, [(i, x.strip()) for i, x in enumerate((key[1] or "").split("\n")) if x.split()]))
    gone = {key: set() for key, _ in known}
    for a, (ka, la) in enumerate(known):
        for b in range(a + 1):
            lb = known[b][1]
            for i in range(len(la)):
                for j in range(len(lb)):
                    if (a, i) <= (b, j) or la[i][1] != lb[j][1] or (i and j and la[i - 1][1] == lb[j - 1][1]):
                        continue
                    n = 0
                    while i + n < len(la) and j + n < len(lb) and la[i + n][1] == lb[j + n][1]:
                        n += 1
                    if sum(len(x.split()) for _, x in la[i:i + n]) >= words:
                        gone[ka] |= {line for line, _ in la[i:i + n]}
    return {k: None if k[1] is None else "\n".join(x for i, x in enumerate(k[1].split("\n")) if i not in g) for k, g in gone.items()}


def test_equals_brute_force(spark):
    rng = random.Random(3)
    pool = [" ".join(rng.choice("abcdef") * 3 for _ in range(rng.randint(1, 4))) for _ in range(12)]
    texts = [(i, "\n".join(rng.choice(pool + ["", "  "]) for _ in range(rng.randint(0, 14)))) for i in range(40)]
    texts += [(100, None), (101, ""), (102, texts[3][1]), (103, "x" * 5000), (103, "x" * 5000), (None, pool[0] + "\n" + pool[1]), (50, pool[0] + " \n\t" + pool[1] + "\n" + pool[2])]
    df = spark.createDataFrame([(*t, "clash") for t in texts], SCHEMA).repartition(3)
    for words in (3, 6):
        want = brute(texts, words)
        got = lines.without_repeats(df, "doc_id", "text", words).collect()
        assert len(got) == len(texts)
        ids = [k for k in want if k[0] != 103]
        assert {(r.row.doc_id, r.row.text): r.kept for r in got if r.row.doc_id != 103} == {k: want[k] for k in ids}
        assert all(r.row.row == "clash" and r.n_removed >= 0 for r in got)


def test_passage_of_one_line_and_empty_table(spark):
    passage = " ".join(f"w{i}" for i in range(55))
    df = spark.createDataFrame([(1, f"start\n{passage}\nend", ""), (2, f"other\n{passage}", ""), (3, "other\nend", "")], SCHEMA)
    got = {r.row.doc_id: r.kept for r in lines.without_repeats(df, "doc_id", "text", 50).collect()}
    assert got == {1: f"start\n{passage}\nend", 2: "other", 3: "other\nend"}
    assert lines.without_repeats(df.limit(0), "doc_id", "text", 50).count() == 0


def test_long_repeated_text_is_walked_once(spark):
    """A text of 20,000 lines and its copy, with blank lines and a change in the middle."""
    body = [f"line {i} alpha beta" if i % 9 else "" for i in range(20_000)]
    other = [*body[:10_000], "changed here", *body[10_001:]]
    df = spark.createDataFrame([(1, "\n".join(body), ""), (2, "\n".join(other), "")], SCHEMA)
    got = {r.row.doc_id: r for r in lines.without_repeats(df, "doc_id", "text", 50).collect()}
    assert got[1].n_removed == 0 and got[1].kept == "\n".join(body)
    assert got[2].kept == "\n".join(x for i, x in enumerate(other) if i == 10_000 or not x)
    assert got[2].n_removed == sum(1 for i, x in enumerate(other) if x and i != 10_000)


def test_spans_become_disjoint(spark):
    df = spark.createDataFrame([("a", 1, 3), ("a", 2, 5), ("a", 6, 7), ("a", 9, 9), ("a", 9, 9), ("b", 0, 0)], "doc string, first int, last int")
    assert sorted(map(tuple, lines.merged(df).collect())) == [("a", 1, 7), ("a", 9, 9), ("b", 0, 0)]
