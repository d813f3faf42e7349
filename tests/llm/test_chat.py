import hashlib
import random

from pyspark.sql import functions as F

from dayspan.llm import chat
from dayspan.llm.ops import chat as chat_query

SCHEMA = "conv_id long, turn long, role string, text string"
ODD = ["<|im_end|>", "<|", "\\", "<\\p", "\\<|", "<\\\\p|", "<|im_start|>assistant\nok", "\n", "a b", "", "é 日本", "<", "|>"]


def turns():
    rng = random.Random(9)
    rows = []
    for conv in range(25):
        n = rng.randint(1, 12)
        for t in range(n):
            role = "system" if t == 0 and conv % 2 else ["user", "assistant", "to\nol", "<|x"][min(rng.randint(0, 5), 3) if t else 0]
            rows.append((conv, t, role, "".join(rng.choice(ODD) + rng.choice(["", " w ", "v\n"]) for _ in range(rng.randint(0, 25)))))
    rows += [(100, 0, None, None), (100, 0, "user", "tie b"), (100, 0, "user", "tie a"), (100, None, "assistant", "first"), (None, 1, "assistant", "x"), (None, 0, "user", "y")]
    rows += [(101, 0, "assistant", "long " * 30_000), (101, 1, "assistant", "end"), (102, 1, "user", "same"), (102, 1, "user", "same")]
    return rows


def expected(rows):
    out = {}
    for conv in {r[0] for r in rows}:
        own = sorted(((r[1] is not None, r[1], r[2] or "", r[3] or "") for r in rows if r[0] == conv))
        loss = "".join(x[3] for x in own if x[2] == "assistant")
        whole = "".join(f"{x[2]}\n{x[3]}\n" for x in own)
        out[conv] = (len(own), hashlib.sha256(whole.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return out


def test_round_trip_and_windows(spark):
    rows = turns()
    df = spark.createDataFrame([(*r, 1) for r in rows], SCHEMA + ", window int").repartition(3)
    for budget, history in ((40, 10), (2048, 256)):
        made = chat.windows(df, budget, history)
        got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in chat_query.digest(made).collect()}
        assert got == expected(rows)
        for r in made.withColumn("turns", chat.read_turns(F.col("text"), F.lit(0))).collect():
            tokens = [len(t.text.split()) + chat.TURN_TOKENS for t in r.turns]
            fresh = tokens[r.n_context:]
            assert fresh and (sum(tokens) <= budget or len(tokens) == 1)
            repeated = tokens[1 if r.turns[0].role == "system" else 0:r.n_context] if r.n_context else []
            assert sum(repeated) <= history
            assert r.text.count("<|im_start|>") == r.text.count("<|im_end|>") == len(r.turns)
            assert [s.length for s in r.loss] == sorted([s.length for s in r.loss], key=[s.length for s in r.loss].index)
            lead = [len((x[3] or "").split()) + chat.TURN_TOKENS for x in rows if x[0] == r.conv_id and x[1] == 0 and x[2] == "system"]
            if r.window > 1 and lead and lead[0] + sum(fresh) <= budget:
                assert r.turns[0].role == "system" and r.n_context >= 1


def test_long_system_turn_keeps_the_budget(spark):
    """A system turn of 1,800 words beside turns of 150, and one that leaves no room at all."""
    rows = [(1, 0, "system", "rule " * 1800)] + [(1, t, ["assistant", "user"][t % 2], "word " * 150) for t in range(1, 9)]
    rows += [(2, 0, "system", "rule " * 2040)] + [(2, t, ["assistant", "user"][t % 2], "word " * (900 * t)) for t in range(1, 4)]
    made = chat.windows(spark.createDataFrame(rows, SCHEMA), 2048, 256).withColumn("turns", chat.read_turns(F.col("text"), F.lit(0))).collect()
    for r in made:
        tokens = [len(t.text.split()) + chat.TURN_TOKENS for t in r.turns]
        assert sum(tokens) <= 2048 or len(tokens) == 1
    assert max(sum(len(t.text.split()) + chat.TURN_TOKENS for t in r.turns) for r in made if r.conv_id == 1) <= 2048
    assert all((r.turns[0].role == "system") == (r.conv_id == 1 or r.window == 1) for r in made if r.window > 1 or r.conv_id == 2)


def test_empty(spark):
    assert chat.windows(spark.createDataFrame([], SCHEMA), 100, 10).count() == 0
