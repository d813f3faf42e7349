"""Quality rules and a quality classifier over hashed n-grams.

Rules look at counts of a text (see ``RULES``). The classifier is a logistic regression on
the shares of hashed word n-grams (one and two words) and byte n-grams (three and four bytes)
of a text. It is fitted on a bounded sample of labelled rows, the same number of each class,
and its score is turned into a probability on a held-out part of the sample (Platt's method).
All texts are scored whole in Arrow batches, against a fixed threshold.

Null texts have no words and fail the rules. Labels other than 0 and 1 and null labels are
not used; of a document's labels the lowest counts. With fewer than ``LEAST`` rows of a
class there is no model: the probability is null and the rules alone decide. Columns of the
documents are kept inside ``row``, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dayspan.llm import textscan as ts
from dayspan.llm.rowscan import scan
from dayspan.llm.shared import giving_back, text_batches

CHUNK = 1 << 18  # bytes; the n-grams of a chunk take some fifty times as much
DIMS = 1 << 16  # of each of the two n-gram families
PER_CLASS, LEAST = 1500, 20  # rows of each class in the sample, at most and at least
ROUNDS, RATE, DECAY = 80, 0.5, 1e-6
SCALE = 20.0  # shares are small numbers
THRESHOLD = 0.5
LEAST_WORDS, MOST_REPEATED = 50, 50
RULES = "word_chars long, n_words long, n_symbols long, n_dup_lines long, n_repeat_words long"

_symbol = np.zeros(256, bool)
_symbol[[ord(c) for c in "#*$%&|<>"]] = True
_not_line = np.zeros(256, bool)
_not_line[0x0A] = True
_inner = np.zeros(256, bool)
_inner[0x80:0xC0] = True  # later bytes of a character


def _sums(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(values, dtype=np.int64 if values.dtype != np.float32 else np.float64)])
    return total[at[1:]] - total[at[:-1]]


def _repeats(rows: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each entry: is its hash in its row elsewhere too, and is it there earlier."""
    key = ts.mix(hashes + ts.mix(rows.astype(np.uint64) + np.uint64(1)))
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    again, earlier = np.zeros(len(key), bool), np.zeros(len(key), bool)
    again[order[1:][same]] = again[order[:-1][same]] = True
    earlier[order[1:][same]] = True
    return again, earlier


class Scan:
    """Words of the texts of a chunk and the counts that the rules use."""

    def __init__(self, raw: np.ndarray, at: np.ndarray):
        self.raw, self.at, n = raw, at, len(at) - 1
        self.starts, self.ends, self.rows = ts.word_bounds(raw, at, ts.SPACE)
        self.hashes = ts.span_hashes(raw, self.starts, self.ends)
        self.n_words = np.bincount(self.rows, minlength=n)

    def rules(self) -> list[np.ndarray]:
        raw, at, n = self.raw, self.at, len(self.at) - 1
        word_chars = _sums(~(ts.SPACE[raw] | _inner[raw]), at)
        symbols = _sums(_symbol[raw], at)
        line_starts, line_ends, line_rows = ts.word_bounds(raw, at, _not_line)
        full = np.searchsorted(self.starts, line_ends) > np.searchsorted(self.starts, line_starts)
        line_starts, line_ends, line_rows = line_starts[full], line_ends[full], line_rows[full]
        _, earlier = _repeats(line_rows, ts.span_hashes(raw, line_starts, line_ends))
        dup_lines = np.bincount(line_rows[earlier], minlength=n)
        grams, first = ts.shingles(self.hashes, self.rows, 3)
        again, _ = _repeats(self.rows[first], grams)
        covered = np.zeros(len(self.rows), bool)
        for i in range(3):
            covered[first[again] + i] = True
        return [word_chars, self.n_words, symbols, dup_lines, np.bincount(self.rows[covered], minlength=n)]

    def features(self) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """For each n-gram family: slots of all n-grams, their rows, number per row."""
        raw, n = self.raw, len(self.at) - 1
        pairs, first = ts.shingles(self.hashes, self.rows, 2)
        words = (np.concatenate([self.hashes, pairs]) >> np.uint64(48)).astype(np.int32)
        word_rows = np.concatenate([self.rows, self.rows[first]])
        byte_rows = np.repeat(np.arange(n, dtype=np.int32), np.diff(self.at))
        slots, rows = [], []
        value = np.zeros(len(raw), np.uint32)
        for k in range(4):
            value[:max(0, len(raw) - k)] += raw[k:].astype(np.uint32) << np.uint32(8 * k)
            if k >= 2:
                whole = np.flatnonzero(byte_rows[:max(0, len(raw) - k)] == byte_rows[k:])
                mixed = (value[whole] + np.uint32(k)) * np.uint32(0x9E3779B1)
                slots.append(((mixed ^ (mixed >> np.uint32(15))) * np.uint32(0x85EBCA6B) >> np.uint32(16)).astype(np.int32))
                rows.append(byte_rows[whole])
        out = []
        for s, r in ((words, word_rows), (np.concatenate(slots), np.concatenate(rows))):
            out.append((s % DIMS, r, np.bincount(r, minlength=n)))
        return out


class Model:
    """Weights of both families, and the line that turns scores into probabilities."""

    def __init__(self, weights: np.ndarray, bias: float, slope: float = 1.0, shift: float = 0.0):
        self.weights, self.bias, self.slope, self.shift = weights.astype(np.float32), bias, slope, shift

    def score(self, chunk: Scan) -> np.ndarray:
        out = np.full(len(chunk.at) - 1, self.bias)
        for f, (slots, rows, n) in enumerate(chunk.features()):
            total = np.bincount(rows, self.weights[f * DIMS + slots], len(out))
            out += SCALE * total / np.maximum(n, 1)
        return out

    def probability(self, score: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * score + self.shift, -30, 30)))


def shares(chunk: Scan) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each text: used slots and their shares, scaled."""
    parts = [[], []]
    n = len(chunk.at) - 1
    for f, (slots, rows, count) in enumerate(chunk.features()):
        key, times = np.unique(rows.astype(np.int64) * DIMS + slots, return_counts=True)
        row = key // DIMS
        value = SCALE * times / np.maximum(count[row], 1)
        edges = np.searchsorted(row, np.arange(n + 1))
        parts[f] = [((key % DIMS + f * DIMS)[a:b], value[a:b]) for a, b in zip(edges[:-1], edges[1:])]
    return [(np.concatenate([a[0], b[0]]), np.concatenate([a[1], b[1]])) for a, b in zip(*parts)]


def fit(rows: list[tuple[np.ndarray, np.ndarray]], good: np.ndarray, rounds: int = ROUNDS) -> Model:
    """Logistic regression by Adam steps over all rows but every fourth of a class, which calibrate it."""
    held = np.zeros(len(rows), bool)
    for c in (0, 1):
        held[np.flatnonzero(good == c)[3::4]] = True
    order = np.concatenate([np.flatnonzero(~held), np.flatnonzero(held)])
    n, good = int((~held).sum()), good[order]
    size = [len(rows[i][0]) for i in order]
    slots = np.concatenate([rows[i][0] for i in order])
    values = np.concatenate([rows[i][1] for i in order])
    at = np.repeat(np.arange(len(rows), dtype=np.int32), size)
    end = sum(size[:n])  # the rows that train come first
    t_slots, t_values, t_at = slots[:end], values[:end], at[:end]
    w, b = np.zeros(2 * DIMS), 0.0
    m, v, mb, vb = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0
    for t in range(1, rounds + 1):
        s = np.bincount(t_at, w[t_slots] * t_values, n) + b
        error = 1 / (1 + np.exp(-s)) - good[:n]
        g = np.bincount(t_slots, error[t_at] * t_values, 2 * DIMS) / n + DECAY * w
        gb = error.sum() / n
        rate = RATE * np.sqrt(1 - 0.999**t) / (1 - 0.9**t)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        mb, vb = 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb * gb
        w -= rate * m / (np.sqrt(v) + 1e-6)
        b -= rate * mb / (np.sqrt(vb) + 1e-6)
    s = np.bincount(at[end:] - n, w[slots[end:]] * values[end:], len(rows) - n) + b
    slope, shift = platt(s, good[n:])
    return Model(w, b, slope, shift)


def platt(score: np.ndarray, good: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the logistic curve nearest to the held-out labels (Newton steps, smoothed targets)."""
    n1, n0 = good.sum(), len(good) - good.sum()
    aim = np.where(good == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    spread = max(float(score.std()), 1e-9)
    x, a, b = score / spread, 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
        g = np.array([((p - aim) * x).sum(), (p - aim).sum()])
        q = p * (1 - p)
        h = np.array([[(q * x * x).sum(), (q * x).sum()], [(q * x).sum(), q.sum()]]) + 1e-3 * np.eye(2)
        step = np.linalg.solve(h, g)
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-9:
            break
    return a / spread, b


def train(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> Model | None:
    """Fits on at most ``per_class`` labelled rows of each class, the first ones by a hash of their id.

    ``docs`` has doc_id and text, ``labels`` doc_id and quality. Texts become slot shares in
    tasks; one task fits at most 2 * per_class rows of at most 2 * DIMS slots, and only the
    weights reach the driver.
    """
    one = labels.filter(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("quality").cast("int").alias("quality"))
    picks = None
    for c in (0, 1):
        part = one.filter(F.col("quality") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class)
        picks = part if picks is None else picks.union(part)
    picks = picks.select(F.col("doc_id").alias("l_id"), "quality")
    rows = docs.join(F.broadcast(picks), F.col("doc_id") == F.col("l_id"))  # at most 2 * per_class rows

    def vectors(batches):
        for batch in batches:
            raw, at = ts.text_bytes(batch.column(1))
            for low, high, part, offsets in ts.chunks(raw, at, CHUNK):
                made = shares(Scan(part, offsets))
                cells = [pa.array([x[i].astype(kind).tobytes() for x in made], pa.binary()) for i, kind in ((0, "<i4"), (1, "<f4"))]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(low, high - low), batch.column(2).slice(low, high - low), *cells], names=["doc_id", "quality", "slots", "shares"])

    made = text_batches(rows).select("doc_id", F.col("text").cast("string"), "quality").mapInArrow(giving_back(vectors), "doc_id long, quality int, slots binary, shares binary")

    def learn(batches):
        found = sorted((r for batch in batches for r in batch.to_pylist()), key=lambda r: (r["doc_id"], r["slots"]))
        good = np.array([r["quality"] for r in found])
        if min((good == 0).sum(), (good == 1).sum()) >= LEAST:
            model = fit([(np.frombuffer(r["slots"], "<i4"), np.frombuffer(r["shares"], "<f4")) for r in found], good)
            yield pa.RecordBatch.from_pydict({"weights": [model.weights.tobytes()], "numbers": [[model.bias, model.slope, model.shift]]})

    one = made.repartition(1).mapInArrow(giving_back(learn), "weights binary, numbers array<double>").first()
    return Model(np.frombuffer(one["weights"], np.float32), *one["numbers"]) if one else None


def judge(docs: DataFrame, text: str, model: Model | None, threshold: float = THRESHOLD) -> DataFrame:
    """(row, counts of ``RULES``, base_failed, probability, kept)."""
    shared_model = docs.sparkSession.sparkContext.broadcast(model)  # 2 * DIMS weights

    def work():
        use = shared_model.value

        def step(texts):
            raw, at = ts.text_bytes(texts)
            counts, chances = [np.zeros((5, 0), np.int64)], []
            for _, _, part, offsets in ts.chunks(raw, at, CHUNK):
                chunk = Scan(part, offsets)
                counts.append(np.array(chunk.rules()))
                chances += use.probability(use.score(chunk)).tolist() if use else [None] * (len(offsets) - 1)
            table = np.concatenate(counts, 1)
            return [pa.array(c, pa.int64()) for c in table] + [pa.array(chances, pa.float64())]

        return step

    rows = scan(docs, text, RULES + ", probability double", work)
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    kept = ~F.col("base_failed") & (F.coalesce("probability", F.lit(1.0)) >= threshold)
    return rows.withColumn("base_failed", failed).withColumn("kept", kept)
