"""Quality classifier on learned subword vectors.

A text is the average of the vectors of its words, its pairs of neighbouring words and the
character n-grams (three to five characters, word ends marked) of its words. All of them are
hashed into two tables of slots. A softmax layer over the average gives the classes; vectors and
layer are trained together by stochastic gradient descent, one labelled text after the other with
a falling rate, in one task on a bounded sample: at most ``PER_CLASS`` rows of each class, one
row for each id.

The layer is linear in the average, so after training the difference of its two outputs is taken
for each slot once. These numbers (one for each slot) are all that leaves the task; every text is
scored whole with them, in Arrow batches, and each distinct word of a chunk is looked up once.
The log-odds of the classes among all usable labels replace those of the balanced sample.

Null texts and texts without words have no vectors: their score is that of the class odds.
Labels other than 0 and 1 and null labels or ids are not used; of an id's labels the lowest
counts, of its texts the one of the smallest digest. Without ``LEAST`` rows of both classes all
scores are 0.5. Columns of the documents stay inside ``row``; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dayspan.llm import textscan as ts
from dayspan.llm.rowscan import scan
from dayspan.llm.shared import giving_back, text_batches

CHUNK = 1 << 19
WORD_BITS, CHAR_BITS = 17, 18
WORD_SLOTS, CHAR_SLOTS = 1 << WORD_BITS, 1 << CHAR_BITS
SLOTS = WORD_SLOTS + CHAR_SLOTS
GRAMS = (3, 4, 5)
DIMENSIONS = 16
PER_CLASS, LEAST = 1500, 20
EPOCHS, RATE, SEED = 12, 2.0, 20
OPEN, CLOSE = np.uint64(0x3C), np.uint64(0x3E)
_P = np.uint64(0x100000001B3)


def subword_slots(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Slots of the words in ``raw`` and of their character n-grams, with the words they belong to."""
    n = len(at) - 1
    begins = (raw & 0xC0) != 0x80
    begins[at[:-1]] = True
    place = np.flatnonzero(begins)
    end = np.concatenate([place[1:], [len(raw)]])
    value = raw[place].astype(np.uint64)
    for k in range(1, 4):  # later bytes of a character
        more = place + k < end
        value[more] += raw[place[more] + k].astype(np.uint64) << np.uint64(8 * k)
    owner = np.searchsorted(at, place, "right") - 1
    chars = np.bincount(owner, minlength=n)
    first = np.cumsum(chars + 2) - (chars + 2)
    marked, word = np.empty(int((chars + 2).sum()), np.uint64), np.repeat(np.arange(n), chars + 2)
    marked[first], marked[first + chars + 1] = OPEN, CLOSE
    marked[np.arange(len(place)) + 2 * owner + 1] = value
    slots, owners = [(ts.span_hashes(raw, at[:-1], at[1:]) >> np.uint64(64 - WORD_BITS)).astype(np.int64)], [np.arange(n)]
    rolled = marked.copy()
    for k in range(2, GRAMS[-1] + 1):
        if len(marked) < k:
            break
        rolled = rolled[:len(marked) - k + 1] * _P + marked[k - 1:]
        if k in GRAMS:
            inside = np.flatnonzero(word[:len(rolled)] == word[k - 1:])
            slots.append(WORD_SLOTS + (ts.mix(rolled[inside] + np.uint64(k)) >> np.uint64(64 - CHAR_BITS)).astype(np.int64))
            owners.append(word[inside])
    return np.concatenate(slots), np.concatenate(owners)


class Texts:
    """Words of the texts of a chunk: a code each, the subwords of the distinct ones, and pairs."""

    def __init__(self, raw: np.ndarray, at: np.ndarray):
        starts, ends, self.rows = ts.word_bounds(raw, at, ts.SPACE)
        self.n = len(at) - 1
        hashes = ts.span_hashes(raw, starts, ends)
        _, one, self.code = np.unique(hashes, return_index=True, return_inverse=True)
        size = ends[one] - starts[one]
        offset = np.concatenate([[0], np.cumsum(size)]).astype(np.int64)
        letters = raw[np.arange(offset[-1]) + np.repeat(starts[one] - offset[:-1], size)]
        self.slots, self.owner = subword_slots(letters, offset) if len(one) else (np.zeros(0, np.int64),) * 2
        self.words = len(one)
        pairs, first = ts.shingles(hashes, self.rows, 2)
        self.pair_slots, self.pair_rows = (ts.mix(pairs) >> np.uint64(64 - WORD_BITS)).astype(np.int64), self.rows[first]

    def margins(self, weights: np.ndarray) -> np.ndarray:
        """Mean weight of each text's slots; 0 without any."""
        word_sum = np.bincount(self.owner, weights[self.slots], self.words)
        word_n = np.bincount(self.owner, minlength=self.words)
        total = np.bincount(self.rows, word_sum[self.code], self.n) + np.bincount(self.pair_rows, weights[self.pair_slots], self.n)
        count = np.bincount(self.rows, word_n[self.code], self.n) + np.bincount(self.pair_rows, minlength=self.n)
        return total / np.maximum(count, 1)

    def counts(self) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each text: its slots and how often each is there."""
        used, times = np.unique(self.rows * max(1, self.words) + self.code, return_counts=True)
        order = np.argsort(self.owner, kind="stable")
        slots = self.slots[order]
        many = np.bincount(self.owner, minlength=self.words)
        begin = np.cumsum(many) - many
        row, word = used // max(1, self.words), used % max(1, self.words)
        size = many[word]
        stop = np.cumsum(size)
        taken = np.arange(int(stop[-1]) if len(stop) else 0) + np.repeat(begin[word] - (stop - size), size)
        key = np.concatenate([np.repeat(row, size) * SLOTS + slots[taken], self.pair_rows * SLOTS + self.pair_slots])
        weight = np.concatenate([np.repeat(times, size), np.ones(len(self.pair_rows), np.int64)])
        key, place = np.unique(key, return_inverse=True)
        total = np.bincount(place, weight, len(key))
        edge = np.searchsorted(key, np.arange(self.n + 1) * SLOTS)
        return [(key[a:b] % SLOTS, total[a:b]) for a, b in zip(edge[:-1], edge[1:])]


def train_vectors(rows: list[tuple[np.ndarray, np.ndarray]], good: np.ndarray, epochs: int = EPOCHS, rate: float = RATE, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """(vectors, output layer) after ``epochs`` rounds of single-text gradient steps.

    Rows are (slots, times); slots of a row are distinct, so a step writes each vector once.
    """
    random = np.random.Generator(np.random.PCG64(seed))
    vectors = ((random.random((SLOTS, DIMENSIONS), dtype=np.float32) - 0.5) * np.float32(2 / DIMENSIONS))
    layer = np.zeros((2, DIMENSIONS), np.float32)
    shares = [(times / max(1.0, times.sum())).astype(np.float32) for _, times in rows]
    aims = np.eye(2, dtype=np.float32)[good.astype(int)]
    steps, total = 0, max(1, epochs * len(rows))
    for _ in range(epochs):
        for i in random.permutation(len(rows)):
            step = np.float32(rate * (1 - steps / total))
            steps += 1
            slots, share = rows[i][0], shares[i]
            if not len(slots):
                continue
            own = vectors[slots]
            mean = share @ own
            out = layer @ mean
            out = np.exp(out - out.max())
            error = out / out.sum() - aims[i]
            back = layer.T @ error
            layer -= step * np.outer(error, mean)
            vectors[slots] = own - (step * share)[:, None] * back[None, :]
    return vectors, layer


def slot_weights(vectors: np.ndarray, layer: np.ndarray) -> np.ndarray:
    """What each slot adds to the log-odds of class 1."""
    return (vectors @ (layer[1] - layer[0])).astype(np.float32)


class Model:
    """Slot weights and the log-odds that all usable labels have."""

    def __init__(self, weights: np.ndarray, odds: float):
        self.weights, self.odds = weights, odds

    def scores(self, texts: Texts) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(texts.margins(self.weights) + self.odds, -30, 30)))


def usable(labels: DataFrame, may_learn: Column | None = None) -> DataFrame:
    """(l_id, quality): one 0 or 1 for each id that may be learned from."""
    rows = labels.filter(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull())
    rows = rows if may_learn is None else rows.filter(may_learn)
    return rows.groupBy(F.col("doc_id").alias("l_id")).agg(F.min("quality").cast("int").alias("quality"))


def train(docs: DataFrame, labels: DataFrame, may_learn: Column | None = None, per_class: int = PER_CLASS) -> Model | None:
    """Fits on documents (doc_id, text) with labels (doc_id, quality) of the ids that ``may_learn`` allows.

    The first ``per_class`` ids of each class by a hash are the sample.
    """
    one = usable(labels, may_learn)
    picks = None
    for c in (0, 1):
        part = one.filter(F.col("quality") == c).orderBy(F.xxhash64("l_id"), "l_id").limit(per_class)
        picks = part if picks is None else picks.union(part)
    rows = docs.join(F.broadcast(picks), F.col("doc_id") == F.col("l_id"))  # 2 * per_class ids at most
    rows = text_batches(rows).select(F.col("l_id").cast("string").alias("id"), F.col("text").cast("string").alias("text"), "quality")

    def vectors(batches):
        for batch in batches:
            raw, at = ts.text_bytes(batch.column(1))
            for low, high, part, offsets in ts.chunks(raw, at, CHUNK):
                made = Texts(part, offsets).counts()
                cells = [pa.array([x[i].astype(kind).tobytes() for x in made], pa.binary()) for i, kind in ((0, "<i4"), (1, "<f4"))]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(low, high - low), batch.column(2).slice(low, high - low), *cells], names=["id", "quality", "slots", "times"])

    made = rows.mapInArrow(giving_back(vectors), "id string, quality int, slots binary, times binary")
    each = F.min_by(F.struct("slots", "times"), F.struct(F.xxhash64("slots", "times"), "slots")).alias("v")
    sample = made.groupBy("id", "quality").agg(each).select("id", "quality", "v.slots", "v.times")

    def learn(batches):
        found = sorted((r for batch in batches for r in batch.to_pylist()), key=lambda r: r["id"])
        good = np.array([r["quality"] for r in found])
        if min((good == 0).sum(), (good == 1).sum()) >= LEAST:
            fitted = train_vectors([(np.frombuffer(r["slots"], "<i4"), np.frombuffer(r["times"], "<f4")) for r in found], good)
            yield pa.RecordBatch.from_pydict({"weights": [slot_weights(*fitted).tobytes()], "odds": [float(np.log((good == 0).sum() / (good == 1).sum()))]})

    fitted = sample.repartition(1).mapInArrow(giving_back(learn), "weights binary, odds double").first()
    if fitted is None:
        return None
    n = one.agg(F.sum("quality"), F.count("*")).first()
    odds = float(np.log(n[0] / (n[1] - n[0])))
    return Model(np.frombuffer(fitted["weights"], np.float32), odds + fitted["odds"])


def scored(docs: DataFrame, text: str, model: Model | None) -> DataFrame:
    """(row, score): the probability of class 1 for every text."""
    given = docs.sparkSession.sparkContext.broadcast(model)  # SLOTS numbers

    def work():
        use = given.value

        def step(texts):
            raw, at = ts.text_bytes(texts)
            if use is None:
                return [pa.array(np.full(len(texts), 0.5))]
            parts = [use.scores(Texts(part, offsets)) for _, _, part, offsets in ts.chunks(raw, at, CHUNK)]
            return [pa.array(np.concatenate(parts) if parts else np.zeros(0))]

        return step

    return scan(docs, text, "score double", work)
