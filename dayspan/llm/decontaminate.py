"""Benchmark passages in documents, by a prefix-filtered join on rare shingles.

Texts are lower-cased (A-Z) and cut into words of letters, digits and non-ASCII characters.
A window is ``WINDOW`` neighbouring words of an item, or all words of a shorter item. A
document holds a window only if it holds every shingle of it, so one shingle per window is
enough to find all candidates: the rarest one over all documents, counted in a first pass.
In the second pass a document's shingles are joined with those prefix shingles; a candidate's
place must leave room for the whole window inside the text, and its words are then compared
one by one, by hash and by bytes.

The benchmark goes to the tasks in blocks of about ``BLOCK_WORDS`` words (an item is not
split); more blocks mean more passes, the result is the same. Null texts have no words; equal
items and equal ids count once, a null id is written as an empty string; an empty benchmark
or table gives rows without hits or no rows. Documents are not shuffled.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dayspan.llm import shared
from dayspan.llm import textscan as ts
from dayspan.llm.rowscan import scan

WINDOW, SHINGLE = 10, 3
BLOCK_WORDS = 2_000_000
APART = np.ones(256, bool)
APART[48:58] = APART[97:123] = APART[128:] = False
FILTER_BITS = 20
WORDS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def word_scan(raw: np.ndarray, at: np.ndarray):
    """Lower-cased bytes, word starts, ends, rows and hashes of a chunk."""
    low = ts.LOWER[raw]
    starts, ends, rows = ts.word_bounds(low, at, APART)
    return low, starts, ends, rows, ts.span_hashes(low, starts, ends)


class Windows:
    """All distinct windows of a block of items, with the items that hold them."""

    def __init__(self, ids: list[str], texts: list[str | None], window: int = WINDOW, shingle: int = SHINGLE):
        raw, at = ts.text_bytes(pa.array(texts, pa.string()))
        low, starts, ends, rows, hashes = word_scan(raw, at)
        counts = np.bincount(rows, minlength=len(texts))
        first = np.cumsum(counts) - counts
        known: dict[bytes, int] = {}
        self.words, self.texts, self.items = [], [], []
        for i, n in enumerate(counts.tolist()):
            for s in range(first[i], first[i] + (n - window + 1 if n > window else min(n, 1))):
                e = s + min(n, window)
                text = b" ".join(low[starts[j]:ends[j]].tobytes() for j in range(s, e))
                w = known.setdefault(text, len(known))
                if w == len(self.words):
                    self.words.append(hashes[s:e])
                    self.texts.append(text)
                    self.items.append(set())
                self.items[w].add(ids[i])
        self.items = [sorted(x) for x in self.items]
        # shingles of every window: (window, offset, size of the shingle, hash)
        found = []
        for w, words in enumerate(self.words):
            k = min(shingle, len(words))
            h = ts.shingles(words, np.zeros(len(words), np.int64), k)[0]
            found += [(w, o, k, x) for o, x in enumerate(h)]
        self.window_of = np.array([x[0] for x in found], np.int64)
        self.offset_of = np.array([x[1] for x in found], np.int64)
        self.size_of = np.array([x[2] for x in found], np.int64)
        self.hash_of = np.array([x[3] for x in found], np.uint64)

    def prefixes(self, counts: dict[int, int]) -> "Prefixes":
        """The rarest shingle of each window; windows with one that no document has are out."""
        n = np.array([counts.get(int(h), 0) for h in self.hash_of.view(np.int64)], np.int64)
        order = np.lexsort((self.offset_of, self.hash_of, n, self.window_of))
        order = order[np.concatenate([[True], np.diff(self.window_of[order]) > 0])] if len(order) else order
        order = order[n[order] > 0]
        order = order[np.lexsort((self.window_of[order], self.hash_of[order]))]
        return Prefixes(self, order)


class Lookup:
    """Membership of hashes in a sorted list, a bit table first."""

    def __init__(self, hashes: np.ndarray):
        self.sorted = np.unique(hashes)
        self.bits = np.zeros(1 << FILTER_BITS, bool)
        self.bits[self._slot(self.sorted)] = True

    @staticmethod
    def _slot(hashes: np.ndarray) -> np.ndarray:
        return (hashes >> np.uint64(64 - FILTER_BITS)).astype(np.int64)

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places in ``hashes`` that are members, and which members they are."""
        maybe = np.flatnonzero(self.bits[self._slot(hashes)])
        if not len(maybe) or not len(self.sorted):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        which = np.minimum(np.searchsorted(self.sorted, hashes[maybe]), len(self.sorted) - 1)
        right = self.sorted[which] == hashes[maybe]
        return maybe[right], which[right]


class Prefixes:
    """Prefix shingles of a block, each with its windows and offsets; ``order`` is sorted by hash."""

    def __init__(self, windows: Windows, order: np.ndarray):
        self.windows = windows
        self.by_size = {}
        for k in np.unique(windows.size_of[order]).tolist():
            rows = order[windows.size_of[order] == k]
            look = Lookup(windows.hash_of[rows])
            begin = np.searchsorted(windows.hash_of[rows], look.sorted, "left")
            end = np.searchsorted(windows.hash_of[rows], look.sorted, "right")
            self.by_size[k] = (look, begin, end, windows.window_of[rows], windows.offset_of[rows])
        self.sizes = np.array([len(w) for w in windows.words], np.int64)
        self.matrix = np.zeros((len(self.sizes), max(self.sizes, default=1)), np.uint64)
        for w, words in enumerate(windows.words):
            self.matrix[w, :len(words)] = words

    def hits(self, low, starts, ends, rows, hashes) -> list[tuple[int, int]]:
        """(first word, window) of all windows that occur in the texts of a chunk."""
        found = []
        for k, (look, begin, end, window_of, offset_of) in self.by_size.items():
            values, firsts = ts.shingles(hashes, rows, k)
            place, which = look.find(values)
            n = end[which] - begin[which]
            pick = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + np.repeat(begin[which], n)
            w = window_of[pick]
            s = np.repeat(firsts[place], n) - offset_of[pick]
            last = s + self.sizes[w] - 1
            fits = (s >= 0) & (last < len(rows))
            s, w, last = s[fits], w[fits], last[fits]
            fits = rows[s] == rows[last]
            s, w = s[fits], w[fits]
            for j in range(self.matrix.shape[1]):
                inside = self.sizes[w] > j
                same = ~inside | (hashes[np.minimum(s + j, len(hashes) - 1)] == self.matrix[w, j])
                s, w = s[same], w[same]
            found += zip(s.tolist(), w.tolist())
        texts, sizes = self.windows.texts, self.sizes
        return [(s, w) for s, w in found if b" ".join(low[starts[j]:ends[j]].tobytes() for j in range(s, s + int(sizes[w]))) == texts[w]]


def shingle_counts(docs: DataFrame, text: str, windows) -> DataFrame:
    """(hash, n): in how many documents each shingle of the block occurs; ``windows`` is a broadcast."""

    def count(batches):
        block = windows.value
        looks = {k: Lookup(block.hash_of[block.size_of == k]) for k in np.unique(block.size_of).tolist()}
        total = {k: np.zeros(len(look.sorted), np.int64) for k, look in looks.items()}
        for batch in batches:
            raw, at = ts.text_bytes(batch.column(0))
            for _, _, part, offsets in ts.chunks(raw, at):
                _, _, _, rows, hashes = word_scan(part, offsets)
                for k, look in looks.items():
                    values, firsts = ts.shingles(hashes, rows, k)
                    place, which = look.find(values)
                    once = np.unique(rows[firsts[place]] * len(look.sorted) + which)
                    total[k] += np.bincount(once % max(1, len(look.sorted)), minlength=len(look.sorted))
        for k, look in looks.items():
            seen = total[k] > 0
            yield pa.RecordBatch.from_arrays([pa.array(look.sorted[seen].view(np.int64)), pa.array(total[k][seen])], names=["hash", "n"])

    return shared.text_batches(docs).select(F.col(text).cast("string")).mapInArrow(shared.giving_back(count), "hash long, n long").groupBy("hash").agg(F.sum("n").alias("n"))


def blocks(benchmark: DataFrame, item: str, text: str, limit: int) -> list[tuple[list[str], list[str | None]]]:
    """Items in blocks of about ``limit`` words by a hash, one at a time on the driver."""
    rows = benchmark.select(F.coalesce(F.col(item).cast("string"), F.lit("")).alias("item"), F.col(text).cast("string").alias("text")).distinct()
    words = F.coalesce(F.regexp_count("text", F.lit(WORDS)), F.lit(0))
    total, longest = rows.agg(F.sum(words), F.max(words)).first()
    n = -(-int(total or 0) // max(1, limit - int(longest or 0), limit // 2))
    if n > 1:
        rows = shared.stored(rows.withColumn("block", F.pmod(F.xxhash64("item", "text"), F.lit(n))), "benchmark-blocks")
        return (_collected(rows.filter(F.col("block") == i)) for i in range(n))
    return (_collected(rows) for _ in range(1 if total else 0))


def _collected(rows: DataFrame) -> tuple[list[str], list[str | None]]:
    found = sorted(map(tuple, rows.select("item", "text").collect()), key=lambda r: (r[0], r[1] or ""))
    return [r[0] for r in found], [r[1] for r in found]


def find(docs: DataFrame, text: str, benchmark: DataFrame, item: str, item_text: str, window: int = WINDOW, limit: int = BLOCK_WORDS) -> DataFrame:
    """(row, n_words, n_hit, spans, items): ``row`` holds the document's columns, ``spans`` the merged
    (first word, end word) of all occurrences, ``items`` the ids of the items that occur, sorted."""
    spark = docs.sparkSession
    blank = pa.struct([("first", pa.int64()), ("end", pa.int64())])

    def plain():
        def step(texts):
            raw, at = ts.text_bytes(texts)
            n = np.concatenate([np.zeros(0, np.int64)] + [np.bincount(ts.word_bounds(ts.LOWER[p], o, APART)[2], minlength=b - a) for a, b, p, o in ts.chunks(raw, at)])
            return [pa.array(n, pa.int64()), pa.array([[]] * len(n), pa.list_(blank)), pa.array([[]] * len(n), pa.list_(pa.string()))]
        return step

    def matching(shared_prefixes):
        def work():
            prefixes = shared_prefixes.value

            def step(texts):
                raw, at = ts.text_bytes(texts)
                words, spans, items = [], [], []
                for a, b, part, offsets in ts.chunks(raw, at):
                    low, starts, ends, rows, hashes = word_scan(part, offsets)
                    n = np.bincount(rows, minlength=b - a)
                    first = np.cumsum(n) - n
                    own_spans, own_items = [[] for _ in range(b - a)], [set() for _ in range(b - a)]
                    for s, w in sorted(prefixes.hits(low, starts, ends, rows, hashes)):
                        r = int(rows[s])
                        begin = s - int(first[r])
                        end = begin + int(prefixes.sizes[w])
                        if own_spans[r] and begin <= own_spans[r][-1]["end"]:
                            own_spans[r][-1]["end"] = max(own_spans[r][-1]["end"], end)
                        else:
                            own_spans[r].append({"first": begin, "end": end})
                        own_items[r].update(prefixes.windows.items[w])
                    words.append(n)
                    spans += own_spans
                    items += [sorted(x) for x in own_items]
                return [pa.array(np.concatenate(words) if words else [], pa.int64()), pa.array(spans, pa.list_(blank)), pa.array(items, pa.list_(pa.string()))]
            return step
        return work

    added = "n_words long, spans array<struct<first:long,end:long>>, items array<string>"
    out, n_blocks = None, 0
    for ids, texts in blocks(benchmark, item, item_text, limit):
        n_blocks += 1
        windows = Windows(ids, texts, window)
        counts = {r[0]: r[1] for r in shingle_counts(docs, text, spark.sparkContext.broadcast(windows)).collect()}  # at most the block's shingles
        work = matching(spark.sparkContext.broadcast(windows.prefixes(counts)))
        if out is None:
            out = scan(docs, text, added, work)
        else:  # carry what earlier blocks found
            flat = out.select("row.*", F.struct("n_words", "spans", "items").alias("_found"))
            out = scan(flat, text, added, work).select(
                F.struct(*[F.col(f"row.`{c}`") for c in docs.columns]).alias("row"), "n_words",
                F.concat("row._found.spans", "spans").alias("spans"), F.array_distinct(F.concat("row._found.items", "items")).alias("items"))
    if out is None:
        out = scan(docs, text, added, plain)
    if n_blocks > 1:
        out = out.withColumn("spans", _merged("spans")).withColumn("items", F.array_sort("items"))
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["first"])
    return out.select("row", "n_words", hit.alias("n_hit"), "spans", "items")


def _merged(spans: str):
    """Overlapping or touching spans joined."""
    empty = F.array().cast("array<struct<first:long,end:long>>")

    def add(done, s):
        last = F.element_at(done, -1)
        grown = F.struct(last["first"].alias("first"), F.greatest(last["end"], s["end"]).alias("end"))
        apart = F.concat(done, F.array(s))
        return F.when(F.size(done) == 0, apart).when(s["first"] <= last["end"], F.concat(F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))), F.array(grown))).otherwise(apart)

    return F.aggregate(F.array_sort(spans), empty, add)
