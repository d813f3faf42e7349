"""Collocations of two and three words, mined from merged stripes.

A stripe belongs to a language and a first word. It is an associative counter of the next words,
and each of those carries the counter of the words after it, so one structure gives the counts
of two words (a prefix's total, pieces that end there included), of their extensions to three
words, and the largest extension. Tasks make stripes of blocks of text; equal keys meet by a
shuffle and are merged elementwise; a merged stripe is a stripe again, so a task that has read
many of one key merges them and goes on.

Stripes of very frequent first words are cut into segments by a hash of the next word. A word
gets segments in proportion to its share of all occurrences once that share is over
1 / ``parts``, so at most ``parts`` words are cut, and that bounds the table that tasks get.

Words are counted in a pass of their own, for the totals and the cuts. Null texts are empty, a
null language is ``und``; pieces without words give nothing, repeated rows count as often as
they are there, and an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dayspan.llm import shared
from dayspan.llm import textscan as ts
from dayspan.session import shuffle_width

BLOCK_WORDS = 1_000_000  # occurrences in a block of stripes; below 2^21 - 2
MERGE_ENTRIES = 400_000  # counters that a task merges at once
PARTS_PER_SLICE = 16
LEAST, COVERED, TOP = 10, 50, 2000
UNKNOWN = "und"
SCALE = 1_000_000
RANK_SALTS = 16

# fixed values: signs that end a piece, and what parts words inside one
ENDS = np.zeros(256, bool)
ENDS[[ord(c) for c in ".,;:!?"] + [0x0A, 0x0B, 0x0C, 0x0D]] = True
BLANKS = np.zeros(256, bool)
BLANKS[[0x20, 0x09]] = True
BETWEEN = ENDS | BLANKS
ONE_BLANK = np.zeros(256, bool)
ONE_BLANK[0x20] = True


def byte_strings(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The spans of ``raw`` as an array of byte strings."""
    size = ends - starts
    offset = np.concatenate([[0], np.cumsum(size)])
    places = np.arange(offset[-1]) + np.repeat(starts - offset[:-1], size)
    return pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offset.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(raw[places]))])


def tokens(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, rows, piece) of the words of a chunk; words of one piece have one number."""
    starts, ends, rows = ts.word_bounds(raw, at, BETWEEN)
    stops = np.concatenate([[0], np.cumsum(ENDS[raw])])
    return starts, ends, rows, stops[starts] + rows


def coded(words: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Codes of equal strings, and the distinct strings."""
    found = words.dictionary_encode()
    return np.asarray(found.indices).astype(np.int64), found.dictionary


def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(bytes, starts, ends, language codes, languages, piece, number of words that begin here) of at most ``BLOCK_WORDS`` words.

    Two more words may follow those that begin in the block: they are looked at only.
    """
    for batch in batches:
        raw, at = ts.text_bytes(batch.column(1))
        lang, langs = coded(batch.column(0).cast(pa.large_binary()).fill_null(UNKNOWN.encode()))
        for low, _, part, offsets in ts.chunks(raw, at, 3 * ts.CHUNK):
            part = ts.LOWER[part]
            starts, ends, rows, piece = tokens(part, offsets)
            for a in range(0, len(starts), BLOCK_WORDS):
                b = min(a + BLOCK_WORDS, len(starts))
                seen = slice(a, min(b + 2, len(starts)))
                yield part, starts[seen], ends[seen], lang[low + rows[seen]], langs, piece[seen], b - a


def word_totals(docs: DataFrame) -> DataFrame:
    """(lang, word, n) of documents (lang, text); words and languages in UTF-8 bytes."""

    def count(batches):
        for part, starts, ends, lang, langs, _, n in blocks(batches):
            code, words = coded(byte_strings(part, starts[:n], ends[:n]))
            key, times = np.unique(lang[:n] * len(words) + code, return_counts=True)
            cells = [langs.take(pa.array(key // len(words))), words.take(pa.array(key % len(words)))]
            yield pa.RecordBatch.from_arrays([c.cast(pa.binary()) for c in cells] + [pa.array(times)], names=["lang", "word", "n"])

    return docs.mapInArrow(shared.giving_back(count), "lang binary, word binary, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))


def segments(totals: DataFrame, parts: int) -> dict[tuple[bytes, bytes], int]:
    """Number of segments of the first words that have over 1 / ``parts`` of all occurrences: fewer than ``parts``."""
    all_words = totals.agg(F.sum("n")).first()[0] or 0
    share = max(1.0, all_words / parts)
    large = totals.filter(F.col("n") > share).collect()
    return {(bytes(r["lang"]), bytes(r["word"])): int(r["n"] / share) + 1 for r in large}


def block_stripes(part: np.ndarray, starts: np.ndarray, ends: np.ndarray, lang: np.ndarray, langs: pa.Array, piece: np.ndarray, n: int, cuts: dict) -> pa.RecordBatch:
    """Stripes of a block: rows (lang, first, segment, nexts, thirds, counts)."""
    code, words = coded(byte_strings(part, starts, ends))
    keys, own = np.unique(lang * len(words) + code, return_inverse=True)
    same1 = np.flatnonzero(piece[:n][:len(piece) - 1] == piece[1:n + 1])  # a next word in the piece
    third = np.zeros(len(same1), np.int64)
    inside = np.flatnonzero(same1 + 2 < len(piece))
    more = inside[piece[same1[inside] + 2] == piece[same1[inside]]]
    third[more] = own[same1[more] + 2] + 1
    packed, times = np.unique((own[same1].astype(np.int64) << 42) | (own[same1 + 1].astype(np.int64) << 21) | third, return_counts=True)
    one, two, three = packed >> 42, (packed >> 21) & 0x1FFFFF, packed & 0x1FFFFF
    many = np.ones(len(keys), np.int64)
    if cuts:
        of_lang, of_word = (pc.index_in(pa.array([c[i] for c in cuts], pa.large_binary()), value_set=values) for i, values in enumerate((langs, words)))
        there = np.flatnonzero(np.asarray(of_lang.is_valid()) & np.asarray(of_word.is_valid()))
        key = np.asarray(of_lang.fill_null(0))[there].astype(np.int64) * len(words) + np.asarray(of_word.fill_null(0))[there]
        place = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
        real = keys[place] == key
        many[place[real]] = np.array(list(cuts.values()))[there[real]]
    segment = np.zeros(len(packed), np.int64)
    cut = np.flatnonzero(many[one] > 1)
    if len(cut):
        used, where = np.unique(keys[two[cut]] % len(words), return_inverse=True)
        chosen = words.take(pa.array(used))
        at = np.frombuffer(chosen.buffers()[1], np.int64, len(chosen) + 1, chosen.offset * 8)
        text = np.frombuffer(chosen.buffers()[2], np.uint8)
        hashes = ts.span_hashes(text[at[0]:at[-1]], at[:-1] - at[0], at[1:] - at[0])
        segment[cut] = (hashes[where] % many[one[cut]].astype(np.uint64)).astype(np.int64)
        order = np.lexsort((segment, one))  # stable: next and third words stay in order
        one, two, three, times, segment = (x[order] for x in (one, two, three, times, segment))
    name = lambda k: words.take(pa.array(keys[k] % len(words)))
    return packed_rows(langs.take(pa.array(keys[one] // len(words))), name(one), segment, one, two, three > 0, name(two), name(np.maximum(three - 1, 0)), times)


def packed_rows(lang: pa.Array, first: pa.Array, segment: np.ndarray, one: np.ndarray, two: np.ndarray, real: np.ndarray, next_word: pa.Array, third_word: pa.Array, times: np.ndarray) -> pa.RecordBatch:
    """Sorted counters as stripes, one row for each key.

    ``nexts`` has the next words and ``thirds`` the third words, parted by blanks; ``counts`` has
    for each next word its own count and its number of third words, then the counts of those.
    """
    if not len(one):
        return pa.RecordBatch.from_arrays([pa.array([], t) for t in STRIPE.types], schema=STRIPE)
    new_row = np.concatenate([[True], (one[1:] != one[:-1]) | (segment[1:] != segment[:-1])])
    new_two = new_row | np.concatenate([[True], two[1:] != two[:-1]])
    row, group = np.flatnonzero(new_row), np.flatnonzero(new_two)
    total = np.add.reduceat(times, group)
    n_third = np.add.reduceat(real.astype(np.int64), group)
    of_group, of_third = np.searchsorted(row, group, "right") - 1, np.searchsorted(row, np.flatnonzero(real), "right") - 1
    nexts = joined(next_word.take(pa.array(group)), of_group, len(row))
    thirds = joined(third_word.filter(pa.array(real)), of_third, len(row))
    numbers = np.concatenate([total, n_third, times[real]])
    # row by row: its totals, its numbers of third words, its counts of third words
    place = np.lexsort((np.concatenate([np.full(len(total), 0), np.full(len(total), 1), np.full(len(of_third), 2)]), np.concatenate([of_group, of_group, of_third])))
    size = 2 * np.bincount(of_group, minlength=len(row)) + np.bincount(of_third, minlength=len(row))
    offset = np.concatenate([[0], np.cumsum(8 * size)])
    counts = pa.Array.from_buffers(pa.large_binary(), len(row), [None, pa.py_buffer(offset.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(numbers[place].astype("<i8")))])
    cells = [lang.take(pa.array(row)), first.take(pa.array(row)), pa.array(segment[row]), nexts, thirds, counts]
    return pa.RecordBatch.from_arrays([c.cast(t) for c, t in zip(cells, STRIPE.types)], schema=STRIPE)


STRIPE = pa.schema([("lang", pa.binary()), ("first", pa.binary()), ("segment", pa.int64()), ("nexts", pa.binary()), ("thirds", pa.binary()), ("counts", pa.binary())])
STRIPE_COLUMNS = "lang binary, first binary, segment long, nexts binary, thirds binary, counts binary"


def joined(words: pa.Array, row: np.ndarray, n: int) -> pa.Array:
    """The words of each row in one byte string, a blank after each."""
    at = np.frombuffer(words.buffers()[1], np.int64, len(words) + 1, words.offset * 8)
    text = np.frombuffer(words.buffers()[2], np.uint8)[at[0]:at[-1]] if len(words) and at[-1] > at[0] else np.zeros(0, np.uint8)
    size = np.diff(at)
    out = np.full(len(text) + len(words), 0x20, np.uint8)
    out[np.arange(len(text)) + np.repeat(np.arange(len(words)), size)] = text
    offset = np.concatenate([[0], np.cumsum(np.bincount(row, size + 1, n).astype(np.int64))]) if len(words) else np.zeros(n + 1, np.int64)
    return pa.Array.from_buffers(pa.large_binary(), n, [None, pa.py_buffer(offset.astype(np.int64)), pa.py_buffer(out)])


class Counters:
    """Rows of stripes, read and merged elementwise: all (key, next word, third word) with their counts."""

    def __init__(self, table: pa.Table):
        table = table.combine_chunks()
        column = lambda name: table.column(name).chunk(0)
        self.lang, self.first, self.segment = column("lang"), column("first"), np.asarray(column("segment"))
        lang, first = column("lang").dictionary_encode().indices.to_numpy(), column("first").dictionary_encode().indices.to_numpy()
        new = np.concatenate([[True], (lang[1:] != lang[:-1]) | (first[1:] != first[:-1]) | (self.segment[1:] != self.segment[:-1])])
        self.key_row = np.flatnonzero(new)
        key = np.cumsum(new) - 1
        parts = []
        for name in ("nexts", "thirds"):
            raw, at = ts.text_bytes(column(name))
            starts, ends, rows = ts.word_bounds(raw, at, ONE_BLANK)
            parts.append((byte_strings(raw, starts, ends), rows))
        (nexts, row2), (thirds, row3) = parts
        code, self.words = coded(pa.chunked_array([nexts, thirds]).combine_chunks())
        two, three = code[:len(row2)], code[len(row2):]
        numbers = np.frombuffer(ts.text_bytes(column("counts"))[0].tobytes(), "<i8")
        n2, n3 = np.bincount(row2, minlength=len(table)), np.bincount(row3, minlength=len(table))
        begin = np.cumsum(2 * n2 + n3) - (2 * n2 + n3)
        place2 = np.arange(len(row2)) - np.repeat(np.cumsum(n2) - n2, n2)
        total, of = numbers[begin[row2] + place2], numbers[begin[row2] + n2[row2] + place2]
        place3 = np.arange(len(row3)) - np.repeat(np.cumsum(n3) - n3, n3)
        times = numbers[begin[row3] + 2 * n2[row3] + place3]
        # pairs of words, then triples
        size = max(1, len(self.words))
        self.pair, at_pair = np.unique(key[row2] * size + two, return_inverse=True)
        self.total = np.zeros(len(self.pair), np.int64)
        np.add.at(self.total, at_pair, total)
        parent = np.repeat(at_pair, of)
        self.triple, at_triple = np.unique(parent * size + three, return_inverse=True)
        self.times = np.zeros(len(self.triple), np.int64)
        np.add.at(self.times, at_triple, times)
        self.key, self.two = self.pair // size, self.pair % size
        self.parent, self.three = self.triple // size, self.triple % size

    def stripes(self) -> pa.Table:
        """The merged stripes in rows again."""
        real = np.bincount(self.parent, self.times, len(self.pair)).astype(np.int64)
        ended = np.flatnonzero(self.total > real)
        # a counter for pieces that end after the next word has no third word
        owner = np.concatenate([ended, self.parent])
        three = np.concatenate([np.zeros(len(ended), np.int64), self.three + 1])
        times = np.concatenate([(self.total - real)[ended], self.times])
        order = np.lexsort((three, owner))
        owner, three, times = owner[order], three[order], times[order]
        key = self.key_row[self.key[owner]]
        take = lambda words, at: words.take(pa.array(at))
        return pa.Table.from_batches([packed_rows(take(self.lang, key), take(self.first, key), self.segment[key], key, self.two[owner], three > 0, take(self.words, self.two[owner]), take(self.words, np.maximum(three - 1, 0)), times)])

    def candidates(self, least: int) -> pa.RecordBatch:
        """(lang, w1, w2, w3 or null, a, longest): two and three words of ``least`` occurrences, with a pair's largest extension."""
        longest = np.zeros(len(self.pair), np.int64)
        np.maximum.at(longest, self.parent, self.times)
        pair, triple = np.flatnonzero(self.total >= least), np.flatnonzero(self.times >= least)
        owner = np.concatenate([pair, self.parent[triple]])
        key = self.key_row[self.key[owner]]
        third = pa.array(np.concatenate([np.zeros(len(pair), np.int64), self.three[triple]]), mask=np.arange(len(owner)) < len(pair))
        cells = [self.lang.take(pa.array(key)), self.first.take(pa.array(key)), self.words.take(pa.array(self.two[owner])).cast(pa.binary()), self.words.take(third).cast(pa.binary())]
        numbers = [np.concatenate([self.total[pair], self.times[triple]]), np.concatenate([longest[pair], np.zeros(len(triple), np.int64)])]
        return pa.RecordBatch.from_arrays(cells + [pa.array(x) for x in numbers], names=["lang", "w1", "w2", "w3", "a", "longest"])


def frequent(docs: DataFrame, cuts: dict, least: int = LEAST) -> DataFrame:
    """(lang, w1, w2, w3, a, longest) of all phrases of two and three words with ``least`` occurrences."""
    given = docs.sparkSession.sparkContext.broadcast(cuts)

    def make(batches):
        for block in blocks(batches):
            yield block_stripes(*block, given.value)

    def merge(batches):
        def last_key(table):
            """First row of the last key; rows are sorted."""
            same = np.ones(len(table), bool)
            for name in ("lang", "first", "segment"):
                column = table.column(name)
                same &= np.asarray(pc.equal(column, column[len(table) - 1]).combine_chunks())
            return int(same.argmax())

        def entries(batch):
            return sum(b.size for b in batch.column(5).buffers() if b is not None) // 16

        held, size, limit = [], 0, MERGE_ENTRIES
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                size += entries(batch)
            if size >= limit:
                table = pa.Table.from_batches(held)
                cut = last_key(table)
                if cut:
                    yield Counters(table.slice(0, cut)).candidates(least)
                rest = Counters(table.slice(cut)).stripes()
                held = rest.to_batches()
                size = sum(map(entries, held))
                limit = max(MERGE_ENTRIES, 2 * size)
        if held:
            yield Counters(pa.Table.from_batches(held)).candidates(least)

    rows = docs.mapInArrow(shared.giving_back(make), STRIPE_COLUMNS)
    dealt = rows.repartition("lang", "first", "segment").sortWithinPartitions("lang", "first", "segment")
    return dealt.mapInArrow(shared.giving_back(merge), "lang binary, w1 binary, w2 binary, w3 binary, a long, longest long")


def best_cut(found: DataFrame, totals: DataFrame) -> DataFrame:
    """(lang, phrase, a, l, r, score) of phrases that no longer one covers."""
    found = found.select("lang", "w1", "w2", "w3", "a", "longest")
    pairs = found.filter("w3 is null").drop("w3")
    triples = found.filter("w3 is not null").drop("longest")
    word = lambda name, n: totals.select(F.col("lang").alias(f"{n}_lang"), F.col("word").alias(name), F.col("n").alias(n))

    def with_count(rows, name, column, n):
        one = word(name + "_word", n)
        return rows.join(one, (F.col("lang") == F.col(f"{n}_lang")) & (F.col(column) == F.col(name + "_word"))).drop(f"{n}_lang", name + "_word")

    after = triples.groupBy("lang", F.col("w2").alias("x1"), F.col("w3").alias("x2")).agg(F.max("a").alias("before")).withColumnRenamed("lang", "x_lang")
    rows = pairs.join(after, (F.col("lang") == F.col("x_lang")) & (F.col("w1") == F.col("x1")) & (F.col("w2") == F.col("x2")), "left")
    longest = F.greatest(F.when(F.col("longest") >= LEAST, F.col("longest")), F.col("before"), F.lit(0))
    rows = rows.filter(100 * longest < COVERED * F.col("a"))
    two = with_count(with_count(rows, "l", "w1", "l"), "r", "w2", "r")
    two = two.select("lang", F.concat("w1", F.lit(b" "), "w2").alias("phrase"), "a", "l", "r", score("l", "r").alias("score"))
    # three words: one word and two, or two and one
    known = pairs.select(F.col("lang").alias("p_lang"), F.col("w1").alias("p1"), F.col("w2").alias("p2"), F.col("a").alias("p_a"))
    three = triples
    for name, c1, c2 in (("l2", "w1", "w2"), ("r1", "w2", "w3")):
        part = known.select(*[F.col(c).alias(f"{name}_{c}") for c in ("p_lang", "p1", "p2")], F.col("p_a").alias(name))
        on = (F.col("lang") == F.col(f"{name}_p_lang")) & (F.col(c1) == F.col(f"{name}_p1")) & (F.col(c2) == F.col(f"{name}_p2"))
        three = three.join(part, on).drop(*[f"{name}_{c}" for c in ("p_lang", "p1", "p2")])
    three = with_count(with_count(three, "l", "w1", "l1"), "r", "w3", "r2").withColumn("s1", score("l1", "r1")).withColumn("s2", score("l2", "r2"))
    first = F.col("s1") <= F.col("s2")
    three = three.select(
        "lang", F.concat("w1", F.lit(b" "), "w2", F.lit(b" "), "w3").alias("phrase"), "a", F.when(first, F.col("l1")).otherwise(F.col("l2")).alias("l"),
        F.when(first, F.col("r1")).otherwise(F.col("r2")).alias("r"), F.least("s1", "s2").alias("score"))
    return two.union(three)


def score(left: str, right: str):
    """floor(SCALE * a * a / (left * right)) in whole numbers of up to 38 digits."""
    wide = lambda c: F.col(c).cast("decimal(19,0)")
    top, under = F.lit(SCALE).cast("decimal(7,0)") * (wide("a") * wide("a")), wide(left) * wide(right)
    return F.call_function("div", top, under).cast("long")


def mined(docs: DataFrame, top: int = TOP) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's first ``top`` phrases."""
    texts = shared.text_batches(docs.select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text")))
    totals = shared.stored(word_totals(texts), "word-totals")
    cuts = segments(totals, PARTS_PER_SLICE * shuffle_width(docs))
    found = shared.stored(frequent(texts, cuts), "frequent-phrases")
    scored = best_cut(found, totals)
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    salted = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(RANK_SALTS))).orderBy(*order)
    near_top = scored.withColumn("place", F.row_number().over(salted)).filter(F.col("place") <= top).drop("place")
    ranked = near_top.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).filter(F.col("rank") <= top)
    sums = totals.groupBy(F.col("lang").alias("n_lang")).agg(F.sum("n").alias("n"))
    rows = ranked.join(sums, F.col("lang") == F.col("n_lang"))
    text = lambda c: F.decode(F.col(c), "UTF-8").alias(c)
    return rows.select(text("lang"), "rank", text("phrase"), "a", "l", "r", "n", "score")
