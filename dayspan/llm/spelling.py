"""Spelling variants: words one code point apart, found in a trie of letter-group counts.

Words are runs of ASCII and Latin-1 letters, counted over whole texts. Every word is a path in a
trie: first the counts of four coarse letter groups, then those of the finer groups. One
inserted, deleted or replaced code point changes the counts of either layer by at most one
surplus and one deficit, so a depth-first search that may spend one of each reaches all near
words; words of the leaves reached are verified letter by letter.

The upper layer is laid over the cluster: the coarse counts of a word name its node, and a word
is searched for in each node that its budget reaches. Nodes of more than ``NODE_WORDS`` words
are split by the next levels of the trie, as often as it takes, and the searches for words in
them are sent on along those levels. The search of a task walks all its words down the trie level by level, in
blocks of bounded size, and only sums leave it: per searching word the number of near words and
the most frequent of them. No table of pairs is made.

Null texts have no words; a null id counts as an empty text before the colon of the digest;
repeated rows are counted as often as they are there, and an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dayspan.llm import shared
from dayspan.llm import textscan as ts

LEAST_LETTERS, LEAST_COUNT, TIMES, DROP = 6, 5, 5, 199
HELD_WORDS = 400_000  # occurrences that a task counts before it passes the sums on
NODE_WORDS = 50_000  # words of a node of the trie that one task searches
BLOCK_ROWS = 200_000  # words and searches that a task walks down the trie at once
WIDE = 48  # longer words are compared one by one

# fixed values: letter groups, coarse and fine; accented letters belong to the last fine group
COARSE = ("ae", "iouy", "lnrst", "bcdfghjkmpqvwxz")
FINE = ("e", "t", "a", "n", "i", "o", "s", "r", "l", "d", "ch", "um", "pg", "bfv", "jkqwxyz")
UPPER_LEVELS = len(COARSE)
ACCENTED = np.arange(0xC0, 0x100)


def _levels() -> np.ndarray:
    """256 x levels: which counts a code point adds to."""
    table = np.zeros((256, UPPER_LEVELS + len(FINE) + 1), np.int32)
    for base, groups in ((0, COARSE), (UPPER_LEVELS, FINE)):
        for i, letters in enumerate(groups):
            table[[ord(c) for c in letters], base + i] = 1
    table[ACCENTED, ACCENTED % UPPER_LEVELS] = 1
    table[ACCENTED, -1] = 1
    return table


LEVELS = _levels()
N_LEVELS = LEVELS.shape[1]
STEPS = (UPPER_LEVELS, UPPER_LEVELS + 5, UPPER_LEVELS + 10, N_LEVELS)  # depths at which nodes are cut


def _crc_table() -> np.ndarray:
    """Remainders of the reversed polynomial 0xEDB88320 for all bytes."""
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> 1) ^ np.uint32(0xEDB88320), t >> 1)
    return t


CRC = _crc_table()
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True


def crc32_on(start: np.ndarray, raw: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """crc32 of bytes raw[begin:end], each carried on from a crc32 of what stands before."""
    order = np.argsort(begin - end, kind="stable")
    state, at, size = ~start[order].astype(np.uint32), begin[order], (end - begin)[order]
    left, k = len(order), 0
    while left:
        left = int(np.searchsorted(-size, -k, "left"))  # spans longer than k
        if left:
            state[:left] = CRC[(state[:left] ^ raw[at[:left] + k]) & np.uint32(255)] ^ (state[:left] >> np.uint32(8))
        k += 1
    out = np.empty(len(order), np.uint32)
    out[order] = ~state
    return out


def letter_runs(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and rows of the runs of letters of a chunk."""
    letter = _LETTER[raw]
    lead = np.flatnonzero(raw == 0xC3)  # U+00C0 to U+00FF and no others
    letter[lead] = letter[np.minimum(lead + 1, len(raw) - 1)] = True
    gap = np.where(letter, np.uint8(1), np.uint8(0))
    return ts.word_bounds(gap, at, np.array([True, False] + [False] * 254))


def chunk_words(raw: np.ndarray, at: np.ndarray, ids: list) -> pa.Array:
    """The words of a chunk of texts, as often as they occur, in Latin-1 bytes; ids: per row as text."""
    low = ts.LOWER[raw]
    starts, ends, rows = letter_runs(low, at)
    two = np.concatenate([[0], np.cumsum(low == 0xC3)])
    letters = ends - starts - (two[ends] - two[starts])
    long = letters >= LEAST_LETTERS
    starts, ends, rows, letters = starts[long], ends[long], rows[long], letters[long]
    prefix = np.array([zlib.crc32(f"{'' if i is None else i}:".encode()) for i in ids], np.uint32)
    h = crc32_on(prefix[rows], low, starts, ends).astype(np.int64)
    # one byte a letter: the byte before a later byte goes, and that is moved up by 64
    keep = ts_spans(starts, ends)
    taken = low[keep]
    lead = taken == 0xC3
    single = taken.copy()
    single[1:][lead[:-1]] += 0x40
    single = single[~lead]
    offset = np.concatenate([[0], np.cumsum(letters)])
    hit = np.flatnonzero(h % DROP == 0)
    gone = offset[hit] + h[hit] % letters[hit]
    single = np.delete(single, gone)
    letters[hit] -= 1
    offset = np.concatenate([[0], np.cumsum(letters)])
    words = pa.Array.from_buffers(pa.large_binary(), len(letters), [None, pa.py_buffer(offset.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(single))])
    return words if len(hit) == 0 else words.filter(pa.array(letters >= LEAST_LETTERS))


def ts_spans(starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """All places of all spans in a row."""
    size = ends - starts
    stop = np.cumsum(size)
    return np.arange(int(stop[-1]) if len(stop) else 0) + np.repeat(starts - (stop - size), size)


def counted(docs: DataFrame, least: int = LEAST_COUNT) -> DataFrame:
    """(word binary in Latin-1, n) of documents (doc_id, text), words of at least ``least`` occurrences."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def summed(parts):
            found = pa.chunked_array(parts, pa.large_binary()).value_counts()
            return pa.RecordBatch.from_arrays([found.field("values").cast(pa.binary()), found.field("counts")], names=["word", "n"])

        held, size = [], 0
        for batch in batches:
            raw, at = ts.text_bytes(batch.column(1))
            ids = batch.column(0)
            for low, high, part, offsets in ts.chunks(raw, at):
                words = chunk_words(part, offsets, ids.slice(low, high - low).to_pylist())
                held.append(words)
                size += len(words)
                if size >= HELD_WORDS:
                    yield summed(held)
                    held, size = [], 0
        if size:
            yield summed(held)

    texts = docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return shared.text_batches(texts).mapInArrow(shared.giving_back(count), "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)


def word_counts(words: pa.Array) -> np.ndarray:
    """Words x levels: letter-group counts."""
    at = np.frombuffer(words.buffers()[1], np.int32 if pa.types.is_binary(words.type) else np.int64, len(words) + 1, words.offset * (4 if pa.types.is_binary(words.type) else 8)).astype(np.int64)
    raw = np.frombuffer(words.buffers()[2], np.uint8)[at[0]:at[-1]] if len(words) and at[-1] > at[0] else np.zeros(0, np.uint8)
    owner = np.repeat(np.arange(len(words)), np.diff(at))
    out = np.empty((len(words), N_LEVELS), np.int32)
    for level in range(N_LEVELS):
        out[:, level] = np.bincount(owner[LEVELS[raw, level] > 0], minlength=len(words))
    return out


def reached(counts: np.ndarray, budgets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All count vectors within the budgets (surplus, deficit) left: owner, vectors, budgets left."""
    n, k = counts.shape
    moves = [(np.zeros(k, np.int32), 0, 0)]
    for i in range(k):
        up, down = np.zeros(k, np.int32), np.zeros(k, np.int32)
        up[i], down[i] = 1, -1
        moves += [(up, 1, 0), (down, 0, 1)]
        moves += [(up - np.eye(k, dtype=np.int32)[j], 1, 1) for j in range(k) if j != i]
    owner, vectors, left = [], [], []
    for move, up, down in moves:
        able = np.flatnonzero((budgets[:, 0] >= up) & (budgets[:, 1] >= down))
        moved = counts[able] + move
        real = (moved >= 0).all(1)
        owner.append(able[real])
        vectors.append(moved[real])
        left.append(budgets[able[real]] - np.array([up, down]))
    return np.concatenate(owner), np.concatenate(vectors), np.concatenate(left)


def sent(rows: DataFrame, depth: int, before: int) -> DataFrame:
    """Nodes of the next ``depth - before`` levels: own ones of words, reached ones of searches.

    Rows are (node, word, n, search, up, down): ``up`` and ``down`` are the budgets left of a search.
    The first cut is that of the coarse groups; the finer groups have a budget of their own.
    """

    def send(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            at = {name: i for i, name in enumerate(batch.schema.names)}
            words = batch.column(at["word"])
            part = word_counts(words)[:, before:depth]
            search = np.asarray(batch.column(at["search"]))
            budgets = np.stack([np.asarray(batch.column(at[c])) for c in ("up", "down")], 1)
            budgets = np.where(search[:, None], budgets, 0)
            owner, vectors, left = reached(part, budgets)
            name = np.ascontiguousarray(vectors.astype("<u4")).view(np.uint8).reshape(len(vectors), -1)
            width = name.shape[1]
            tail = pa.Array.from_buffers(pa.binary(width), len(name), [None, pa.py_buffer(np.ascontiguousarray(name))]).cast(pa.binary())
            node = pc.binary_join_element_wise(batch.column(at["node"]).take(pa.array(owner)), tail, b"")
            if depth == UPPER_LEVELS:
                left = np.ones_like(left)
            cells = [node, words.take(pa.array(owner)), batch.column(at["n"]).take(pa.array(owner)), pa.array(search[owner]), pa.array(left[:, 0].astype(np.int32)), pa.array(left[:, 1].astype(np.int32))]
            yield pa.RecordBatch.from_arrays(cells, names=["node", "word", "n", "search", "up", "down"])

    return rows.mapInArrow(shared.giving_back(send), "node binary, word binary, n long, search boolean, up int, down int")


class Trie:
    """The words of some nodes under their counts, level by level."""

    def __init__(self, node: np.ndarray, counts: np.ndarray):
        order = np.lexsort((*counts.T[::-1], node))
        self.order, self.base = order, int(counts.max(initial=0)) + 3
        at, self.keys = node[order], []
        _, at = np.unique(at, return_inverse=True)
        self.roots = np.unique(node)
        for level in range(counts.shape[1]):
            key = at * self.base + counts[order, level]
            new = np.ones(len(key), bool)
            new[1:] = key[1:] != key[:-1]
            self.keys.append(key[new])
            at = np.cumsum(new) - 1
        self.first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1], [True]])) if len(at) else np.zeros(1, np.int64)

    def search(self, node: np.ndarray, counts: np.ndarray, up: np.ndarray, down: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(searching row, leaf) of all leaves within the budgets."""
        place = np.minimum(np.searchsorted(self.roots, node), len(self.roots) - 1)
        who = np.flatnonzero(self.roots[place] == node) if len(self.roots) else np.zeros(0, np.int64)
        at = place[who] if len(who) else who
        up, down = up[who], down[who]
        for level, keys in enumerate(self.keys):
            value = counts[who, level]
            parts = []
            for step in (0, 1, -1):
                able = np.arange(len(who)) if step == 0 else np.flatnonzero(up > 0) if step > 0 else np.flatnonzero((down > 0) & (value > 0))
                wanted = value[able] + step
                fits = wanted < self.base
                able, wanted = able[fits], wanted[fits]
                key = at[able] * self.base + wanted
                child = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
                real = keys[child] == key
                able = able[real]
                parts.append((who[able], child[real], up[able] - (step > 0), down[able] - (step < 0)))
            who, at, up, down = (np.concatenate(x) for x in zip(*parts))
        return who, at


def padded(words: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Letters from the left and from the right in rows of ``width``, and the lengths."""
    size = np.asarray(pc.binary_length(words)).astype(np.int64)
    left, right = np.zeros((len(words), width), np.uint8), np.zeros((len(words), width), np.uint8)
    short = np.flatnonzero(size <= width)
    raw = np.frombuffer(b"".join(words.take(pa.array(short)).to_pylist()), np.uint8)
    owner = np.repeat(short, size[short])
    begin = np.cumsum(size[short]) - size[short]
    place = np.arange(len(raw)) - np.repeat(begin, size[short])
    left[owner, place] = raw
    right[owner, size[owner] - 1 - place] = raw
    return left, right, size


def one_apart(a: bytes, b: bytes) -> bool:
    """Do two words differ by exactly one inserted, deleted or replaced letter?"""
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    least = min(len(a), len(b))
    p = next((i for i in range(least) if a[i] != b[i]), least)
    return a[p + (len(a) >= len(b)):] == b[p + (len(b) >= len(a)):]


def near_sums(words: pa.Array, n: np.ndarray, node: np.ndarray, search: np.ndarray, up: np.ndarray, down: np.ndarray, depth: int) -> pa.RecordBatch:
    """For the searches of some whole nodes: near words found, and the most frequent one."""
    counts = word_counts(words)[:, depth:]
    own, ask = np.flatnonzero(~search), np.flatnonzero(search)
    trie = Trie(node[own], counts[own])
    left, right, size = padded(words, int(min(WIDE, max(1, np.asarray(pc.binary_length(words)).max(initial=1)))))
    # order of words among equals: the place in sorted order
    rank = np.empty(len(words), np.int64)
    rank[np.asarray(pc.array_sort_indices(words))] = np.arange(len(words))
    found_q, found_n, found_t, found_c = [], [], [], []
    who, leaf = trie.search(node[ask], counts[ask], up[ask], down[ask]) if len(own) else (np.zeros(0, np.int64),) * 2
    many = trie.first[leaf + 1] - trie.first[leaf] if len(own) else leaf
    order = np.argsort(who, kind="stable")
    who, leaf, many = who[order], leaf[order], many[order]
    total = np.cumsum(many)
    start = 0
    while start < len(who):  # slices of candidates, whole searches each
        stop = max(int(np.searchsorted(total, (total[start - 1] if start else 0) + BLOCK_ROWS, "right")), start + 1)
        stop = int(np.searchsorted(who, who[stop - 1], "right"))
        q = ask[np.repeat(who[start:stop], many[start:stop])]
        t = own[trie.order[ts_spans(trie.first[leaf[start:stop]], trie.first[leaf[start:stop] + 1])]]
        la, lb = size[q], size[t]
        able = np.abs(la - lb) <= 1
        q, t, la, lb = q[able], t[able], la[able], lb[able]
        near = np.zeros(len(q), bool)
        fit = (la <= left.shape[1]) & (lb <= left.shape[1])
        s = np.flatnonzero(fit)
        apart = left[q[s]] != left[t[s]]
        differ = apart.any(1)
        p = apart.argmax(1)
        e = (right[q[s]] != right[t[s]]).argmax(1)
        near[s] = differ & (p + e >= np.maximum(la[s], lb[s]) - 1)
        for i in np.flatnonzero(~fit):
            near[i] = one_apart(words[q[i]].as_py(), words[t[i]].as_py())
        q, t = q[near], t[near]
        if len(q):
            sort = np.lexsort((rank[t], -n[t], q))
            q, t = q[sort], t[sort]
            new = np.flatnonzero(np.concatenate([[True], q[1:] != q[:-1]]))
            found_q.append(q[new])
            found_t.append(t[new])
            found_c.append(np.diff(np.concatenate([new, [len(q)]])))
        start = stop
    q, t, c = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (found_q, found_t, found_c))
    return pa.RecordBatch.from_arrays([words.take(pa.array(q)), pa.array(c.astype(np.int64)), words.take(pa.array(t)), pa.array(n[t].astype(np.int64))], names=["word", "near", "best", "best_n"])


def searched(rows: DataFrame, depth: int) -> DataFrame:
    """(word, near, best, best_n) per search and node, for rows dealt out by node."""

    def walk(batches):
        def block(table):
            table = table.combine_chunks()
            one = lambda name: table.column(name).chunk(0) if table.column(name).num_chunks else pa.array([], table.schema.field(name).type)
            node = one("node").dictionary_encode().indices.to_numpy()
            return near_sums(one("word"), np.asarray(one("n")), node, np.asarray(one("search")), np.asarray(one("up")), np.asarray(one("down")), depth)

        held, size = [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            size += batch.num_rows
            if size >= BLOCK_ROWS:
                table = pa.Table.from_batches(held)
                node = table.column("node").combine_chunks()
                last = node[len(node) - 1]
                cut = int(pc.index(node.chunk(0) if isinstance(node, pa.ChunkedArray) else node, last).as_py())
                if cut == 0:
                    cut, part = _own_first(table)
                    if cut == 0:
                        continue
                    yield block(part)
                    held, size = [b for b in table.slice(0, cut).to_batches()], cut
                    continue
                yield block(table.slice(0, cut))
                held = table.slice(cut).to_batches()
                size = len(table) - cut
        if size:
            yield block(pa.Table.from_batches(held))

    dealt = rows.repartition("node").sortWithinPartitions("node", "search")
    return dealt.mapInArrow(shared.giving_back(walk), "word binary, near long, best binary, best_n long")


def _own_first(table: pa.Table) -> tuple[int, pa.Table]:
    """Rows of one node, words before searches: the number of words, and the table if it holds searches."""
    search = np.asarray(table.column("search").combine_chunks())
    own = int((~search).sum())
    return (own, table) if own < len(search) else (0, table)


def near_words(words: DataFrame) -> DataFrame:
    """(word, n_near, best, best_n) of words (word, n) that have near words."""
    start = words.select(F.lit(b"").alias("node"), "word", "n", F.lit(1).alias("up"), F.lit(1).alias("down"))
    left = start.select("node", "word", "n", F.lit(False).alias("search"), "up", "down").union(start.select("node", "word", "n", F.lit(True).alias("search"), "up", "down"))
    out, before = None, 0
    for depth in STEPS:
        nodes = shared.stored(sent(left, depth, before), "trie-nodes")
        large = nodes.filter(~F.col("search")).groupBy("node").agg(F.count("*").alias("words")).filter(F.col("words") > NODE_WORDS).select(F.col("node").alias("large"))
        large = shared.stored(large, "trie-large")
        split = depth != STEPS[-1] and bool(large.take(1))
        here = nodes.join(large, F.col("node") == F.col("large"), "left_anti") if split else nodes
        part = searched(here, depth)
        out = part if out is None else out.union(part)
        if not split:
            break
        left, before = nodes.join(large, F.col("node") == F.col("large"), "left_semi"), depth
    first = F.min_by(F.struct("best", "best_n"), F.struct(-F.col("best_n"), F.col("best")))
    sums = out.groupBy("word").agg(F.sum("near").alias("n_near"), first.alias("first"))
    return sums.select("word", "n_near", "first.best", "first.best_n")


def variants(docs: DataFrame, least: int = LEAST_COUNT, times: int = TIMES) -> DataFrame:
    """(word, n, n_near, form, form_n, root) of documents (doc_id, text).

    A form has at least ``times`` as many occurrences as its word, so with counts below 2^63 a
    chain has at most 27 links for ``times`` = 5: paths are doubled until they must have ended.
    """
    words = shared.stored(counted(docs, least), "spelling-words")
    near = near_words(words).select(F.col("word").alias("near_word"), "n_near", "best", "best_n")
    rows = words.join(near, F.col("word") == F.col("near_word"), "left")
    has = F.col("best_n") >= times * F.col("n")
    rows = rows.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(has, F.col("best")).alias("form"), F.when(has, F.col("best_n")).alias("form_n"))
    rows = shared.stored(rows, "spelling-forms")
    paths, links = rows.filter("form is not null").select("word", F.col("form").alias("root")), 1
    while times ** links < 2**63:
        step = paths.select(F.col("word").alias("next_word"), F.col("root").alias("next_root"))
        paths = paths.join(step, F.col("root") == F.col("next_word"), "left").select("word", F.coalesce("next_root", "root").alias("root"))
        paths, links = shared.stored(paths, "spelling-paths"), 2 * links
    roots = paths.select(F.col("word").alias("path_word"), "root")
    rows = rows.join(roots, F.col("word") == F.col("path_word"), "left").withColumn("root", F.coalesce("root", "word"))
    text = lambda c: F.decode(F.col(c), "ISO-8859-1").alias(c)
    return rows.select(text("word"), "n", "n_near", text("form"), "form_n", text("root"))
