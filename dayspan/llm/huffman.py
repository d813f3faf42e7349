"""Canonical length-limited Huffman codes over arrays of ids.

Codes are at most ``LIMIT`` bits long; where so many ids have no room, two bits longer than it
takes to number them (``MOST`` at most). One table of as many places decodes any id.
A text's bits start on a byte; every ``SEGMENT`` ids their bit length is kept as a mark, so
all segments of a block are decoded side by side.
"""

from __future__ import annotations

import numpy as np

LIMIT, MOST = 16, 24
SEGMENT = 128


def longest(n: int) -> int:
    """Bits that a code of ``n`` ids may have."""
    return LIMIT if n <= 1 << LIMIT else min(MOST, (n - 1).bit_length() + 2)


def code_lengths(counts: np.ndarray, limit: int | None = None) -> np.ndarray:
    """Optimal code lengths under ``limit`` for positive counts (package-merge)."""
    n = len(counts)
    if n <= 1:
        return np.ones(n, np.int64)
    limit = longest(n) if limit is None else limit
    if n > 1 << limit:
        raise ValueError(f"{n} ids do not fit codes of {limit} bits")
    order = np.argsort(counts, kind="stable")
    items = counts[order].astype(np.float64)
    row, masks = items, [np.ones(n, bool)]
    for _ in range(limit - 1):
        half = len(row) // 2 * 2
        packs = row[0:half:2] + row[1:half:2]
        both = np.concatenate([items, packs])
        place = np.argsort(both, kind="stable")
        row = both[place]
        masks.append(place < n)
    lengths, take = np.zeros(n, np.int64), 2 * n - 2
    for mask in reversed(masks):
        k = int(mask[:take].sum())
        lengths[:k] += 1
        take = 2 * (take - k)
    out = np.empty(n, np.int64)
    out[order] = lengths
    return out


class Code:
    """Canonical code of ``ids`` with the given lengths: encoding and decoding tables."""

    def __init__(self, ids: np.ndarray, lengths: np.ndarray):
        order = np.lexsort((ids, lengths))
        self.ids, self.lengths = ids[order].astype(np.int64), lengths[order].astype(np.int64)
        size = int(self.ids.max()) + 1 if len(ids) else 1
        self.bits = max(LIMIT, int(self.lengths.max(initial=0)))
        spans = np.int64(1) << (self.bits - self.lengths)
        left = np.concatenate([[0], np.cumsum(spans)[:-1]]) if len(ids) else np.zeros(0, np.int64)
        self.length_of, self.code_of = np.zeros(size, np.uint8), np.zeros(size, np.uint32)
        self.length_of[self.ids] = self.lengths
        self.code_of[self.ids] = left >> (self.bits - self.lengths)
        self.table_id, self.table_length = np.zeros(1 << self.bits, np.uint32), np.ones(1 << self.bits, np.uint8)
        filled = int(spans.sum())
        self.table_id[:filled] = np.repeat(self.ids, spans)
        self.table_length[:filled] = np.repeat(self.lengths, spans)

    def encode(self, ids: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Bytes of all texts, bytes per text, marks of all segments, segments per text. Sizes are positive."""
        lengths = self.length_of[ids].astype(np.int64)
        sums = np.concatenate([[0], np.cumsum(lengths)])
        ends = np.cumsum(sizes)
        begins = ends - sizes
        n_bytes = (sums[ends] - sums[begins] + 7) >> 3
        shift = ((np.cumsum(n_bytes) - n_bytes) << 3) - sums[begins]
        at = sums[:-1] + np.repeat(shift, sizes)
        wide = 32 if self.bits <= 16 else 48  # a code begins in one of 16 places of a word and ends in the next or next but one
        kind = np.uint32 if wide == 32 else np.uint64
        value = self.code_of[ids].astype(kind) << (wide - (at & 15) - lengths).astype(kind)
        word = at >> 4
        total = int(n_bytes.sum())
        out = np.zeros(total // 2 + 3, np.uint16)
        if len(ids):
            group = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
            for i in range(wide // 16):
                part = (value >> kind(wide - 16 * (i + 1))) & kind(0xFFFF)
                out[word[group] + i] |= np.bitwise_or.reduceat(part, group).astype(np.uint16)
        n_segments = (sizes + SEGMENT - 1) // SEGMENT
        starts, stops = segments(begins, ends, n_segments)
        return out.astype(">u2").view(np.uint8)[:total], n_bytes, (sums[stops] - sums[starts]).astype(np.uint16), n_segments

    def decode(self, data: np.ndarray, sizes: np.ndarray, marks: np.ndarray) -> np.ndarray:
        """All ids of a block: texts of ``sizes`` ids, each starting on a byte."""
        ends = np.cumsum(sizes)
        begins = ends - sizes
        n_segments = (sizes + SEGMENT - 1) // SEGMENT
        starts, stops = segments(begins, ends, n_segments)
        bits = marks.astype(np.int64)
        after = np.cumsum(bits)
        first = np.cumsum(n_segments) - n_segments
        text_bits = np.add.reduceat(bits, first) if len(sizes) else np.zeros(0, np.int64)
        n_bytes = (text_bits + 7) >> 3
        text_at = (np.cumsum(n_bytes) - n_bytes) << 3
        at = after - bits + np.repeat(text_at - (after - bits)[first], n_segments)
        padded = np.concatenate([data, np.zeros(4, np.uint8)]).astype(np.uint32)
        window = (padded[:-3] << np.uint32(24)) | (padded[1:-2] << np.uint32(16)) | (padded[2:-1] << np.uint32(8)) | padded[3:]
        rest = np.uint32(32 - self.bits)
        out = np.empty(int(sizes.sum()), np.uint32)
        order = np.argsort(starts - stops, kind="stable")  # longest first
        at, starts, length = at[order], starts[order], (stops - starts)[order]
        live = len(order)
        for step in range(int(length[0]) if live else 0):
            live = int(np.searchsorted(-length, -step, "left"))
            here = at[:live]
            key = (window[here >> 3] << (here & 7).astype(np.uint32)) >> rest
            out[starts[:live] + step] = self.table_id[key]
            at[:live] += self.table_length[key]
        return out


def segments(begins: np.ndarray, ends: np.ndarray, n_segments: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and end id of each segment of each text."""
    first = np.cumsum(n_segments) - n_segments
    place = np.arange(int(n_segments.sum())) - np.repeat(first, n_segments)
    starts = np.repeat(begins, n_segments) + SEGMENT * place
    return starts, np.minimum(starts + SEGMENT, np.repeat(ends, n_segments))
