"""Token ids of Arrow text batches: every distinct piece of text goes through the tokenizer once per worker.

A byte-level BPE file splits a text at fixed places before it merges bytes. ``cut_places``
finds some of those places from the bytes alone; the ids of a text are the ids of its pieces
in a row. Pieces are looked up by hash in a table that the worker keeps.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from tokenizers import Tokenizer

from dayspan.llm import textscan as ts

SLOTS = 1 << 20
POOL_IDS = 1 << 21
JOIN_BYTES = 1 << 17

_space = ts.SPACE
_open_space = _space.copy()
_open_space[[0xC2, 0xE1, 0xE2, 0xE3]] = True  # may begin a white space character
_letter = np.zeros(256, bool)
_letter[65:91] = _letter[97:123] = True
_mark = np.zeros(256, bool)
_mark[33:127] = True
_mark[48:58] = _mark[65:91] = _mark[97:123] = _mark[39] = False
_two_byte_lead = np.zeros(256, bool)
_two_byte_lead[0xC3:0xE0] = True


def cut_places(raw: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Places where no token of the byte-level split can lie across, text ends included.

    Before a blank whose next character is no white space, between an ASCII letter and an
    ASCII sign other than the apostrophe, and around a lone line feed before a character
    that is no white space.
    """
    n = len(raw)
    cut = np.zeros(n + 1, bool)
    cut[at] = True
    if n > 1:
        here, after = raw[:-1], raw[1:]
        closed = ~_open_space[after]
        cut[:n - 1] |= (here == 32) & closed
        cut[1:n] |= _letter[here] & _mark[after]
        if n > 2:
            lone = (here[1:] == 10) & closed[1:] & ~_space[here[:-1]]
            cut[1:n - 1] |= lone
            cut[2:n] |= lone
    return np.flatnonzero(cut)


class Encoder:
    """Ids of whole texts under a tokenizer file, with a table of the pieces met so far."""

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.size = self.tokenizer.get_vocab_size()
        self.bytes_of = np.array([len(self.tokenizer.id_to_token(i) or "") for i in range(self.size)], np.int64)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.dtype = np.dtype("<u2") if self.size <= 1 << 16 else np.dtype("<u4")
        self.hash_at = np.zeros(SLOTS, np.uint64)
        self.from_at, self.n_at = np.zeros(SLOTS, np.int32), np.zeros(SLOTS, np.int32)
        self.pool, self.used = np.zeros(1 << 16, self.dtype), 0

    def _plain(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _pieces(self, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct pieces in a row, and how many each has.

        Pieces that neither begin nor end in white space are joined by line feeds, which are
        tokens of their own there; the lengths of the tokens tell where a piece ends.
        """
        n = len(starts)
        first, last = raw[starts], raw[ends - 1]
        second = raw[np.minimum(starts + 1, ends - 1)]
        before_last = raw[np.maximum(ends - 2, starts)]
        joins = np.where(first == 32, (ends - starts > 1) & ~_open_space[second], ~_open_space[first])
        joins &= np.where(last < 128, ~_space[last], (ends - starts > 1) & _two_byte_lead[before_last])
        data, found = raw.tobytes(), [None] * n
        row = np.flatnonzero(joins)
        if len(row):
            sums = np.cumsum(ends[row] - starts[row] + 1)
            group = sums // JOIN_BYTES
            for part in np.split(row, np.flatnonzero(np.diff(group)) + 1):
                text = b"\n".join([data[starts[i]:ends[i]] for i in part])
                ids = np.array(self._plain([text.decode("utf-8", "replace")])[0], self.dtype)
                at = np.concatenate([[0], np.cumsum(self.bytes_of[ids])])
                stop = np.cumsum(ends[part] - starts[part] + 1) - 1
                begin = stop - (ends[part] - starts[part])
                low, high = np.searchsorted(at, begin), np.searchsorted(at, stop)
                right = (at[low] == begin) & (at[np.minimum(high, len(at) - 1)] == stop)
                for i, a, b in zip(part[right].tolist(), low[right].tolist(), high[right].tolist()):
                    found[i] = ids[a:b]
        rest = [i for i in range(n) if found[i] is None]
        for i, ids in zip(rest, self._plain([data[starts[i]:ends[i]].decode("utf-8", "replace") for i in rest])):
            found[i] = np.array(ids, self.dtype)
        sizes = np.array([len(x) for x in found], np.int64)
        return np.concatenate(found) if n else np.zeros(0, self.dtype), sizes

    def _keep(self, hashes: np.ndarray, ids: np.ndarray, begins: np.ndarray, sizes: np.ndarray) -> None:
        """Puts new pieces into free slots, as long as the pool has room."""
        slot = (hashes & np.uint64(SLOTS - 1)).astype(np.int64)
        free = self.hash_at[slot] == 0
        _, one = np.unique(slot, return_index=True)
        pick = np.zeros(len(slot), bool)
        pick[one] = True
        pick &= free & (sizes > 0)
        pick &= self.used + np.cumsum(np.where(pick, sizes, 0)) <= POOL_IDS
        chosen = np.flatnonzero(pick)
        if not len(chosen):
            return
        take = spread(begins[chosen], sizes[chosen])
        while self.used + len(take) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
        self.pool[self.used:self.used + len(take)] = ids[take]
        n = sizes[chosen]
        self.from_at[slot[chosen]] = self.used + np.cumsum(n) - n
        self.n_at[slot[chosen]] = n
        self.hash_at[slot[chosen]] = hashes[chosen]
        self.used += len(take)

    def _chunk(self, raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the texts of one chunk in a row, and ids per text."""
        cut = cut_places(raw, at)
        starts, ends = cut[:-1], cut[1:]
        hashes = ts.span_hashes(raw, starts, ends)
        hashes[hashes == 0] = 1
        slot = (hashes & np.uint64(SLOTS - 1)).astype(np.int64)
        met = self.hash_at[slot] == hashes
        begins, sizes = self.from_at[slot].astype(np.int64), self.n_at[slot].astype(np.int64)
        pool = self.pool
        missed = np.flatnonzero(~met)
        if len(missed):
            fresh, one, place = np.unique(hashes[missed], return_index=True, return_inverse=True)
            ids, n = self._pieces(raw, starts[missed[one]], ends[missed[one]])
            begin = np.cumsum(n) - n
            pool = np.concatenate([self.pool[:self.used], ids])
            begins[missed], sizes[missed] = self.used + begin[place], n[place]
            self._keep(fresh, ids, begin, n)
        out = pool[spread(begins, sizes)]
        sums = np.concatenate([[0], np.cumsum(sizes)])
        place = np.searchsorted(cut, at)
        return out, np.diff(sums[place])

    def encode(self, texts: pa.Array, end_id: int):
        """(first row, end row, ids in a row, ids per text), the end id after every text."""
        raw, at = ts.text_bytes(texts)
        odd = np.zeros(len(texts), bool)
        for word in self.special:
            odd |= np.asarray(pc.fill_null(pc.match_substring(texts, word), False))
        for low, high, part, offsets in ts.chunks(raw, at):
            ids, sizes = self._chunk(part, offsets)
            if odd[low:high].any():  # special tokens reach over cuts
                rows = np.split(ids, np.cumsum(sizes)[:-1])
                for i in np.flatnonzero(odd[low:high]):
                    text = part[offsets[i]:offsets[i + 1]].tobytes().decode("utf-8", "replace")
                    rows[i] = np.array(self._plain([text])[0], self.dtype)
                ids, sizes = np.concatenate(rows), np.array([len(x) for x in rows], np.int64)
            yield low, high, np.insert(ids, np.cumsum(sizes), end_id), sizes + 1


def spread(begins: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Indices begins[i] .. begins[i] + sizes[i] - 1 of all i in a row."""
    ends = np.cumsum(sizes)
    return np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(begins - (ends - sizes), sizes)


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The worker's encoder of a file."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]
