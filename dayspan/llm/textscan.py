"""Arrow text batches as byte arrays: word bounds and word hashes without a Python step per word.

A batch is cut into chunks of whole texts of about ``CHUNK`` bytes, so the work arrays stay
small whatever the batch size; one text longer than that is a chunk of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK = 1 << 20
_ODD = np.uint64(0x9E3779B97F4A7C15)
_rng = np.random.Generator(np.random.PCG64(20240607))
BYTE_VALUES = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers: dict[str, np.ndarray] = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a text column, and n + 1 offsets; a null is an empty text."""
    column = column.cast(pa.large_binary()).fill_null(b"")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[at[0]:at[-1]], at - at[0]


def chunks(raw: np.ndarray, at: np.ndarray, limit: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of whole texts."""
    n, row = len(at) - 1, 0
    while row < n:
        end = max(row + 1, int(np.searchsorted(at, at[row] + limit, "right")) - 1)
        yield row, end, raw[at[row]:at[end]], at[row:end + 1] - at[row]
        row = end


def word_bounds(raw: np.ndarray, at: np.ndarray, is_space: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and rows of maximal runs of bytes that are not space; no word crosses texts."""
    n = len(raw)
    if n == 0:
        return (np.zeros(0, np.int64),) * 3
    gap = is_space[raw]
    before, after = np.empty(n, bool), np.empty(n, bool)
    before[0] = after[-1] = True
    before[1:], after[:-1] = gap[:-1], gap[1:]
    edge = at[1:-1]
    before[edge[edge < n]] = True
    after[edge[edge > 0] - 1] = True
    starts = np.flatnonzero(~gap & before)
    ends = np.flatnonzero(~gap & after) + 1
    return starts, ends, np.searchsorted(at, starts, "right") - 1


def _power(name: str, n: int) -> np.ndarray:
    if len(_powers[name]) < n:
        step = _ODD if name == "up" else np.uint64(pow(int(_ODD), -1, 1 << 64))
        size = n if n > 4 * CHUNK else max(2 * n, 1 << 16)
        grown = np.full(size, step, np.uint64)
        grown[0] = 1
        np.cumprod(grown, out=grown)
        if n > 4 * CHUNK:  # one very long text: don't keep its table
            return grown[:n]
        _powers[name] = grown
    return _powers[name][:n]


def mix(h: np.ndarray) -> np.ndarray:
    """Spreads the bits of 64-bit hashes."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def span_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of the bytes of each span, the same wherever the span lies."""
    sums = np.zeros(len(raw) + 1, np.uint64)
    if len(raw):
        np.cumsum(BYTE_VALUES[raw] * _power("up", len(raw)), out=sums[1:])
    down = _power("down", len(raw) + 1)
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def joined(hashes: list[np.ndarray]) -> np.ndarray:
    """Ordered combination of hashes, for shingles of neighbouring words."""
    out = hashes[0]
    for i, h in enumerate(hashes[1:], 1):
        out = mix(out * np.uint64(2 * i + 1) + h)
    return out


def shingles(words: np.ndarray, rows: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of k neighbouring words of one text, and the index of their first word."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    first = np.flatnonzero(rows[:n] == rows[k - 1:])
    return joined([words[first + i] for i in range(k)]), first
