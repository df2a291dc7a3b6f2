"""Word boundaries and 64-bit word hashes of many UTF-8 texts at once, as numpy passes over their bytes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

MULTIPLIER = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(MULTIPLIER, -1, 1 << 64)

#: Byte classes.  Every byte of a non-ASCII character is 0x80 or more, so classes of ASCII bytes cut UTF-8 rightly.
SPACES = frozenset([0x20, *range(0x09, 0x0E)])
NOT_SPACE = np.array([b not in SPACES for b in range(256)])
ALNUM = np.array([b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A for b in range(256)])


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


BYTE_VALUE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(MULTIPLIER))
#: Each byte with A-Z taken as a-z, and its value.
LOW = np.array([b | 0x20 if 65 <= b <= 90 else b for b in range(256)], np.uint8)
LOW_VALUE = BYTE_VALUE[LOW]


class Powers:
    """Powers of the multiplier and of its inverse modulo 2**64, grown on demand and kept for a task's life."""

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def get(self, n: int):
        if len(self.up) < n:
            self.up, self.down = (np.multiply.accumulate(np.r_[np.uint64(1), np.full(n, r, np.uint64)]) for r in (MULTIPLIER, INVERSE))
        return self.up, self.down


def buffer_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and text offsets (n + 1) of a string array; nulls hold nothing."""
    texts = texts.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def words(texts: pa.Array, is_word: np.ndarray, powers: Powers):
    """(first word of each text (n + 1), start bytes, end bytes, hashes) of all words, A-Z taken as a-z."""
    raw, offsets = buffer_of(texts)
    inside = is_word[LOW][raw]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:]
    edges = offsets[1:-1]
    edges = edges[(edges > 0) & (edges < len(raw))]
    begins[edges] |= inside[edges]
    ends[edges - 1] |= inside[edges - 1]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    up, down = powers.get(len(raw) + 1)
    total = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(LOW_VALUE[raw] * up[: len(raw)], out=total[1:])
    hashes = mix((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64))
    return np.searchsorted(start, offsets), start, end, hashes
