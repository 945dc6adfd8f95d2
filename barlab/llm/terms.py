"""Hashed terms of texts, by numpy over whole buffers."""

from __future__ import annotations

from functools import cache

import numpy as np

_BASE = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1


def _word_bytes() -> np.ndarray:
    """For each byte its lower-case value if it is part of a word (ASCII letters, digits, bytes over 127), else 0."""
    t = np.zeros(256, np.uint8)
    for b in range(256):
        if b >= 128 or chr(b).isalnum():
            t[b] = ord(chr(b).lower()) if b < 128 else b
    return t


_TABLE = _word_bytes()


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


_PIECE = 1 << 20


@cache
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """16 MB, made where texts are hashed only: the driver hashes none."""
    return _powers(_BASE, _PIECE + 1), _powers(pow(_BASE, -1, 1 << 64), _PIECE + 1)


def hashed_terms(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each word's row and its 64-bit hash. Pieces of 1 MB bound the memory; they end between words
    (a word of over 1 MB is cut there)."""
    rows, hashes = [], []
    starts = offsets[:-1]
    up, down = _tables()
    at = 0
    while at < len(data):
        to = min(len(data), at + _PIECE)
        part = _TABLE[data[at:to]]
        if to < len(data) and part[-1]:
            gap = np.flatnonzero(part == 0)
            if len(gap):
                to = at + int(gap[-1]) + 1
                part = part[: to - at]
        inside = part != 0
        first = np.append(True, ~inside[:-1]) & inside
        cuts = starts[np.searchsorted(starts, at) : np.searchsorted(starts, to)] - at
        first[cuts] = inside[cuts]
        last = inside & np.append(~inside[1:] | first[1:], True)
        s, e = np.flatnonzero(first), np.flatnonzero(last) + 1
        total = np.cumsum(part.astype(np.uint64) * up[: len(part)], dtype=np.uint64)
        h = (total[e - 1] - np.where(s > 0, total[s - 1], np.uint64(0))) * down[s]
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(32)
        rows.append(np.searchsorted(offsets, s + at, "right") - 1)
        hashes.append(h)
        at = to
    if not rows:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return np.concatenate(rows), np.concatenate(hashes)
