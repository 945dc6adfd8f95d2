"""Cutting texts into words by the byte-level BPE pattern, and hashing these, by numpy over whole buffers.

`PATTERN` is cut by character classes, without a regular expression for every word; any other pattern is
left to the regex module."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import regex

from barlab.llm.common import flat

#: Fixed value: the pattern that the vectorised cut stands for.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
PIECE = 1 << 19
_LITTLE = 1 << 16  # stretches up to this size need no tables for whole pieces (the driver's have no more)
#: Words of more bytes are not hashed: they count as unlike all others.
MOST_BYTES = 255
_BASES = (0x9E3779B97F4A7C15 | 1, 0xD6E8FEB86659FD93 | 1)
_SPACE, _LETTER, _NUMBER, _OTHER = range(4)


@cache
def _classes() -> np.ndarray:
    """The class of every code point."""
    out = np.full(0x110000, _OTHER, np.uint8)
    for low in range(0, 0x110000, 0x10000):
        if low == 0:
            points = [*range(0xD800), *range(0xE000, 0x10000)]
        else:
            points = range(low, low + 0x10000)
        text, at = "".join(map(chr, points)), np.array(points)
        for kind, pattern in ((_SPACE, r"\p{White_Space}+"), (_LETTER, r"\p{L}+"), (_NUMBER, r"\p{N}+")):
            for m in regex.finditer(pattern, text):
                out[at[m.start() : m.end()]] = kind
    return out


def _cuts(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, int]]:
    """Stretches of about PIECE bytes that end with a row or before white space, where a word always begins."""
    at, n = 0, len(data)
    while at < n:
        to = min(n, at + PIECE)
        if to < n:
            row = int(offsets[np.searchsorted(offsets, to, "right") - 1])
            if row > at:
                to = row
            else:
                d = data[at:to]
                gap = (d == 32) | ((d >= 9) & (d <= 13))
                found = np.flatnonzero(gap[1:] & ~gap[:-1] & (d[:-1] < 128))
                to = at + int(found[-1]) + 1 if len(found) else int(offsets[np.searchsorted(offsets, at, "right")])
        yield at, to
        at = to


def _starts(d: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Where words begin in a stretch of bytes; rows: where its rows begin."""
    pos = np.flatnonzero((d & 0xC0) != 0x80)
    code = d if len(pos) == len(d) else np.frombuffer(d.tobytes().decode().encode("utf-32-le"), np.uint32)
    kind = _classes()[code]
    n = len(code)
    first = np.zeros(n + 1, bool)
    first[np.searchsorted(pos, rows[rows < len(d)])] = True
    first[0] = first[n] = True
    start = first[:n].copy()
    start[1:] |= kind[1:] != kind[:-1]
    space = kind == _SPACE
    lead = space[:-1] & ~space[1:] & ~first[1:n]
    start[:-1] |= lead
    start[1:][lead & (code[:-1] == 32)] = False
    at = np.flatnonzero((code == 39) & start)
    c = np.append(code.astype(np.int64), [0, 0])
    c1, c2 = np.where(first[at + 1], 0, c[at + 1]), np.where(first[np.minimum(at + 2, n)], 0, c[np.minimum(at + 2, n)])
    one = np.isin(c1, [ord(x) for x in "stmd"])
    two = ((c1 == ord("r")) & (c2 == ord("e"))) | ((c1 == ord("v")) & (c2 == ord("e"))) | ((c1 == ord("l")) & (c2 == ord("l")))
    start[at[one | two] + 1] = False
    ends = np.concatenate([at[one] + 2, at[two] + 3])
    start[ends[ends < n]] = True
    return pos[start]


def word_starts(data: np.ndarray, offsets: np.ndarray, pattern: str = PATTERN) -> np.ndarray:
    """Byte positions at which words begin; rows are those of the n + 1 offsets, and words don't span rows."""
    out = [np.zeros(0, np.int64)]
    if pattern == PATTERN:
        for lo, hi in _cuts(data, offsets):
            rows = offsets[np.searchsorted(offsets, lo) : np.searchsorted(offsets, hi)] - lo
            out.append(lo + _starts(data[lo:hi], rows))
        return np.concatenate(out)
    find, raw = regex.compile(pattern).findall, data.tobytes()
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
        sizes = [len(w.encode()) for w in find(raw[a:b].decode())]
        if sum(sizes) != b - a:
            raise ValueError("the pattern must cover whole texts")
        out.append(a + np.cumsum([0, *sizes[:-1]])[: len(sizes)])
    return np.concatenate(out)


@cache
def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    def run(b: int) -> np.ndarray:
        out = np.full(n + 1, b, np.uint64)
        out[0] = 1
        return np.cumprod(out, dtype=np.uint64)

    return run(base), run(pow(base, -1, 1 << 64))


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two independent 64-bit hashes of each span of bytes; spans are in order and don't overlap."""
    h = [np.zeros(len(starts), np.uint64) for _ in _BASES]
    i = 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + PIECE, "right")))
        if j == i + 1 and ends[i] - starts[i] > MOST_BYTES:
            i = j
            continue
        lo, hi = int(starts[i]), int(ends[j - 1])
        part = data[lo:hi].astype(np.uint64) + np.uint64(1)
        a, b = starts[i:j] - lo, ends[i:j] - lo
        for k, base in enumerate(_BASES):
            up, down = _powers(base, PIECE if hi - lo > _LITTLE else _LITTLE)
            total = np.append(np.uint64(0), np.cumsum(part * up[: len(part)], dtype=np.uint64))
            x = (total[b] - total[a]) * down[a]
            x ^= x >> np.uint64(31)
            x *= np.uint64(0xBF58476D1CE4E5B9)
            h[k][i:j] = x ^ x >> np.uint64(29)
        i = j
    return h[0], h[1]


class Dictionary:
    """Words with the ids of their tokens, found by hash in an open table of int32 slots."""

    def __init__(self, parts: Iterable[tuple[pa.Array, pa.Array]]) -> None:
        """parts: words as strings or bytes, and a list of ids of each; a part is let go when it is read."""
        a, b, sizes, ids = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)], [np.zeros(1, np.int64)], [np.zeros(0, np.int32)]
        for words, values in parts:
            for i in range(0, len(words), 1 << 12):
                data, off = flat(words.slice(i, 1 << 12))
                for out, h in zip((a, b), span_hashes(data, off[:-1], off[1:])):
                    out.append(h)
            sizes.append(values.value_lengths().to_numpy().astype(np.int64))
            ids.append(values.flatten().to_numpy().astype(np.int32))
        self.a, self.b, self.first, self.ids = np.concatenate(a), np.concatenate(b), np.cumsum(np.concatenate(sizes)), np.concatenate(ids)
        if len(self.ids) < 1 << 31:
            self.first = self.first.astype(np.int32)
        if self.ids.max(initial=0) < 1 << 16:
            self.ids = self.ids.astype(np.uint16)
        n = len(self.a)
        self.mask = (1 << max(4, 2 * n).bit_length()) - 1
        self.slots = np.full(self.mask + 1, -1, np.int32)
        left, at = np.arange(n), (self.a & np.uint64(self.mask)).astype(np.int64)
        self.probes = 0
        while len(left):
            self.probes += 1
            free = self.slots[at] < 0
            self.slots[at[free]] = left[free]
            stay = self.slots[at] != left
            left, at = left[stay], (at[stay] + 1) & self.mask

    def find(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The number of each word, -1 where it is not in the dictionary."""
        out = np.full(len(a), -1, np.int64)
        left, at = np.arange(len(a)), (a & np.uint64(self.mask)).astype(np.int64)
        for _ in range(self.probes):
            got = self.slots[at]
            hit = (got >= 0) & (self.a[got] == a[left]) & (self.b[got] == b[left]) if len(self.a) else np.zeros(len(left), bool)
            out[left[hit]] = got[hit]
            stay = (got >= 0) & ~hit
            left, at = left[stay], (at[stay] + 1) & self.mask
            if not len(left):
                break
        return out


def gather(values: np.ndarray, first: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The stretches of values that begin at `first` and have these sizes, one after another."""
    ends = np.cumsum(sizes)
    return values[np.repeat(first - (ends - sizes), sizes) + np.arange(int(ends[-1]) if len(ends) else 0)]
