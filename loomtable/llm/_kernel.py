"""Vectorised word kernel over Arrow string buffers.

Every word-based operator of this subpackage reads text through this module.
It works on the UTF-8 bytes of a whole Arrow batch at once: lower-cases A-Z,
finds word bounds with a 256-entry byte table, and hashes words and word
k-grams with array operations, so cost per word is a few tens of nanoseconds
and no Python string is made for words that match nothing.

Two word definitions are offered.  Bytes of a multi-byte UTF-8 character are
all >= 0x80, so a byte table decides both exactly:

* ``ALNUM``: ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after lower-casing A-Z.
* ``SPACED``: ``[^\\x20\\x09-\\x0D]+`` after lower-casing A-Z.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_MASK = (1 << 64) - 1
_BASE = 0x9E3779B97F4A7C15 | 1
_INV = pow(_BASE, -1, 1 << 64)
_STEP = np.uint64(0xD6E8FEB86659FD93)

#: Bytes handled at once; keeps every temporary array within a few MB.
CHUNK_BYTES = 1 << 20

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

ALNUM = np.zeros(256, dtype=bool)
ALNUM[48:58] = ALNUM[97:123] = ALNUM[128:] = True

SPACED = np.ones(256, dtype=bool)
SPACED[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64: a bijection on 64-bit integers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x2545F4914F6CDD1D))
_powers: dict[str, np.ndarray] = {}


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    have = _powers.get("up")
    if have is None or len(have) < n:
        size = max(n, CHUNK_BYTES + 1)
        for key, base in (("up", _BASE), ("down", _INV)):
            steps = np.full(size, base, dtype=np.uint64)
            steps[0] = 1
            _powers[key] = np.multiply.accumulate(steps)
        if size > 16 * CHUNK_BYTES:  # a rare giant text: don't keep its tables
            return _powers.pop("up"), _powers.pop("down")
    return _powers["up"], _powers["down"]


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets (int64, one more than rows) and bytes of a string column; null reads as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    n = len(column)
    _, off, data = column.buffers()
    if n == 0 or off is None:
        return np.zeros(n + 1, dtype=np.int64), np.zeros(0, dtype=np.uint8)
    offsets = np.frombuffer(off, dtype=np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    return offsets, raw


def chunks(offsets: np.ndarray, size: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``size`` bytes (one row, where a single text is longer)."""
    n, lo = len(offsets) - 1, 0
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + size, side="right")) - 1
        hi = min(n, max(hi, lo + 1))
        yield lo, hi
        lo = hi


class Words:
    """Words of some texts: ``bytes`` (lower-cased), ``start``/``end`` byte bounds, ``first`` word number of each text (one more than texts)."""

    def __init__(self, offsets: np.ndarray, raw: np.ndarray, table: np.ndarray = ALNUM):
        base = int(offsets[0])
        bounds = offsets - base
        self.bytes = LOWER[raw[base : int(offsets[-1])]]
        size = len(self.bytes)
        inside = table[self.bytes]
        before = np.empty(size, dtype=bool)
        after = np.empty(size, dtype=bool)
        if size:
            before[0] = after[-1] = False
            before[1:] = inside[:-1]
            after[:-1] = inside[1:]
            cut = bounds[(bounds > 0) & (bounds < size)]
            before[cut] = False
            after[cut - 1] = False
        self.start = np.flatnonzero(inside & ~before)
        self.end = np.flatnonzero(inside & ~after) + 1
        self.first = np.searchsorted(self.start, bounds)
        self.bounds = bounds

    def __len__(self) -> int:
        return len(self.start)

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word: a polynomial over random byte values, by prefix sums, then mixed with the length."""
        if not len(self.start):
            return np.zeros(0, dtype=np.uint64)
        up, down = _power(len(self.bytes) + 1)
        total = np.empty(len(self.bytes) + 1, dtype=np.uint64)
        total[0] = 0
        np.cumsum(_BYTE[self.bytes] * up[: len(self.bytes)], out=total[1:])
        h = (total[self.end] - total[self.start]) * down[self.start]
        return mix(h + (self.end - self.start).astype(np.uint64))

    def grams(self, h: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all runs of k words within one text, and the number of each run's first word."""
        n = len(h)
        if n < k:
            return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
        ok = np.ones(n - k + 1, dtype=bool)
        for j in range(1, k):  # a run must not begin in the last k-1 words of a text
            at = self.first[1:-1] - j
            at = at[(at >= 0) & (at < n - k + 1) & (at >= self.first[:-2])]
            ok[at] = False
        at = np.flatnonzero(ok)
        acc = h[: n - k + 1].copy()
        for j in range(1, k):
            acc = acc * _STEP + h[j : n - k + 1 + j]
        return mix(acc[at] + np.uint64(k)), at

    def whole(self, h: np.ndarray, text: int) -> int:
        """The hash that ``grams`` gives to all words of one text taken as one run."""
        acc = 0
        words = h[self.first[text] : self.first[text + 1]]
        for x in words.tolist():
            acc = (acc * int(_STEP) + x) & _MASK
        return int(mix(np.array([(acc + len(words)) & _MASK], dtype=np.uint64))[0])

    def text(self, lo: int, hi: int) -> bytes:
        """Words lo to hi-1, with one space between them."""
        b = self.bytes.tobytes() if hi - lo > 4096 else None
        if b is not None:
            return b" ".join(b[s:e] for s, e in zip(self.start[lo:hi].tolist(), self.end[lo:hi].tolist(), strict=True))
        return b" ".join(self.bytes[s:e].tobytes() for s, e in zip(self.start[lo:hi].tolist(), self.end[lo:hi].tolist(), strict=True))


def grams_of(h: np.ndarray, k: int) -> np.ndarray:
    """``Words.grams`` of one text's word hashes; of fewer than k words, but not none, the whole as one."""
    n = len(h)
    size = min(k, n)
    if not size:
        return np.zeros(0, dtype=np.uint64)
    acc = h[: n - size + 1].copy()
    for j in range(1, size):
        acc = acc * _STEP + h[j : n - size + 1 + j]
    return mix(acc + np.uint64(size))


def words_of(texts: list[str], table: np.ndarray = ALNUM) -> Words:
    """For small lists on the driver and in tests."""
    offsets, raw = buffers(pa.array(texts, pa.large_string()))
    return Words(offsets, raw, table)
