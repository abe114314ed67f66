"""Complete linkage on NumPy arrays, for what one task holds: memory grows with the scores above nothing, or with a bounded matrix."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from heapq import heapify, heappop, heappush

import numpy as np

#: Items whose scores to one another are held as (half of) one matrix, cells of a stretch of it, and scores of a block held as pairs at a time.
MATRIX, CELLS, PAIRS = 1000, 300_000, 100_000


def matrix_labels(score: np.ndarray, n: int, cut: float = 0.0) -> np.ndarray:
    """For each of ``n`` items the smallest of its cluster.  ``score`` is the upper triangle row by row and is overwritten; best first, ties by index, while the best is above ``cut``."""
    i = np.arange(n)
    at = i * (2 * n - i - 1) // 2 - i - 1  # the score of i < j stands at at[i] + j
    label, best, partner = i.copy(), np.zeros(n), np.full(n, -1)

    def look(x):
        row = score[at[x] + x + 1 : at[x] + n]
        if len(row):
            partner[x] = x + 1 + (j := int(row.argmax()))
            best[x] = row[j]

    for x in range(n):
        look(x)
    while n and best[a := int(best.argmax())] > cut:
        b = int(partner[a])
        above, below = slice(at[a] + b + 1, at[a] + n), slice(at[b] + b + 1, at[b] + n)
        score[at[:a] + a] = np.minimum(score[at[:a] + a], score[at[:a] + b])
        score[at[a] + a + 1 : at[a] + b] = np.minimum(score[at[a] + a + 1 : at[a] + b], score[at[a + 1 : b] + b])
        score[above] = np.minimum(score[above], score[below])
        score[at[:b] + b] = 0
        score[below] = 0
        label[label == b] = a
        best[b], partner[b] = 0, -1
        for x in np.flatnonzero((partner[:b] == a) | (partner[:b] == b)):  # scores only fall, so no other row's best has changed
            look(x)
        look(a)
    return label


def heap_labels(n: int, a: np.ndarray, b: np.ndarray, s: np.ndarray) -> np.ndarray:
    """The same from pairs a < b with scores above 0, each once: memory and work follow the pairs."""
    near: list[dict[int, float]] = [{} for _ in range(n)]
    heap = []
    for x, y, v in zip(a.tolist(), b.tolist(), s.tolist(), strict=True):
        near[x][y] = near[y][x] = v
        heap.append((-v, x, y))
    heapify(heap)
    root = np.arange(n)
    while heap:
        v, x, y = heappop(heap)
        if near[x].get(y) != -v:
            continue  # a cluster since merged, or a score since fallen
        for z, w in near[y].items():
            del near[z][y]
            if z != x and z in near[x]:
                if w < near[x][z]:
                    near[x][z] = near[z][x] = w
                    heappush(heap, (-w, min(x, z), max(x, z)))
        for z in [z for z in near[x] if z not in near[y]]:
            del near[z][x], near[x][z]
        near[y] = {}
        root[y] = x
    for x in range(n):  # a root is smaller than what it took in
        root[x] = root[root[x]]
    return root


def parted(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest item of each item's connected component."""
    root = np.arange(n)
    while True:
        x, y = root[a], root[b]
        open_ = x != y
        if not open_.any():
            return root
        a, b, x, y = a[open_], b[open_], x[open_], y[open_]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while (root != (up := root[root])).any():
            root = up


def single(n: int, a: np.ndarray, b: np.ndarray, s: np.ndarray, merge=np.minimum) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Pairs of different items as a < b, each once, with its ``merge``d score and the number of its rows."""
    real = a != b
    key = np.minimum(a[real], b[real]).astype(np.int64) * n + np.maximum(a[real], b[real])
    order = np.argsort(key, kind="stable")
    key, s = key[order], s[real][order]
    if not len(key):
        return key, key, s, key
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    return key[first] // n, key[first] % n, merge.reduceat(s, first), np.diff(np.r_[first, len(key)])


def pair_labels(n: int, a: np.ndarray, b: np.ndarray, s: np.ndarray) -> np.ndarray:
    """The same from such pairs by connected components, which are independent."""
    label = np.arange(n)
    if not len(a):
        return label
    comp = parted(n, a, b)
    order = np.argsort(comp[a], kind="stable")
    a, b, s = a[order], b[order], s[order]
    members = np.argsort(comp, kind="stable")
    where = comp[members]
    ends = np.flatnonzero(np.r_[True, comp[a[1:]] != comp[a[:-1]], True])
    for lo, hi in zip(ends[:-1], ends[1:], strict=True):
        ids = members[slice(*np.searchsorted(where, comp[a[lo]] + np.arange(2)))]
        label[ids] = ids[_component_labels(len(ids), np.searchsorted(ids, a[lo:hi]), np.searchsorted(ids, b[lo:hi]), s[lo:hi])]
    return label


def _component_labels(n: int, a: np.ndarray, b: np.ndarray, s: np.ndarray) -> np.ndarray:
    """Merges above a score depend on the pairs above it alone: in a component too large for a matrix these are done first, and what they leave is a smaller graph."""
    high = (s > s.min()) & (s >= np.median(s))
    cells = n * (n - 1) // 2
    if n <= MATRIX or not high.any():
        if cells > 8 * len(s) + 1000:
            return heap_labels(n, a, b, s)
        flat = np.zeros(cells)
        flat[a * (2 * n - a - 1) // 2 - a - 1 + b] = s
        return matrix_labels(flat, n)
    label = pair_labels(n, a[high], b[high], s[high])
    roots, now = np.unique(label, return_inverse=True)
    held = np.bincount(now)
    x, y, least, rows = single(len(roots), now[a], now[b], s)
    whole = rows == held[x] * held[y]  # others can't merge any more, nor can what they become part of
    return roots[pair_labels(len(roots), x[whole], y[whole], least[whole])[now]]


def complete_linkage(n: int, pairs: list[tuple[int, int, float]]) -> list[int]:
    """Clusters of 0..n-1 by complete linkage on distance 1 - score, cut at 1: two clusters merge only while every pair of theirs has a score; best first, ties by index."""
    a, b, s = (np.array(c, t) for c, t in zip(zip(*pairs, strict=True) if pairs else ((), (), ()), (np.int64, np.int64, float), strict=True))
    return scored_labels(n, a, b, s).tolist()


def scored_labels(n: int, a: np.ndarray, b: np.ndarray, s: np.ndarray) -> np.ndarray:
    """``pair_labels`` from rows in any order: of a pair's scores the best counts, and none that is not above 0."""
    good = s > 0
    return pair_labels(n, *single(n, a[good], b[good], s[good], np.maximum)[:3])


def _rows(n: int, start: np.ndarray, score: Callable) -> Iterator[tuple[int, np.ndarray]]:
    """(i, least scores of cluster i + 0, 1, ... to the clusters from i on) of items in the order of clusters, which begin at ``start``; ``score`` gives the scores of items lo..hi to items from..n."""
    of = np.repeat(np.arange(len(start)), np.diff(np.r_[start, n]))
    step, held = max(1, CELLS // n), None
    for lo in range(0, n, step):
        i, hi = int(of[lo]), min(n, lo + step)
        cells = score(lo, hi, int(start[i]))
        cells = np.where(cells > 0, cells, 0)
        if len(start) < n:
            cells = np.minimum.reduceat(cells, start[i:] - start[i], axis=1)
            first = np.flatnonzero(np.r_[True, of[lo + 1 : hi] != of[lo : hi - 1]])
            cells = np.minimum.reduceat(cells, first, axis=0)
            if held is not None and held[0] == i:
                cells[0] = np.minimum(cells[0], held[1])
            elif held is not None:
                yield held[0], held[1][None]
            held = None
            if hi < n and of[hi] == of[hi - 1]:  # goes on in the next stretch
                last = int(of[hi - 1])
                held, cells = (last, cells[-1, last - i :].copy()), cells[:-1]
        if len(cells):
            yield i, cells


def block_pairs(n: int, start: np.ndarray, score: Callable, at_least: float = 0.0, cut: float = 0.0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs of clusters with a score of ``at_least`` that is above ``cut``."""
    a, b, s = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]
    for i, cells in _rows(n, start, score):
        x, y = np.nonzero((cells >= at_least) & (cells > cut))
        later = y > x
        x, y = x[later], y[later]
        a.append(x + i), b.append(y + i), s.append(cells[x, y])
    return np.concatenate(a), np.concatenate(b), np.concatenate(s)


def block_labels(n: int, score: Callable, cut: float = 0.0, label: np.ndarray | None = None) -> np.ndarray:
    """The same, above ``cut``, for items whose scores to one another a function gives: ``score(rows, columns)`` of two index arrays, symmetric.

    Goes on from the clusters ``label``, if given.  As long as a matrix would be
    too large, the best scores are held as pairs and merged first: a sample of
    clusters only guesses how many scores are that high, and whatever the guess,
    all of them are taken.  The scores are computed again each time.
    """
    label = np.arange(n) if label is None else label
    while n:
        order = np.argsort(label, kind="stable")
        roots, start = np.unique(label[order], return_index=True)
        m = len(roots)
        if m == 1:
            break
        block = lambda lo, hi, since: score(order[lo:hi], order[since:])  # noqa: B023, E731
        cells, now = m * (m - 1) // 2, None
        if m > MATRIX:
            some = np.concatenate([np.minimum.reduceat(score(order[lo:hi], order), start, axis=1).min(axis=0) for lo, hi in _some(start, n)])
            some = some[some > cut]
            high = np.quantile(some, max(0.0, 1 - PAIRS / cells)) if len(some) and PAIRS < cells else cut
            if (some >= high).sum() > 0.5 * len(some) and PAIRS < cells // 4:  # one score is that of very many pairs
                high = np.nextafter(high, np.inf)
            now = pair_labels(m, *block_pairs(n, start, block, high, cut))
            label = roots[now][np.searchsorted(roots, label)]
            if high <= cut:
                break
            if len(np.unique(now)) < 0.9 * m:
                continue
            now = None
            roots, start = np.unique(label[order := np.argsort(label, kind="stable")], return_index=True)
            m = len(roots)
        flat = np.zeros(m * (m - 1) // 2)
        for i, rows in _rows(n, start, block):
            for x, row in enumerate(rows):
                j = i + x
                flat[j * (2 * m - j - 1) // 2 :][: m - 1 - j] = row[x + 1 :]
        label = roots[matrix_labels(flat, m, cut)][np.searchsorted(roots, label)]
        break
    return label


def _some(start: np.ndarray, n: int, most: int = 64) -> list[tuple[int, int]]:
    """Some clusters, spread over all, by up to 16 members each."""
    ends = np.r_[start, n]
    return [(int(ends[i]), min(int(ends[i]) + 16, int(ends[i + 1]))) for i in np.unique(np.linspace(0, len(start) - 1, most).astype(int))]
