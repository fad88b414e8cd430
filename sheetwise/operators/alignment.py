"""Order-keeping alignment of two lists, exact at any length.

Wanted are the pairs of places, rising in both lists, whose weights add up to most. Where few places agree, the agreeing
ones are held as points: taken from the last row to the first, each adds its weight to the best chain behind it, which a
threshold list (equal weights) or a tree of maxima (other weights) tells. Where many agree, rows of the plain table are
computed instead and only every FAN-th one is kept; the stretch between two kept rows is done again when the path enters
it. So memory grows with the points or with the lists' lengths, never with their product. Ties are settled alike in
both: a pair is taken where it is as good as anything, otherwise the old list's entry is passed over first.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import defaultdict
from collections.abc import Callable, Sequence

import numpy as np

#: Points per entry of both lists up to which points are held; cells of a table that is filled at once; rows kept of a longer one.
SPARSE, CELLS, FAN = 16, 1 << 18, 16
NONE = np.zeros((0, 2), np.int64)


def longest_behind(i: np.ndarray, j: np.ndarray) -> list[int]:
    """For each point (rows falling), how many points the longest chain behind it has."""
    tops: list[int] = []  # tops[k]: minus the last column at which a chain of k + 1 points begins
    behind, rows, columns, at = [], i.tolist(), j.tolist(), 0
    while at < len(rows):
        end = at
        while end < len(rows) and rows[end] == rows[at]:
            behind.append(bisect_left(tops, -columns[end]))
            end += 1
        for k in range(at, end):  # a row's points can't follow each other
            n = behind[k]
            if n == len(tops):
                tops.append(-columns[k])
            elif -columns[k] < tops[n]:
                tops[n] = -columns[k]
        at = end
    return behind


def heaviest_behind(i: np.ndarray, j: np.ndarray, weight: np.ndarray) -> list[float]:
    """For each point (rows falling), the weight of the heaviest chain behind it, by a tree of maxima over columns."""
    size = int(j.max()) + 2
    tree = [0.0] * (size + 1)
    behind, rows, columns, weights, at = [], i.tolist(), j.tolist(), weight.tolist(), 0
    while at < len(rows):
        end = at
        while end < len(rows) and rows[end] == rows[at]:
            k, best = size - 1 - columns[end], 0.0  # columns after this one
            while k > 0:
                best = tree[k] if tree[k] > best else best
                k &= k - 1
            behind.append(best)
            end += 1
        for p in range(at, end):
            k, total = size - columns[p], behind[p] + weights[p]
            while k <= size:
                tree[k] = total if total > tree[k] else tree[k]
                k += k & -k
        at = end
    return behind


def through_points(i: np.ndarray, j: np.ndarray, weight: np.ndarray | None = None) -> np.ndarray:
    """The best chain of points (row, column, weight; without weights all count 1)."""
    if not len(i):
        return NONE
    order = np.lexsort((j, -i))
    i, j = i[order], j[order]
    behind = longest_behind(i, j) if weight is None else heaviest_behind(i, j, weight[order])
    levels = defaultdict(list)
    for a, b, w, rest in zip(i.tolist(), j.tolist(), [1] * len(i) if weight is None else weight[order].tolist(), behind):
        levels[w + rest].append((a, b, rest))
    found, row, column, total = [], 0, 0, max(levels)
    while total > 0:
        best = [p for p in levels[total] if p[0] >= row and p[1] >= column]
        # Rows are passed over while that costs nothing; a pair in this very column comes first.
        here = [p for p in best if p[1] == column]
        last = max(p[0] for p in best)
        a, b, total = min(here) if here else min((p for p in best if p[0] == last), key=lambda p: p[1])
        found.append((a, b))
        row, column = a + 1, b + 1
    return np.array(found, np.int64).reshape(-1, 2)


def through_rows(n: int, m: int, weights: Callable[[int], np.ndarray | None]) -> np.ndarray:
    """The best chain where row i pairs with column j at weights(i)[j] (0: not at all; None: a row without pairs)."""
    found: list[tuple[int, int]] = []

    def above(i: int, below: np.ndarray, column: int) -> tuple[np.ndarray | None, np.ndarray]:
        w = weights(i)
        if w is None:
            return None, below
        w = w[column:]
        best = np.zeros_like(below)
        best[:-1] = np.maximum.accumulate(np.maximum(below[:-1], np.where(w > 0, w + below[1:], 0))[::-1])[::-1]
        return w, best

    def walk(start: int, end: int, below: np.ndarray, column: int) -> int:
        """Follow the path from (start, column) to row `end`, whose best sums from `column` on are `below`; its column there."""
        first = column
        if (end - start) * len(below) > CELLS and end - start > 1:
            cuts = sorted({start + (end - start) * k // FAN for k in range(FAN + 1)})
            kept = {end: below}
            for a, b in zip(cuts[-2::-1], cuts[:0:-1]):
                row = kept[b]
                for i in range(b - 1, a - 1, -1):
                    row = above(i, row, first)[1]
                kept[a] = row
            for a, b in zip(cuts, cuts[1:]):
                column = walk(a, b, kept.pop(b)[column - first :], column)
            return column
        rows, best = [], [below]
        for i in range(end - 1, start - 1, -1):
            w, row = above(i, best[-1], first)
            rows.append(w)
            best.append(row)
        rows.reverse()
        best.reverse()
        i = start
        while i < end and column < m and best[i - start][column - first] > 0:
            k, w = i - start, rows[i - start]
            own = best[k][column - first]
            if w is not None and w[column - first] > 0 and own == w[column - first] + best[k + 1][column - first + 1]:
                found.append((i, column))
                i, column = i + 1, column + 1
            elif own == best[k + 1][column - first]:
                i += 1
            else:
                column += 1
        return column

    if n and m:
        walk(0, n, np.zeros(m + 1), 0)
    return np.array(found, np.int64).reshape(-1, 2)


def matched(old: Sequence[str], new: Sequence[str]) -> np.ndarray:
    """Places (old, new) of a longest common subsequence, in order."""
    number: dict[str, int] = {}
    a, b = (np.array([number.setdefault(x, len(number)) for x in side], np.int64) for side in (old, new))
    if not len(a) or not len(b):
        return NONE
    by_entry = np.argsort(b, kind="stable")
    counts = np.bincount(b, minlength=len(number))
    starts = np.cumsum(counts) - counts
    if counts[a].sum() <= SPARSE * (len(a) + len(b)):
        i = np.repeat(np.arange(len(a)), counts[a])
        nth = np.arange(len(i)) - np.repeat(np.cumsum(counts[a]) - counts[a], counts[a])
        return through_points(i, by_entry[np.repeat(starts[a], counts[a]) + nth])

    def equal(i: int) -> np.ndarray | None:
        return (b == a[i]).astype(np.float64) if counts[a[i]] else None

    return through_rows(len(a), len(b), equal)


class Likeness:
    """Dice similarities of one word set with many, by postings of the many's words; two empty sets are alike."""

    def __init__(self, kinds: Sequence[frozenset[str]]) -> None:
        self.sizes, postings = np.array([len(k) for k in kinds], np.int64), defaultdict(list)
        for place, own in enumerate(kinds):
            for w in own:
                postings[w].append(place)
        self.postings = {w: np.array(p, np.int64) for w, p in postings.items()}

    def of(self, own: frozenset[str], threshold: float) -> np.ndarray:
        """Similarities from the threshold on, 0 for smaller ones."""
        met = [self.postings[w] for w in own if w in self.postings]
        shared = np.bincount(np.concatenate(met), minlength=len(self.sizes)) if met else np.zeros(len(self.sizes), np.int64)
        total = self.sizes + len(own)
        like = np.divide(2.0 * shared, total, out=np.ones(len(total)), where=total > 0)
        like[like < threshold] = 0
        return like


def alike(old: Sequence[frozenset[str]], new: Sequence[frozenset[str]], threshold: float) -> np.ndarray:
    """Places (old, new), in order, of the word sets whose similarities, from the threshold on, add up to most."""
    if not len(old) or not len(new):
        return NONE
    likeness = Likeness(new)
    rows, columns, weights, held = [], [], [], 0
    for i, own in enumerate(old):
        like = likeness.of(own, threshold)
        j = np.flatnonzero(like)
        rows.append(np.full(len(j), i))
        columns.append(j)
        weights.append(like[j])
        held += len(j)
        if held > SPARSE * (len(old) + len(new)):
            return through_rows(len(old), len(new), lambda k: likeness.of(old[k], threshold))
    return through_points(np.concatenate(rows), np.concatenate(columns), np.concatenate(weights))
