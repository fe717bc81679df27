"""Similarity of two texts: twice the characters in matching blocks over all characters.

The longest common block is taken, of several the one that starts first in the first text and then in the second, and so on
with what is left of it and right of it. Blocks of long texts are found by exact names of their substrings of length 1, 2, 4, ...
(equal substrings, and only they, have equal names; two of them name any length), with a search for the largest length at which
both ranges share a name, never more than in the range around. Short ranges are searched by the substrings themselves.
"""

from __future__ import annotations

from collections import Counter
from functools import lru_cache
from os.path import commonprefix

import numpy as np

#: Ranges with so many pairs of positions, or fewer, are searched by their substrings.
SMALL = 4_000_000


def most_alike(a: str, b: str) -> float:
    """What their ratio cannot exceed, by their characters alone."""
    if not a and not b:
        return 1.0
    return 2 * (Counter(a) & Counter(b)).total() / (len(a) + len(b))


@lru_cache(maxsize=64)
def _places(a: str) -> dict[str, int]:
    """Where each character stands, as the bits of a number."""
    out: dict[str, int] = {}
    for i, c in enumerate(a):
        out[c] = out.get(c, 0) | 1 << i
    return out


def at_most(a: str, b: str) -> float:
    """What their ratio cannot exceed, by their longest common subsequence: matching blocks stand in the same order in both."""
    if not a and not b:
        return 1.0
    places, every = _places(a), (1 << len(a)) - 1
    free = every
    for c in b:
        taken = free & places.get(c, 0)
        free = (free + taken | free - taken) & every
    return 2 * (len(a) - free.bit_count()) / (len(a) + len(b))


def _longest_small(a: str, b: str, at: int, a_end: int, b_at: int, b_end: int, most: int) -> tuple[int, int, int]:
    """(length, start in a, start in b) of the longest common block of two short ranges, of which none is longer than most.

    A common block holds common blocks of every smaller length, so the length is searched for, from what the ranges share at
    their ends: where that is the longest, as in most edited texts, two looks are enough.
    """
    x, y = a[at:a_end], b[b_at:b_end]
    most = min(most, len(x), len(y))

    def first(n: int) -> int:
        known = {y[j : j + n] for j in range(len(y) - n + 1)}
        return next((i for i in range(len(x) - n + 1) if x[i : i + n] in known), -1)

    ends = len(commonprefix((x, y))), len(commonprefix((x[::-1], y[::-1])))
    low, high, found, step = min(max(ends), most), most, -1, 1
    while low < high:  # doubling first: most blocks are much shorter than the ranges
        n = min(low + step, high) if step else (low + high + 1) // 2
        i = first(n)
        if i < 0:
            high, step = n - 1, 0
        else:
            low, found, step = n, i, 2 * step
    if not low:
        return 0, at, b_at
    if found < 0:
        found = first(low)
    return low, at + found, b_at + y.index(x[found : found + low])


class _Names:
    """Names of the substrings of two texts whose lengths are powers of two, made as they are asked for."""

    def __init__(self, a: str, b: str):
        both = np.frombuffer((a + b).encode("utf-32-le", "surrogatepass"), np.uint32)
        self.n, self.levels = len(a), [np.unique(both, return_inverse=True)[1].astype(np.int64)]

    def of(self, length: int, start: int, end: int) -> np.ndarray:
        """Names of the substrings of this length that begin and end within a range of the joined texts."""
        level = length.bit_length() - 1
        while len(self.levels) <= level:
            last, half = self.levels[-1], 1 << (len(self.levels) - 1)
            # the last places have no such substring; their names are not asked for
            pair = last[:-half] * (len(last) + 1) + last[half:]
            self.levels.append(np.unique(pair, return_inverse=True)[1].astype(np.int64))
        names, rest = self.levels[level], length - (1 << level)
        first = names[start : end - length + 1]
        return first if not rest else first * (len(self.levels[0]) + 1) + names[start + rest : end - length + 1 + rest]

    def shared(self, length: int, a: tuple[int, int], b: tuple[int, int]) -> tuple[int, int] | None:
        """Where the first block of this length that both ranges hold starts, in a and in b."""
        left, right = self.of(length, *a), self.of(length, self.n + b[0], self.n + b[1])
        hits = np.isin(left, right)
        if not (i := int(hits.argmax()), bool(hits.any()))[1]:
            return None
        return a[0] + i, b[0] + int((right == left[i]).argmax())

    def longest(self, a: tuple[int, int], b: tuple[int, int], most: int) -> tuple[int, int, int]:
        """most: no common block is longer."""
        low, high, found = 0, min(most, a[1] - a[0], b[1] - b[0]), (a[0], b[0])
        step = 1
        while low < high:  # doubling first: most blocks are much shorter than the ranges
            length = min(low + step, high) if step else (low + high + 1) // 2
            here = self.shared(length, a, b)
            if here:
                low, found, step = length, here, 2 * step
            else:
                high, step = length - 1, 0
        return low, *found


def matched(a: str, b: str) -> int:
    """How many characters stand in matching blocks."""
    total, names = 0, None
    ranges = [(0, len(a), 0, len(b), min(len(a), len(b)))]
    while ranges:
        at, a_end, b_at, b_end, most = ranges.pop()
        if at == a_end or b_at == b_end:
            continue
        if (a_end - at) * (b_end - b_at) <= SMALL:
            n, i, j = _longest_small(a, b, at, a_end, b_at, b_end, most)
        else:
            names = names or _Names(a, b)
            n, i, j = names.longest((at, a_end), (b_at, b_end), most)
        if n:
            total += n
            ranges += [(at, i, b_at, j, n), (i + n, a_end, j + n, b_end, n)]
    return total


def ratio(a: str, b: str) -> float:
    """1 for equal texts, two empty ones too. Swapping the texts may change it: blocks that start first in a win."""
    return 1.0 if a == b else 2 * matched(a, b) / (len(a) + len(b))
