"""The similarity ratio of the standard library's SequenceMatcher, found from the places of rare characters.

From 200 characters on, SequenceMatcher leaves characters out of its index that make up more than a hundredth of the
second text; a longest match is then the longest run of indexed characters that both texts hold, the first one of those
in the first text and then in the second, extended to both sides by any equal characters. Runs of k indexed characters
are listed by their text, so the longest shared one is found by looking runs up and doubling k, not by counting along
all pairs of places. Matches, and so ratios, are the same.
"""

from __future__ import annotations

from bisect import bisect_left

import numpy as np

NONE = np.zeros(0, np.int64)


def _right(places: list[int]) -> list[int]:
    """How many places on end begin with each one."""
    out = [1] * len(places)
    for at in range(len(places) - 2, -1, -1):
        if places[at + 1] == places[at] + 1:
            out[at] = out[at + 1] + 1
    return out


def indexed_characters(text: str) -> str:
    """The characters of a second text that matches start at."""
    n = len(text)
    return "".join(c for c in set(text) if n < 200 or text.count(c) <= n // 100 + 1)


class Text:
    """A text, where its characters stand, and its runs of indexed characters."""

    def __init__(self, text: str, indexed: str | None = None):
        self.text = text
        self._indexed = indexed
        self._arrays: dict[str, np.ndarray] = {}
        self._places: dict[str, list[int]] = {}
        self._starts: tuple[list[int], list[int]] | None = None
        self._runs: dict[int, dict[str, list[int]]] = {}
        self._bits: dict[str, int] = {}

    @property
    def indexed(self) -> str:
        """What a second text is indexed by; a first one is never asked."""
        if self._indexed is None:
            self._indexed = indexed_characters(self.text)
        return self._indexed

    def bits(self) -> dict[str, int]:
        """Each character's places as the bits of a number."""
        if not self._bits:
            for i, c in enumerate(self.text):
                self._bits[c] = self._bits.get(c, 0) | 1 << i
        return self._bits

    def places(self, c: str) -> list[int]:
        if c not in self._places:
            found, i = [], self.text.find(c)
            while i >= 0:
                found.append(i)
                i = self.text.find(c, i + 1)
            self._places[c] = found
        return self._places[c]

    def place_array(self, c: str) -> np.ndarray:
        if c not in self._arrays:
            self._arrays[c] = np.array(self.places(c), np.int64)
        return self._arrays[c]

    def runs(self, k: int) -> dict[str, list[int]]:
        """Places of runs of ``k`` indexed characters by their text."""
        if k not in self._runs:
            if k == 1:
                self._runs[k] = {c: self.places(c) for c in self.indexed}
                return self._runs[k]
            if self._starts is None:
                places = sorted(i for c in self.indexed for i in self.places(c))
                self._starts = places, _right(places)
            found: dict[str, list[int]] = {}
            for i, length in zip(*self._starts, strict=True):
                if length >= k:
                    found.setdefault(self.text[i : i + k], []).append(i)
            self._runs[k] = found
        return self._runs[k]


def _equal(a: str, b: str, i: int, j: int, most: int, back: bool = False) -> int:
    """Equal characters from ``i`` and ``j`` on, or before them, ``most`` at most."""
    k, step = 0, 16
    while k < most:
        size = min(step, most - k)
        same = a[i - k - size : i - k] == b[j - k - size : j - k] if back else a[i + k : i + k + size] == b[j + k : j + k + size]
        if same:
            k, step = k + size, step * 2
        elif size == 1:
            break
        else:
            step = size // 2
    return k


class _Pair:
    """Runs of the first text's characters that the second one is indexed by."""

    def __init__(self, first: Text, second: Text):
        self.a, self.second = first.text, second
        self.all = np.sort(np.concatenate([NONE, *(first.place_array(c) for c in second.indexed)]))
        self.starts: dict[int, list[int]] = {1: self.all.tolist()}

    def starts_of(self, k: int) -> list[int]:
        if k not in self.starts:
            # k places on end begin where the place k - 1 further on is k - 1 larger
            at = self.all
            self.starts[k] = at[: len(at) - k + 1][at[k - 1 :] - at[: len(at) - k + 1] == k - 1].tolist() if len(at) >= k else []
        return self.starts[k]

    def first_run(self, k: int, alo: int, ahi: int, blo: int, bhi: int) -> tuple[int, int] | None:
        """The first run of ``k`` indexed characters within both ranges."""
        if k > min(ahi - alo, bhi - blo):
            return None
        starts, held, a = self.starts_of(k), self.second.runs(k), self.a
        for at in range(bisect_left(starts, alo), len(starts)):
            i = starts[at]
            if i > ahi - k:
                return None
            places = held.get(a[i : i + k])
            if places:
                p = bisect_left(places, blo)
                if p < len(places) and places[p] <= bhi - k:
                    return i, places[p]
        return None

    def longest_run(self, alo: int, ahi: int, blo: int, bhi: int) -> tuple[int, int, int]:
        best, k, found = 0, 1, (alo, blo)
        while got := self.first_run(k, alo, ahi, blo, bhi):
            best, found, k = k, got, 2 * k
        low, high = best, k  # the longest run is shorter than high
        while high - low > 1:
            k = (low + high) // 2
            if got := self.first_run(k, alo, ahi, blo, bhi):
                low, best, found = k, k, got
            else:
                high = k
        return *found, best


def common_subsequence(first: Text, second: Text) -> int:
    """Characters in the longest common subsequence: a bit a character of the first text, a step one of the second."""
    bits, every = first.bits(), (1 << len(first.text)) - 1
    free = every
    for c in second.text:
        met = free & bits.get(c, 0)
        if met:
            free = free + met | free - met
    return len(first.text) - (free & every).bit_count()


def matched(first: Text, second: Text, least: float = 0.0) -> int | None:
    """Characters in the matching blocks of two texts; None as soon as they cannot be ``least``.

    What is left to match between blocks is bounded by the shorter side, so unlike texts, whose longest block stands in
    different places, are given up after a block or two. Blocks stand in one order in both texts, so they are no longer
    than a common subsequence, which is the quicker one where every character is indexed.
    """
    a, b = first.text, second.text
    total, open_ranges, hope = 0, [(0, len(a), 0, len(b))], min(len(a), len(b))
    if hope < least or (least > 0 and len(b) < 200 and common_subsequence(first, second) < least):
        return None
    pair = _Pair(first, second)
    while open_ranges:
        if hope < least:
            return None
        alo, ahi, blo, bhi = open_ranges.pop()
        hope -= min(ahi - alo, bhi - blo)
        i, j, size = pair.longest_run(alo, ahi, blo, bhi)
        before = _equal(a, b, i, j, min(i - alo, j - blo), back=True)
        i, j, size = i - before, j - before, size + before
        size += _equal(a, b, i + size, j + size, min(ahi - i - size, bhi - j - size))
        if size:
            total += size
            left, right = min(i - alo, j - blo), min(ahi - i - size, bhi - j - size)
            hope += size + left + right
            if left:
                open_ranges.append((alo, i, blo, j))
            if right:
                open_ranges.append((i + size, ahi, j + size, bhi))
    return total if total >= least else None


def ratio(first: Text, second: Text) -> float:
    """Twice the matched characters by all characters; 1 for two empty texts."""
    size = len(first.text) + len(second.text)
    return 2.0 * matched(first, second) / size if size else 1.0


def ratio_from(first: Text, second: Text, least: float) -> float | None:
    """The ratio if it is at least ``least``."""
    size = len(first.text) + len(second.text)
    total = matched(first, second, least * size / 2 - 1e-6) if size else 0
    found = None if total is None else 2.0 * total / size if size else 1.0
    return found if found is not None and found >= least else None
