"""Resampling by counts: how often a row is in a resample, from its place alone.

A population of n rows has places 0 to n - 1. The draws of a resample are split between
the two halves of the places, then between their halves, down to leaves of ``LEAF``
places, where they fall on single rows. Every split has a generator of its own, seeded
by the range of places it splits, so any task that holds some rows finds their counts
by walking down to them, and all tasks agree. The split of draws with replacement is
binomial, that of a deal without replacement hypergeometric; resamples therefore have
exactly the sizes asked for.
"""

from __future__ import annotations

import hashlib

import numpy as np

#: Rows of a leaf. Numpy draws hypergeometric numbers from fewer than 10**9 rows, so a dealt population has fewer.
LEAF = 256


class Counts:
    """Counts of all repetitions for the rows of one population.

    ``draws`` with replacement: each row's count is 0 or more. Or a deal of ``dealt`` = (a, b)
    rows to two sides without replacement: 1 for the first side, -1 for the second, 0
    for what is left over.
    """

    def __init__(self, seed: str, n: int, reps: int, draws: int | None = None, dealt: tuple[int, int] | None = None):
        if (draws is None) == (dealt is None):
            raise ValueError("either draws with replacement or a deal")
        if dealt and sum(dealt) > n:
            raise ValueError("a deal of more rows than there are")
        self.n, self.reps, self.dealt = n, reps, dealt
        self.entropy = int.from_bytes(hashlib.sha256(f"{seed}|{n}|{draws}|{dealt}".encode()).digest()[:16], "little")
        self.leaves = max(1, -(-n // LEAF))
        root = [draws] if dealt is None else list(dealt)
        self.held = {(0, self.leaves): np.array([[x] * reps for x in root], np.int64)}

    def _generator(self, first: int, last: int) -> np.random.Generator:
        return np.random.Generator(np.random.PCG64(np.random.SeedSequence([self.entropy, first, last])))

    def _rows(self, first: int, last: int) -> int:
        return min(last * LEAF, self.n) - first * LEAF

    def _node(self, leaf: int) -> np.ndarray:
        """The draws of each repetition that fall on a leaf; what was met on the way is kept until another branch is taken."""
        first, last = 0, self.leaves
        path = {(first, last): self.held[first, last]}
        while last - first > 1:
            mid = (first + last) // 2
            if (first, mid) not in self.held:
                self.held[first, mid], self.held[mid, last] = self._split(first, mid, last, self.held[first, last])
            path |= {k: self.held[k] for k in ((first, mid), (mid, last))}
            first, last = (first, mid) if leaf < mid else (mid, last)
        self.held = path
        return path[first, last]

    def _split(self, first: int, mid: int, last: int, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        rng, left, right = self._generator(first, last), self._rows(first, mid), self._rows(mid, last)
        if self.dealt is None:
            to_left = rng.binomial(counts[0], left / (left + right))[None]
        else:
            a = rng.hypergeometric(left, right, counts[0])
            to_left = np.stack((a, rng.hypergeometric(left - a, right - (counts[0] - a), counts[1])))
        return to_left, counts - to_left

    def leaf(self, number: int) -> np.ndarray:
        """Counts of the leaf's rows: repetitions by rows."""
        counts, rows = self._node(number), self._rows(number, number + 1)
        rng = self._generator(number, number)
        if self.dealt is None:
            return rng.multinomial(counts[0], np.full(rows, 1 / rows))
        order = rng.random((self.reps, rows)).argsort(axis=1).argsort(axis=1)
        return (order < counts[0][:, None]).astype(np.int64) - ((order >= counts[0][:, None]) & (order < counts.sum(axis=0)[:, None]))

    def of(self, places: np.ndarray) -> np.ndarray:
        """Counts of rows at ascending places: repetitions by rows."""
        out = np.empty((self.reps, len(places)), np.float64)
        leaves = places // LEAF
        for number in np.unique(leaves):
            own = np.flatnonzero(leaves == number)
            out[:, own] = self.leaf(int(number))[:, places[own] - number * LEAF]
        return out
