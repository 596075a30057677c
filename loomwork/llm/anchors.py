"""Pieces of documents that are comparable wherever they occur.

A document is a row of units (words or bytes). Of each window of units the anchor is the smallest hash among the
short runs of ``k`` units in it, the leftmost if several tie. Equal windows have equal anchors at equal places, so
a window can only recur where its anchor recurs. Neighbouring windows with the same anchor make one *piece*: about
one for each half window of text stands for all windows of the corpus.

A piece has two 64-bit hashes from unlike bases: ``m`` of its anchor, and ``s`` of all its units, its length and
the anchor's place. Equal pieces agree in both; unequal ones agree in 128 bits by accident only.
"""

from __future__ import annotations

import numpy as np

#: Windows handled at a time; bounds the memory of a document of any length.
CHUNK = 1 << 17
_BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
_MASK = (1 << 64) - 1
_PLACE = np.uint64(20)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.empty(n, np.uint64)
    out[0] = 1
    out[1:] = base
    return np.multiply.accumulate(out)


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


class Anchors:
    def __init__(self, k: int, window: int) -> None:
        self.k, self.window, self.span = k, window, window - k + 1
        size = CHUNK + window + 1
        self.up = [_powers(b, size) for b in _BASES]
        self.down = [_powers(pow(b, -1, 1 << 64), size) for b in _BASES]

    def sums(self, units: np.ndarray, base: int) -> np.ndarray:
        out = np.zeros(units.size + 1, np.uint64)
        np.cumsum(units * self.up[base][: units.size], out=out[1:])
        return out

    def of_windows(self, units: np.ndarray) -> np.ndarray:
        """The hash of each window, in the second base. At most CHUNK windows."""
        c = self.sums(units, 1)
        n = units.size - self.window + 1
        return mixed((c[self.window :] - c[:-self.window]) * self.down[1][:n])

    def pieces(self, units: np.ndarray) -> tuple[np.ndarray, ...]:
        """m, s, first window and number of windows of each piece, and the anchor's distance from the first."""
        n = units.size - self.window + 1
        if n <= 0:
            none = np.zeros(0, np.int64)
            return none, none, none, none, none
        found = [self._some(units[lo : min(lo + CHUNK, n) + self.window - 1], lo) for lo in range(0, n, CHUNK)]
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))

    def _some(self, units: np.ndarray, lo: int) -> tuple[np.ndarray, ...]:
        c = self.sums(units, 0)
        of_anchor = mixed((c[self.k :] - c[: -self.k]) * self.down[0][: units.size - self.k + 1])
        best = (of_anchor >> _PLACE << _PLACE) | np.arange(of_anchor.size, dtype=np.uint64)
        size = 1
        while size * 2 <= self.span:
            best = np.minimum(best[:-size], best[size:])
            size *= 2
        if size < self.span:
            best = np.minimum(best[: size - self.span], best[self.span - size :])
        at = (best & np.uint64((1 << 20) - 1)).astype(np.int64)
        first = np.append(0, np.flatnonzero(at[1:] != at[:-1]) + 1)
        n = np.diff(np.append(first, at.size))
        at = at[first]
        c = self.sums(units, 1)
        s = (c[first + n + self.window - 1] - c[first]) * self.down[1][first]
        s = mixed(s + mixed((n << 20 | (at - first)).astype(np.uint64)))
        return of_anchor[at].view(np.int64), s.view(np.int64), first + lo, n, at - first
