"""64-bit hashes of all words of a text, and of all runs of n words, without a loop over them."""

from __future__ import annotations

import numpy as np

U = np.uint64
_LETTERS = np.random.default_rng(20).integers(1, 1 << 63, size=256, dtype=np.uint64)
#: Odd, so that it has an inverse modulo 2 ** 64.
_BASE = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
_SPACES = np.zeros(256, dtype=bool)
_SPACES[[9, 10, 11, 12, 13, 32]] = True


class _Powers:
    """Powers of a base and of its inverse, grown to the longest text seen."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, dtype=U)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            n = max(n, 2 * len(self.up))
            self.up = np.cumprod(np.concatenate([[U(1)], np.full(n, self.base, dtype=U)]), dtype=U)
            self.down = np.cumprod(np.concatenate([[U(1)], np.full(n, self.inverse, dtype=U)]), dtype=U)
        return self.up, self.down


_POWERS = tuple(_Powers(b) for b in _BASE)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def _ranges(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, which: int) -> np.ndarray:
    """Polynomial hash of each range of values, the same wherever the range stands."""
    up, down = _POWERS[which].upto(len(values) + 1)
    sums = np.concatenate([[U(0)], np.cumsum(values * up[: len(values)], dtype=U)])
    return mixed((sums[ends] - sums[starts]) * down[starts])


def word_hashes(text: str | None, lower: bool = False) -> np.ndarray:
    """A hash of each word of the text, in order; `lower` turns A-Z into a-z first."""
    data = np.frombuffer((text or "").encode("utf-8", "replace"), dtype=np.uint8)
    if lower:
        data = data + (((data >= 65) & (data <= 90)) * np.uint8(32))
    inside = np.concatenate([[False], ~_SPACES[data], [False]])
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edges[::2], edges[1::2]
    return _ranges(_LETTERS[data], starts, ends, 0) ^ mixed((ends - starts).astype(U))


def run_hashes(words: np.ndarray, n: int, which: int = 0) -> np.ndarray:
    """A hash of the n words from each position on; `which` chooses one of two independent hashes."""
    count = len(words) - n + 1
    if count <= 0:
        return np.zeros(0, dtype=U)
    starts = np.arange(count)
    return _ranges(mixed(words + U(which)), starts, starts + n, which)
