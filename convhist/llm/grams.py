"""Content-selected anchors of long repeats, and the table flow that finds which of them recur.

A repeat of `length` symbols holds `length - gram + 1` grams. The least gram hash among them, with all its ties, is
selected wherever the repeat stands, as the choice depends on its symbols alone. So two equal windows share an anchor
at the same place inside them, and it is enough to compare windows around anchors whose hash recurs: no repeat is
missed, and about two symbols in `length - gram` become rows instead of all.

A context is what surrounds an anchor as far as a window that holds it can reach. Equal contexts are one class; a class
is compared by one member.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

_BASE = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1342543DE82EF95))
_TOP = np.uint64(0xFFFFFFFFFFFFFFFF)
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


def _power(lane: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base^i and base^-i for i < n."""
    have = _powers.get(lane)
    if have is None or len(have[0]) < n:
        size = max(n, 1 << 16)
        base = int(_BASE[lane])
        pair = []
        for b in (base, pow(base, -1, 1 << 64)):
            p = np.full(size, b, dtype=np.uint64)
            p[0] = 1
            pair.append(np.multiply.accumulate(p))
        have = (pair[0], pair[1])
        if size <= 1 << 23:
            _powers[lane] = have
    return have


class Prefix:
    """Hashes of any range of a symbol array in constant time, from prefix sums of a polynomial modulo 2^64."""

    def __init__(self, symbols: np.ndarray, lane: int = 0):
        n = len(symbols)
        up, self.down = _power(lane, n + 1)
        self.sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(symbols * up[:n], out=self.sums[1:])

    def ranges(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.down[start] + (end - start).astype(np.uint64))

    def grams(self, size: int) -> np.ndarray:
        n = len(self.sums) - size
        return mix((self.sums[size:] - self.sums[:n]) * self.down[:n])


_rng = np.random.default_rng(20240501)
BYTE_SYMBOLS = [_rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1) for _ in _BASE]


def sliding(a: np.ndarray, width: int, least: bool) -> np.ndarray:
    """Minimum (or maximum) of each window of `width`, with one running pass from each end of blocks."""
    op, fill = (np.minimum, _TOP) if least else (np.maximum, np.uint64(0))
    n = len(a)
    padded = np.full(-(-n // width) * width, fill, dtype=np.uint64)
    padded[:n] = a
    blocks = padded.reshape(-1, width)
    ahead = op.accumulate(blocks, axis=1).ravel()
    behind = op.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return op(behind[: n - width + 1], ahead[width - 1 : n])


@dataclass(frozen=True)
class Windows:
    """Windows of `length` symbols and the grams that anchor them; `starts` is the number of windows that hold a gram."""

    length: int
    gram: int

    @property
    def starts(self) -> int:
        return self.length - self.gram + 1


def anchors(first: Prefix, ends: np.ndarray, windows: Windows) -> tuple[np.ndarray, np.ndarray]:
    """Positions of anchors in a flat array of documents and their hashes. ends: for each position its document's end."""
    n = len(ends)
    if n < windows.length:
        return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.uint64)
    hashes = first.grams(windows.gram) | np.uint64(1)
    low = sliding(hashes, windows.starts, True)
    whole = np.arange(len(low)) + windows.length <= ends[: len(low)]
    low[~whole] = 0
    pad = np.zeros(windows.starts - 1, dtype=np.uint64)
    high = sliding(np.concatenate((pad, low, pad)), windows.starts, False)
    at = np.flatnonzero(hashes == high)
    return at, hashes[at]


def contexts(at: np.ndarray, begins: np.ndarray, ends: np.ndarray, windows: Windows) -> tuple[np.ndarray, np.ndarray]:
    """How many symbols of the anchor's document belong to its context, before it and from it on."""
    left = np.minimum(at - begins[at], windows.starts - 1)
    right = np.minimum(ends[at] - at, windows.length)
    return left, right
