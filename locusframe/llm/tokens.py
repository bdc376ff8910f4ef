"""Hashes of the words of many texts at once, by numpy over their bytes."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np

#: Bytes of text hashed at a time (a longer text is taken alone).
SLICE_BYTES = 1 << 20

_BASE = 0x5851F42D4C957F2D
_BACK = pow(_BASE, -1, 1 << 64)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_SAME = np.arange(256, dtype=np.uint64) + np.uint64(1)
_LOWER = _SAME.copy()
_LOWER[65:91] = _SAME[97:123]
_SAME[_SPACE] = _LOWER[_SPACE] = 0


class _Powers:
    """Powers of the base and of its inverse, modulo 2**64, as far as they were needed."""

    def __init__(self):
        self.up = self.down = np.ones(0, np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            full = lambda x: np.cumprod(np.r_[np.uint64(1), np.full(n - 1, x, np.uint64)])
            self.up, self.down = full(_BASE), full(_BACK)
        return self.up[:n], self.down[:n]


_powers = _Powers()


def mixed(x: np.ndarray) -> np.ndarray:
    """64-bit numbers with their bits spread."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(32))


class Words:
    """Words (runs without ASCII white space) of texts: their hashes, in order, and where they lie.

    `lower`: whether A-Z count as a-z, or a table of the 256 bytes' numbers, 0 for what parts words.
    `hash`, `start`, `end`: one entry per word; `first`: number of the first word of each text, and
    the number of all words at its end; `blob`: all texts, each after a line feed.
    """

    def __init__(self, texts: Sequence[bytes], lower: bool | np.ndarray):
        self.blob = b"\n" + b"\n".join(texts) + b"\n"
        raw = np.frombuffer(self.blob, np.uint8)
        table = lower if isinstance(lower, np.ndarray) else _LOWER if lower else _SAME
        space = (table == 0)[raw]
        edge = np.diff(space.astype(np.int8))
        self.start, self.end = np.flatnonzero(edge == -1) + 1, np.flatnonzero(edge == 1) + 1
        up, down = _powers.get(len(raw))
        # Sums of byte * base**place; a word's difference, moved to place 0, does not depend on where it lies.
        total = np.cumsum(table[raw] * up)
        self.hash = mixed((total[self.end - 1] - total[self.start - 1]) * down[self.start] + (self.end - self.start).astype(np.uint64))
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        offsets = np.r_[1, 1 + np.cumsum(lengths + 1)]
        self.first = np.searchsorted(self.start, offsets)


def slices(texts: Sequence[bytes]) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about SLICE_BYTES together."""
    a = size = 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= SLICE_BYTES:
            yield a, i + 1
            a, size = i + 1, 0
    if a < len(texts):
        yield a, len(texts)
