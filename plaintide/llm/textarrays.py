"""Numpy views of a batch of texts: code points, words, rolling word hashes.

A word is a maximal run of characters other than space and U+0009 to U+000D.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Characters of one numpy batch; a longer text is a batch of its own.
BATCH_CHARS = 1 << 19
_BASE = 0x9E3779B97F4A7C15 | 1
_INV = pow(_BASE, -1, 1 << 64)
_powers: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over all 64 output bits."""
    with np.errstate(over="ignore"):
        x = x ^ (x >> np.uint64(30))
        x = x * np.uint64(0xBF58476D1CE4E5B9)
        x = x ^ (x >> np.uint64(27))
        x = x * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def _power(base: int, n: int) -> np.ndarray:
    have = _powers.get(str(base))
    if have is None or len(have) < n:
        with np.errstate(over="ignore"):
            grown = np.full(max(n, BATCH_CHARS + 1), base, np.uint64)
            grown[0] = 1
            have = np.cumprod(grown)
        if n <= 4 * BATCH_CHARS:
            _powers[str(base)] = have
    return have[:n]


def batches(texts: list[str | None]) -> Iterator[tuple[int, list[str]]]:
    """Slices of ``texts`` of bounded size with the index of their first; null is empty."""
    at, size, held = 0, 0, []
    for i, text in enumerate(texts):
        text = text or ""
        if held and size + len(text) > BATCH_CHARS:
            yield at, held
            at, size, held = i, 0, []
        held.append(text)
        size += len(text) + 1
    if held:
        yield at, held


class Words:
    """Words of a list of texts as flat arrays.

    ``cp`` code points of all texts, one newline after each; ``first``/``length`` of each text in it;
    ``start``/``end`` of each word; ``doc`` the text of each word; ``offset[d]:offset[d+1]`` the words of text d.
    """

    def __init__(self, texts: list[str], fold_case: bool = False) -> None:
        joined = "\n".join(texts) + "\n"
        self.cp = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        self.length = np.fromiter(map(len, texts), np.int64, len(texts))
        self.first = np.concatenate(([0], np.cumsum(self.length + 1)[:-1])).astype(np.int64)
        inside = ~((self.cp == 32) | ((self.cp >= 9) & (self.cp <= 13)))
        edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
        if len(inside) and inside[0]:
            edge = np.concatenate(([0], edge))
        self.start, self.end = edge[0::2], edge[1::2]
        self.inside = inside
        self.doc = np.searchsorted(self.first, self.start, "right") - 1
        self.offset = np.searchsorted(self.start, np.concatenate((self.first, [len(self.cp)])))
        self.fold_case = fold_case

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word's characters."""
        x = self.cp.astype(np.uint64)
        if self.fold_case:
            x = x + np.uint64(32) * ((self.cp >= 65) & (self.cp <= 90)).astype(np.uint64)
        n = len(x)
        with np.errstate(over="ignore"):
            total = np.zeros(n + 1, np.uint64)
            np.cumsum((x + np.uint64(1)) * _power(_BASE, n), out=total[1:])
            h = (total[self.end] - total[self.start]) * _power(_INV, n)[self.start]
            return mix(h + (self.end - self.start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))

    def per_text(self, flags: np.ndarray) -> np.ndarray:
        """Sum of a per-character array over each text."""
        total = np.concatenate(([0], np.cumsum(flags)))
        return total[self.first + self.length] - total[self.first]
