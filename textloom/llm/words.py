"""Hashes of words in whole batches of texts, without an object per word."""

from __future__ import annotations

import numpy as np

_M = 0x9E3779B97F4A7C15
_INVERSE = pow(_M, -1, 1 << 64)


class WordHasher:
    """64-bit hashes of words between ASCII white space, A-Z in lower case: equal words, equal hashes.

    A word's hash is the mixed value of a polynomial over its bytes, read off the running sums of the batch.
    """

    def __init__(self, piece: int = 1 << 19):
        self.piece = piece  # bytes hashed at once (more for a longer text)
        self.up = self.down = np.ones(0, np.uint64)

    def _powers(self, n: int) -> None:
        if len(self.up) < n:
            n = max(n, 2 * self.piece)
            for name, base in (("up", _M), ("down", _INVERSE)):
                x = np.full(n, base, np.uint64)
                x[0] = 1
                setattr(self, name, np.multiply.accumulate(x))

    def _hash(self, parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        data = (b" ".join(parts) + b" ").lower()
        b = np.frombuffer(data, np.uint8)
        self._powers(len(b))
        word = (b != 32) & ((b < 9) | (b > 13))
        edge = np.flatnonzero(np.diff(word, prepend=False))
        start, end = edge[::2], edge[1::2]
        total = np.cumsum((b.astype(np.uint64) + np.uint64(1)) * self.up[: len(b)])
        x = total[end - 1] - np.where(start > 0, total[start - 1], np.uint64(0))
        x = x * self.down[start] + (end - start).astype(np.uint64)
        x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        sizes = np.array([len(p) + 1 for p in parts], np.int64)
        owner = np.searchsorted(sizes.cumsum(), start, side="right")
        return x ^ (x >> np.uint64(31)), np.bincount(owner, minlength=len(parts))

    def each(self, words: list[bytes]) -> np.ndarray:
        """Hashes of single words (without white space)."""
        parts = [self._hash([b" ".join(words[i : i + 50_000])])[0] for i in range(0, len(words), 50_000)]
        return np.concatenate([np.zeros(0, np.uint64), *parts])

    def words(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(hashes of all words in order, number of words by text)."""
        hashes, counts, held, size = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [], 0
        for t in [*texts, None]:
            if t is not None:
                held.append(t.encode("utf-8", "surrogatepass"))
                size += len(held[-1])
            if held and (t is None or size >= self.piece):
                h, c = self._hash(held)
                hashes.append(h)
                counts.append(c)
                held, size = [], 0
        return np.concatenate(hashes), np.concatenate(counts)
