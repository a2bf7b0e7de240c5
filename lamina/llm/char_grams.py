"""Hashed character n-grams of whole texts, vectorised for a slice of an Arrow batch."""

from __future__ import annotations

from functools import cache

import numpy as np

from lamina.llm.kernels import Texts, mix, stream

_CODES = 0x110000


@cache
def letter_table() -> np.ndarray:
    return np.array([chr(k).isalpha() for k in range(_CODES)])


@cache
def _fold_table() -> np.ndarray:
    """Code point to fold to: lower case for letters, a space for all else."""
    fold = np.full(_CODES, 32, np.uint32)
    for k in np.flatnonzero(letter_table()):
        low = chr(k).lower()
        fold[k] = ord(low) if len(low) == 1 else k
    return fold


class CharGrams:
    """Folded code points of some texts end to end, each text between spaces."""

    def __init__(self, texts: Texts):
        decoded = [bytes(texts.data[a:b]).decode("utf-8", "replace") for a, b in zip(texts.offsets[:-1], texts.offsets[1:], strict=True)]
        lengths = np.array([len(t) for t in decoded], np.int64)
        raw = np.frombuffer("".join(decoded).encode("utf-32-le", "surrogatepass"), np.uint32)
        ends = np.cumsum(lengths)
        self.bounds = np.concatenate([[0], ends + 2 * np.arange(1, len(decoded) + 1)])
        self.codes = np.full(int(self.bounds[-1]), 32, np.uint32)
        own = np.ones(len(self.codes), bool)
        own[self.bounds[:-1]] = own[self.bounds[1:] - 1] = False
        self.codes[own] = _fold_table()[raw]
        letters = np.concatenate([[0], np.cumsum(letter_table()[raw])])
        starts = ends - lengths
        self.has_letter = letters[ends] > letters[starts]

    def hashed(self, n: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
        """Bucket of each ``n``-gram, and for each text its range of n-grams (none cross texts)."""
        size = len(self.codes) - n + 1
        if size <= 0:
            return np.zeros(0, np.int64), np.zeros(len(self.bounds), np.int64)
        codes = self.codes.astype(np.uint64)
        factors = stream(41 + n, n) | np.uint64(1)
        total = codes[:size] * factors[0]
        for k in range(1, n):
            total += codes[k : k + size] * factors[k]
        buckets = (mix(total) >> np.uint64(64 - bits)).astype(np.int64)
        inside = np.ones(size, bool)
        for back in range(1, n):
            edge = self.bounds[1:] - back
            inside[edge[(edge < size) & (edge >= 0)]] = False
        kept = np.concatenate([[0], np.cumsum(inside)])
        return buckets[inside], kept[np.minimum(self.bounds, size)]
