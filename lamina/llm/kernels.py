"""Vectorised text kernels used inside Spark tasks.

A kernel sees one slice of an Arrow batch (at most ``SLICE_BYTES`` of text unless a single
text is longer) so that its temporaries stay small whatever the batch holds. Hashes are
fixed by constants below and therefore equal on every executor and every run.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 20

_PRIME = 0x9E3779B97F4A7C15
_PRIME_INVERSE = pow(_PRIME, -1, 1 << 64)
_powers: dict[str, np.ndarray] = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def power(kind: str, n: int) -> np.ndarray:
    """The first ``n`` powers of a fixed odd number (``up``) or of its inverse (``down``)."""
    have = _powers[kind]
    if len(have) < n:
        base = np.full(max(n, SLICE_BYTES), _PRIME if kind == "up" else _PRIME_INVERSE, np.uint64)
        base[0] = 1
        have = _powers[kind] = np.multiply.accumulate(base)
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(33))
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def stream(seed: int, n: int) -> np.ndarray:
    """``n`` fixed pseudo-random 64-bit numbers."""
    return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(_PRIME) + np.uint64(seed * 0x632BE59BD9B4E019 % 2**64))


# A word is a run of digits, ASCII letters and non-ASCII characters; A-Z count as a-z.
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
IS_WORD = np.zeros(256, bool)
IS_WORD[48:58] = IS_WORD[97:123] = IS_WORD[65:91] = True
IS_WORD[128:] = True
_BYTE_CODE = stream(11, 256)[_LOWER] | np.uint64(1)
_BYTE_CODE[~IS_WORD] = 0


@dataclass
class Texts:
    """Some texts of a batch: their UTF-8 bytes end to end, and ``n + 1`` offsets into them."""

    first: int
    data: np.ndarray
    offsets: np.ndarray

    def __len__(self) -> int:
        return len(self.offsets) - 1


def text_slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[Texts]:
    """Cut a string column into slices; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    n = len(column)
    if not n:
        return
    _, where, payload = column.buffers()
    offsets = np.frombuffer(where, np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(payload, np.uint8) if payload is not None and payload.size else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        to = int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1
        to = min(max(to, at + 1), n)
        yield Texts(at, data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at])
        at = to


@dataclass
class Words:
    """Words of some texts: hash, byte range, and for each text its range of words."""

    hashes: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    bounds: np.ndarray


def words_of(texts: Texts) -> Words:
    data, offsets = texts.data, texts.offsets
    n = len(data)
    if not n:
        none = np.zeros(0, np.int64)
        return Words(np.zeros(0, np.uint64), none, none, np.zeros(len(offsets), np.int64))
    inside = IS_WORD[data]
    left = np.empty(n, bool)
    left[0] = False
    left[1:] = inside[:-1]
    edges = offsets[:-1][offsets[:-1] < n]
    left[edges] = False
    starts = np.flatnonzero(inside & ~left)
    right = np.empty(n, bool)
    right[-1] = False
    right[:-1] = inside[1:]
    right[edges[edges > 0] - 1] = False
    ends = np.flatnonzero(inside & ~right) + 1
    bounds = np.searchsorted(starts, offsets)
    if not len(starts):
        return Words(np.zeros(0, np.uint64), starts, ends, bounds)
    codes = _BYTE_CODE[data]
    codes *= power("up", n)
    hashes = np.add.reduceat(codes, starts)
    hashes *= power("down", n)[starts]
    return Words(mix(hashes), starts, ends, bounds)


def gram_hashes(words: np.ndarray, n: int, seed: int = 23) -> np.ndarray:
    """Hash of the ``n`` words from each position on; shorter than ``words`` by ``n - 1``."""
    count = len(words) - n + 1
    if count <= 0:
        return np.zeros(0, np.uint64)
    factors = stream(seed, n) | np.uint64(1)
    total = words[:count] * factors[0]
    for k in range(1, n):
        total += words[k : k + count] * factors[k]
    return mix(total)


def shingles_of(words: Words, n: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of word ``n``-grams of each text, end to end, and bounds for each text.

    A text of 1 to ``n - 1`` words has one shingle, all its words; one without words has none.
    """
    bounds = words.bounds
    counts = np.diff(bounds)
    per = np.where(counts >= n, counts - n + 1, (counts > 0).astype(np.int64))
    at = np.zeros(len(bounds), np.int64)
    np.cumsum(per, out=at[1:])
    out = np.zeros(int(at[-1]), np.uint64)
    full = np.repeat(counts >= n, per)
    source = np.arange(len(out)) - np.repeat(at[:-1], per) + np.repeat(bounds[:-1], per)
    grams = gram_hashes(words.hashes, n)
    out[full] = grams[source[full]]
    for k in np.flatnonzero((counts > 0) & (counts < n)):
        own = words.hashes[bounds[k] : bounds[k + 1]]
        out[at[k]] = gram_hashes(own, len(own), seed=29 + len(own))[0]
    return out, at


def minhash(shingles: np.ndarray, bounds: np.ndarray, size: int) -> np.ndarray:
    """MinHash values, a row of ``size`` uint32 for each text; a text without shingles has all ones."""
    full = np.diff(bounds) > 0
    out = np.full((len(bounds) - 1, size), 0xFFFFFFFF, np.uint32)
    if full.any():
        starts = bounds[:-1][full]
        rows = np.empty((size, len(starts)), np.uint32)
        for k, factor in enumerate(stream(37, size) | np.uint64(1)):
            rows[k] = np.minimum.reduceat(shingles * factor, starts) >> np.uint64(32)
        out[full] = rows.T
    return out
