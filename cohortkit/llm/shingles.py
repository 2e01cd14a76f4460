"""Word-shingle sets as 64-bit hashes, a few NumPy passes per text."""

from __future__ import annotations

import numpy as np

_RNG = np.random.default_rng(20240229)
_BYTE = _RNG.integers(1, 2**63, 256, dtype="u8") * np.uint64(2) + np.uint64(1)
_STEP = np.uint64(0x9E3779B97F4A7C15)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype="u1")
_LOWER[65:91] += 32
_PLACE = _RNG.integers(1, 2**63, 64, dtype="u8") * np.uint64(2) + np.uint64(1)


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values so that all bits depend on all bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(text: str) -> np.ndarray:
    """A hash of each word (runs without the six ASCII white spaces), A-Z lower-cased."""
    b = np.frombuffer(text.encode("utf-8", "surrogatepass"), "u1")
    inside = ~_SPACE[b]
    b = _LOWER[b[inside]]
    if not len(b):
        return np.zeros(0, "u8")
    at = np.flatnonzero(inside)
    starts = np.flatnonzero(np.diff(at, prepend=-2) > 1)
    lengths = np.diff(starts, append=len(b))
    place = np.arange(len(b)) - np.repeat(starts, lengths)
    powers = np.cumprod(np.full(int(lengths.max()), _STEP))
    return mix(np.add.reduceat(_BYTE[b] * powers[place], starts) + lengths.astype("u8"))


def shingle_set(text: str | None, n: int) -> np.ndarray:
    """Sorted distinct hashes of the ``n``-word shingles; a shorter text is one shingle, no words are none."""
    words = word_hashes(text) if text else np.zeros(0, "u8")
    k = min(n, len(words))
    if not k:
        return words
    total = np.full(len(words) - k + 1, np.uint64(k))
    for i in range(k):
        total = total + words[i : len(words) - k + 1 + i] * _PLACE[i]
    return np.unique(mix(total))
