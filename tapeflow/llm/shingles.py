"""Word-shingle sets of a text as sorted 64-bit hashes (one document at a time).

Words are the maximal runs of non-white-space of the text with A-Z in lower
case; white space is the ASCII set (space, \\t to \\r), which is what
``bytes.split`` cuts at and ``bytes.lower`` leaves every other letter alone.
"""

from __future__ import annotations

import numpy as np
import xxhash

MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
CACHE_WORDS = 250_000


class WordHashes(dict):
    """word → 64-bit hash, remembered for at most ``CACHE_WORDS`` words."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


def _mix(h: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser: spreads every input bit over the word."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingle_set(text: str | None, hashes: WordHashes, width: int = 5) -> np.ndarray:
    """Distinct shingle hashes, ascending (int64).  A text with fewer than
    ``width`` words has its whole word sequence as the only shingle; no words
    (or no text) give the empty set."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return np.empty(0, np.int64)
    h = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    span = min(width, len(h))
    acc = np.full(len(h) - span + 1, span, np.uint64)
    for j in range(span):
        acc = acc * MULTIPLIER + h[j:len(h) - span + 1 + j]
    return np.unique(_mix(acc).view(np.int64))
