"""Word hashes of whole batches of texts, for near-duplicates and decontamination."""

from __future__ import annotations

import numpy as np
import xxhash

from foliospark.llm.common import WORD

_MIX1, _MIX2, _STEP = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)
_BASE = np.uint64(0x9E3779B185EBCA87)


class WordHashes(dict):
    """word -> 64-bit hash, remembered; forgotten as a whole when it gets large."""

    LIMIT = 400_000

    def __missing__(self, word: str) -> int:
        if len(self) >= self.LIMIT:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


_hashes = WordHashes()


def words_of(text: str | None) -> list[str]:
    return WORD.findall(text.lower()) if text else []


def hash_words(words: list[str]) -> np.ndarray:
    return np.fromiter(map(_hashes.__getitem__, words), np.uint64, len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * _MIX1
    x = (x ^ (x >> np.uint64(27))) * _MIX2
    return x ^ (x >> np.uint64(31))


def grams(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of n words; of all the words together where there are fewer."""
    n = min(n, len(hashes))
    if not n:
        return hashes
    out = hashes[: len(hashes) - n + 1].copy()
    for k in range(1, n):
        out *= _BASE
        out += hashes[k : len(hashes) - n + 1 + k]
    return mix(out)
