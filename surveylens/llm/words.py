"""ASCII-whitespace words of texts as 64-bit hashes, and n-gram hashes over them."""

from __future__ import annotations

import numpy as np
import xxhash

from surveylens.llm.common import mix64

MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
#: A word table is started anew beyond this many entries.
TABLE_WORDS = 1 << 16


class WordHashes(dict):
    """word (UTF-8 bytes) -> 64-bit hash, computed when first asked for."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= TABLE_WORDS:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def lower_ascii(text: str) -> bytes:
    """UTF-8 with A-Z in lower case (bytes.lower touches ASCII letters only)."""
    return text.encode("utf-8", "replace").lower()


def ngram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of every window of ``n`` words; empty if there are fewer."""
    m = len(words) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    acc = words[:m].copy()
    with np.errstate(over="ignore"):
        for j in range(1, n):
            acc *= MULTIPLIER
            acc += words[j:m + j]
    return mix64(acc)
