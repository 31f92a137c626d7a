"""Word and window hashes of Arrow batches with numpy, for the tasks that run in Python."""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np

CHUNK_WORDS = 200_000
CACHE_WORDS = 300_000
M1, M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
MIX = np.uint64(0xBF58476D1CE4E5B9)


class WordHashes(dict):
    """64-bit hash of a word by its bytes; remembers some words, never more than ``CACHE_WORDS``."""

    def __missing__(self, word: bytes) -> int:
        value = int.from_bytes(blake2b(word, digest_size=8).digest(), "little")
        if len(self) >= CACHE_WORDS:
            self.clear()
        self[word] = value
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mixed(x: np.ndarray) -> np.ndarray:
    """The finalizer of a multiply-xorshift hash."""
    x = (x ^ (x >> np.uint64(31))) * MIX
    return x ^ (x >> np.uint64(29))


def windows(hashes: np.ndarray, size: int, factor: np.uint64 = M1) -> np.ndarray:
    """Hash of each window of ``size`` consecutive words."""
    n = len(hashes) - size + 1
    out = np.zeros(max(n, 0), np.uint64)
    for k in range(size if n > 0 else 0):
        out = out * factor + hashes[k : k + n]
    return mixed(out)


def chunks(counts: list[int], most: int = CHUNK_WORDS) -> Iterator[range]:
    """Runs of documents that have up to ``most`` words together; a longer document is a run of its own."""
    start, total = 0, 0
    for i, n in enumerate(counts):
        if i > start and total + n > most:
            yield range(start, i)
            start, total = i, 0
        total += n
    if start < len(counts):
        yield range(start, len(counts))
