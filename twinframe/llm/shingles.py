"""Word shingles as 64-bit numbers, and exact set sizes from them."""

from __future__ import annotations

import hashlib

import numpy as np
import xxhash

REMEMBERED = 1_000_000  # words per task; a fuller memory is emptied
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], dtype=np.uint64)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Words(dict):
    """The 64-bit hash of a word's bytes, remembered."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > REMEMBERED:
            self.clear()
        self[word] = made = xxhash.xxh3_64_intdigest(word)
        return made


def word_numbers(text: str, words: Words) -> np.ndarray:
    """Hashes of the words of a text, A-Z in lower case, split at ASCII white space."""
    split = text.encode().lower().split()
    return np.fromiter(map(words.__getitem__, split), dtype=np.uint64, count=len(split))


def shingle_set(numbers: np.ndarray, size: int) -> np.ndarray:
    """Sorted distinct shingles of ``size`` words; a shorter sequence is one shingle, none without words."""
    n = len(numbers)
    if not n:
        return numbers
    width = min(size, n)
    made = np.full(n - width + 1, width * 0x2545F491, dtype=np.uint64)
    for at in range(width):
        made = mixed(made + numbers[at : n - width + 1 + at] * _ODD[at % len(_ODD)])
    return np.unique(made)


def set_digest(shingles: np.ndarray) -> bytes:
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()


def intersection(a: np.ndarray, b: np.ndarray) -> int:
    """Common members of two sorted distinct arrays."""
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    return int((b[np.minimum(at, len(b) - 1)] == a).sum()) if len(b) else 0
