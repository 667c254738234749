"""Word normalisation: lower-cased maximal runs of letters or digits.

``normal_text`` is the JVM form (words joined by one space); the numpy helpers
hash such a text into word ids and k-word sequences.
"""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import Column, functions as F

WORD_PATTERN = r"[^\p{L}\p{Nd}]+"

_MUL = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xD6E8FEB86659FD93)


def normal_text(c: Column) -> Column:
    """Words of a text joined by single spaces; null becomes the empty text."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), WORD_PATTERN, " "))


class WordIds(dict):
    """Word -> 64-bit hash, remembered; emptied when it has grown past a bound."""

    LIMIT = 1_000_000

    def __missing__(self, w):
        if len(self) >= self.LIMIT:
            self.clear()
        v = self[w] = xxhash.xxh3_64_intdigest(w)
        return v

    def of(self, normal: str) -> np.ndarray:
        w = normal.split()
        return np.fromiter(map(self.__getitem__, w), dtype=np.uint64, count=len(w))


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(32))
    x = x * _MIX
    return x ^ (x >> np.uint64(29))


def sequences(ids: np.ndarray, k: int) -> np.ndarray:
    """64-bit hashes of the k-word sequences, in order (polynomial rolling hash, mixed)."""
    n = len(ids) - k + 1
    if n <= 0:
        return np.empty(0, dtype=np.uint64)
    h = ids[:n].copy()
    for i in range(1, k):
        h *= _MUL
        h += ids[i : i + n]
    return mix(h)
