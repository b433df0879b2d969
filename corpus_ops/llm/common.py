"""What these operators share: words, letters, suffixes, word numbers."""

from __future__ import annotations

import hashlib
import re
from functools import lru_cache

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..storage import kept, table

__all__ = ["WORD", "bits", "encode", "kept", "letters", "suffix", "table", "windows", "words"]

#: A word is a longest run of letters and digits.
WORD = re.compile(r"[^\W_]+")


def words(text: str) -> list[str]:
    return WORD.findall(text.lower())


def letters(text: str) -> str:
    """The letters and digits of a text, in order and without letter case."""
    return "".join(WORD.findall(text.lower()))


def suffix(source: Column) -> Column:
    """Suffix of a source in lower case, without a trailing ``:i``."""
    return F.regexp_extract(F.lower(source), r"(\.[a-z0-9]+)(?::\d+)?\s*$", 1)


@lru_cache(1 << 18)
def _number(word: str) -> int:
    return int.from_bytes(hashlib.blake2b(word.encode("utf-8", "surrogatepass"), digest_size=4).digest(), "little", signed=True)


def encode(text: str) -> np.ndarray:
    """The words of a text as 32-bit numbers."""
    return np.array([_number(x) for x in words(text)], dtype=np.int32)


_BASE = np.uint64(0x9E3779B97F4A7C15)


def windows(w: np.ndarray, length: int) -> np.ndarray:
    """One 64-bit number for each window of so many words."""
    if len(w) < length:
        return np.empty(0, np.int64)
    w, n = w.astype(np.uint32).astype(np.uint64), len(w) - length + 1
    out = np.full(n, length, np.uint64)
    for i in range(length):
        out = (out ^ (out >> np.uint64(29))) * _BASE + w[i : i + n]
    return out.view(np.int64)


def bits(x: np.ndarray, power: int) -> np.ndarray:
    """Numbers spread over 2 ** power places."""
    return (x.view(np.uint64) * _BASE >> np.uint64(64 - power)).astype(np.int64)
