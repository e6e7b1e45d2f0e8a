"""Texts as arrays of code points, and the hashes of their character n-grams."""

from __future__ import annotations

import sys
from functools import lru_cache

import numpy as np

from pairloom.llm.words import mix, powers

_BASE = 0xC2B2AE3D27D4EB4F


@lru_cache(maxsize=1)
def letter_table() -> np.ndarray:
    """For each code point whether it is a letter."""
    return np.fromiter((chr(i).isalpha() for i in range(sys.maxunicode + 1)), dtype=bool, count=sys.maxunicode + 1)


def code_points(text: str | None) -> np.ndarray:
    return np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), np.uint32)


def letters(text: str | None) -> np.ndarray:
    """Lower-case letters as code points; each run of anything else, and either end, is one 0. Empty if there is no letter."""
    points = code_points(text)
    is_letter = letter_table()[points]
    if not is_letter.any():
        return np.zeros(0, np.uint32)
    symbols = np.concatenate(([0], np.where(is_letter, points, 0), [0])).astype(np.uint32)
    return symbols[np.concatenate(([True], (symbols[1:] != 0) | (symbols[:-1] != 0)))]


def ngram_hashes(symbols: np.ndarray, sizes: tuple[int, ...]) -> np.ndarray:
    """Mixed hashes of all n-grams of the given sizes (with repeats)."""
    values = mix(symbols.astype(np.uint64) + np.uint64(1))
    p, inverse = powers(_BASE, len(values) + 1)
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * p[: len(values)], out=sums[1:])
    out = [mix((sums[n:] - sums[:-n]) * inverse[: len(values) - n + 1] + np.uint64(n)) for n in sizes if len(values) >= n]
    return np.concatenate(out) if out else np.zeros(0, np.uint64)
