"""Words and their hashes for whole Arrow batches of texts, without a Python object per word.

A word is a maximal run of bytes other than 0x20 and 0x09-0x0D. As these are ASCII, splitting UTF-8 bytes is splitting characters.
Hashes are polynomials modulo 2**64 over random byte values, then mixed; sums of prefixes give the hash of any run in O(1).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 20

_SEPARATOR = np.zeros(256, dtype=bool)
_SEPARATOR[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_rng = np.random.Generator(np.random.PCG64(20240229))
_VALUE = _rng.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_BYTE_BASE, _WORD_BASE = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads each bit over all (finaliser of splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}
_KEPT_POWERS = 1 << 21


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """At least n powers of ``base`` and of its inverse modulo 2**64. One table of each base is kept, unless it is over ``_KEPT_POWERS`` long."""
    if (known := _POWERS.get(base)) is not None and len(known[0]) >= n:
        return known
    out = []
    for b in (base, pow(base, -1, 1 << 64)):
        p = np.full(1 << max(10, int(n).bit_length()), b, dtype=np.uint64)
        p[0] = 1
        out.append(np.multiply.accumulate(p))
    if n < _KEPT_POWERS:
        _POWERS[base] = (out[0], out[1])
    return out[0], out[1]


def run_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int = _WORD_BASE) -> np.ndarray:
    """The mixed hash of values[start:end] for each pair of bounds."""
    p, inverse = powers(base, len(values) + 1)
    sums = np.zeros(len(values) + 1, dtype=np.uint64)
    np.cumsum(values * p[: len(values)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * inverse[starts])


class Chunk:
    """Consecutive texts of a batch: ``rows`` in the batch; for each word its hash and text; for each text the bounds of its words."""

    def __init__(self, first: int, data: np.ndarray, offsets: np.ndarray, lower: bool) -> None:
        self.first, self.n, self.offsets = first, len(offsets) - 1, offsets
        self.data = data = _LOWER[data] if lower else data
        word = ~_SEPARATOR[data]
        edge = np.zeros(len(data) + 1, dtype=bool)
        edge[offsets] = True
        before = np.empty_like(word)
        before[:1], before[1:] = False, word[:-1]
        self.starts = np.flatnonzero(word & (~before | edge[:-1]))
        after = np.empty_like(word)
        after[-1:], after[:-1] = False, word[1:]
        self.ends = np.flatnonzero(word & (~after | edge[1:])) + 1
        self.bounds = np.searchsorted(self.starts, offsets)
        self.hash = run_hashes(_VALUE[data], self.starts, self.ends, _BYTE_BASE)

    def doc_of(self, position: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.bounds, position, side="right") - 1

    def grams(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Positions at which n words of one text start, and the hashes of those n words."""
        at = np.arange(max(0, len(self.starts) - n + 1))
        ends = np.repeat(self.bounds[1:], np.diff(self.bounds))
        at = at[at + n <= ends[: len(at)]]
        return at, run_hashes(self.hash, at, at + n)

    def words(self, doc: int, keep: np.ndarray | None = None) -> bytes:
        """The words of a text (those of ``keep``) joined by one space."""
        a, b = self.bounds[doc], self.bounds[doc + 1]
        s, e = self.starts[a:b], self.ends[a:b]
        if keep is not None:
            s, e = s[keep], e[keep]
        raw = self.data
        return b" ".join([raw[i:j].tobytes() for i, j in zip(s.tolist(), e.tolist())])


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    return (np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)), offsets


def chunks(column: pa.Array, lower: bool = False, size: int = CHUNK_BYTES) -> Iterator[Chunk]:
    """The texts of a column in pieces of about ``size`` bytes, whole texts each."""
    data, offsets = text_buffers(column)
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + size, side="right")) - 1)
        yield Chunk(i, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], lower)
        i = j
