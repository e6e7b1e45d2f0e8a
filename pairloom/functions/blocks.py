"""Matching blocks of two sequences, and word errors between them (ALN06).

The longest common block comes from a suffix automaton of the second sequence, over which the first is read once; what is left and right of the block is matched in the same
way. Of blocks of one length that which starts first in the first sequence counts, then that which starts first in the second, so the blocks are those of the standard library's matcher
without its heuristic for frequent symbols, but no list of all pairs of equal symbols is ever walked.
"""

from __future__ import annotations

from collections.abc import Hashable, Iterator, Sequence

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

BLOCKS = T.ArrayType(T.StructType([T.StructField(c, T.IntegerType()) for c in ("a", "b", "size")]))
WORD_CHANGES = T.ArrayType(T.StructType([T.StructField(c, T.StringType()) for c in ("kind", "gt_words", "ocr_words")]))


class SuffixAutomaton:
    """All runs of a sequence; each state knows where the first of its runs ends."""

    def __init__(self, symbols: Sequence[Hashable]) -> None:
        self.next: list[dict[Hashable, int]] = [{}]
        self.link, self.length, self.first_end = [-1], [0], [-1]
        last = 0
        for at, x in enumerate(symbols):
            state = self._state({}, self.length[last] + 1, at)
            while last >= 0 and x not in self.next[last]:
                self.next[last][x] = state
                last = self.link[last]
            if last < 0:
                self.link[state] = 0
            else:
                target = self.next[last][x]
                if self.length[target] == self.length[last] + 1:
                    self.link[state] = target
                else:
                    copy = self._state(dict(self.next[target]), self.length[last] + 1, self.first_end[target])
                    self.link[copy] = self.link[target]
                    while last >= 0 and self.next[last].get(x) == target:
                        self.next[last][x] = copy
                        last = self.link[last]
                    self.link[target] = self.link[state] = copy
            last = state

    def _state(self, after: dict[Hashable, int], length: int, first_end: int) -> int:
        self.next.append(after)
        self.link.append(-1)
        self.length.append(length)
        self.first_end.append(first_end)
        return len(self.next) - 1

    def longest(self, symbols: Sequence[Hashable]) -> tuple[int, int, int]:
        """Start in ``symbols``, start in the automaton's sequence, and length of the longest common run."""
        best = (0, 0, 0)
        state = size = 0
        for at, x in enumerate(symbols):
            while state and x not in self.next[state]:
                state = self.link[state]
                size = self.length[state]
            if x in self.next[state]:
                state, size = self.next[state][x], size + 1
                if size > best[2]:
                    best = (at - size + 1, self.first_end[state] - size + 1, size)
        return best


def matching_blocks(a: Sequence[Hashable], b: Sequence[Hashable]) -> list[tuple[int, int, int]]:
    """Starts in both sequences and length of each block, in order; blocks that adjoin in both are one. No empty block ends the list."""
    found, todo = [], [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        while a0 < a1 and b0 < b1:
            i, j, size = SuffixAutomaton(b[b0:b1]).longest(a[a0:a1])
            if not size:
                break
            found.append((a0 + i, b0 + j, size))
            todo.append((a0, a0 + i, b0, b0 + j))
            a0, b0 = a0 + i + size, b0 + j + size
    out: list[tuple[int, int, int]] = []
    for i, j, size in sorted(found):
        if out and out[-1][0] + out[-1][2] == i and out[-1][1] + out[-1][2] == j:
            out[-1] = (*out[-1][:2], out[-1][2] + size)
        else:
            out.append((i, j, size))
    return out


def changes(gt: Sequence[str], ocr: Sequence[str]) -> list[tuple[str, int, int, int, int]]:
    """What lies between blocks: its kind (``replace``, ``delete``, ``insert``) and its bounds in both sequences."""
    out, i, j = [], 0, 0
    for a, b, size in [*matching_blocks(gt, ocr), (len(gt), len(ocr), 0)]:
        if i < a or j < b:
            out.append(("replace" if i < a and j < b else "delete" if i < a else "insert", i, a, j, b))
        i, j = a + size, b + size
    return out


@F.pandas_udf(BLOCKS)
def word_blocks(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """Matching blocks of two arrays of words; null if either is."""
    for xs, ys in batches:
        yield pd.Series([None if x is None or y is None else [{"a": i, "b": j, "size": n} for i, j, n in matching_blocks(x.tolist(), y.tolist())] for x, y in zip(xs, ys)], dtype="object")


@F.pandas_udf(WORD_CHANGES)
def word_changes(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """What lies between the blocks of two arrays of words, each side joined by blanks; null if either array is."""
    for xs, ys in batches:
        out: list[list[dict] | None] = []
        for x, y in zip(xs, ys):
            out.append(None if x is None or y is None else [{"kind": k, "gt_words": " ".join(x[i:a]), "ocr_words": " ".join(y[j:b])} for k, i, a, j, b in changes(x.tolist(), y.tolist())])
        yield pd.Series(out, dtype="object")
