"""Edit distances as Column expressions, and alignments (ALN01-ALN05) as Arrow batches.

Distances and paths are bit-parallel: one column of the table is a pair of bit vectors as long as the reference (which rows are one more than the row above, which one less), and a
column follows from the one before in a dozen operations on whole vectors. Texts that start one another, and short ones, stay in the JVM, so that only pairs with a table worth filling are sent to Python.
Paths come from the vectors kept for each column; of long texts every so manieth column is kept, and the columns between are worked out again on the way back, so memory is bounded at any length.
"""

from __future__ import annotations

from collections.abc import Hashable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairloom.functions.classify import error_type_of, position_of
from pairloom.functions.text import normalise, tokens

_SHORT, _KEPT_BYTES, _FEW = 24, 1 << 24, 64


def _masks(a: Sequence[Hashable]) -> dict[Hashable, int]:
    """For each symbol the bits of its places."""
    places: dict[Hashable, list[int]] = {}
    for i, x in enumerate(a):
        places.setdefault(x, []).append(i)
    if len(a) <= _FEW:
        return {x: sum(1 << i for i in at) for x, at in places.items()}
    out, room = {}, np.zeros(len(a), np.uint8)
    for x, at in places.items():
        room[at] = 1
        out[x] = int.from_bytes(np.packbits(room, bitorder="little").tobytes(), "little")
        room[at] = 0
    return out


def _column(own: int, up: int, down: int, whole: int) -> tuple[int, int, int, int]:
    """The next column from the rows ``up`` and ``down`` of the last and the places ``own`` of its symbol: rows equal to their upper left neighbour, rows up and down, and rows one more than to their left."""
    same = (((own & up) + up ^ up) | own | down) & whole
    more = down | (same | up) ^ whole
    right = (more << 1 | 1) & whole
    return same, ((up & same) << 1 & whole) | (same | right) ^ whole, right & same, more


def edit_distance(a: Sequence[Hashable], b: Sequence[Hashable]) -> int:
    """Levenshtein distance of two sequences of symbols."""
    if len(a) < len(b):
        a, b = b, a
    first, end = 0, len(b)
    while first < end and a[first] == b[first]:
        first += 1
    apart = len(a) - end
    while end > first and a[end - 1 + apart] == b[end - 1]:
        end -= 1
    a, b = a[first : end + apart], b[first:end]
    if not b:
        return len(a)
    masks, whole = _masks(a), (1 << len(a)) - 1
    up, down = whole, 0
    for x in b:
        _, up, down, _ = _column(masks.get(x, 0), up, down, whole)
    return len(b) + up.bit_count() - down.bit_count()


def _distances(xs: pd.Series, ys: pd.Series) -> pd.Series:
    """Null where a text is, as pairs that need no table are sent as nulls."""
    from pairloom.functions.batches import edit_distances  # which builds on this module

    sent = [(k, x, y) for k, (x, y) in enumerate(zip(xs, ys)) if x is not None and y is not None]
    out = np.full(len(xs), None, dtype=object)
    out[[k for k, *_ in sent]] = edit_distances([x for _, x, _ in sent], [y for *_, y in sent])
    return pd.Series(out, dtype="Int32")


@F.pandas_udf(T.IntegerType())
def _char_distances(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for xs, ys in batches:
        yield _distances(xs, ys)


@F.pandas_udf(T.IntegerType())
def _word_distances(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for xs, ys in batches:
        yield _distances(xs, ys)


def distance(a: Column, b: Column) -> Column:
    """Character edit distance; where one text starts the other it is the difference of their lengths, and no table is filled."""
    easy = F.startswith(a, b) | F.startswith(b, a)
    short = F.least(F.length(a), F.length(b)) <= _SHORT
    sent = lambda x: F.when(~easy & ~short, x)
    return F.when(easy, F.abs(F.length(a) - F.length(b))).when(short, F.levenshtein(a, b)).otherwise(_char_distances(sent(a), sent(b)))


def distance_at_sight(a: Column, b: Column) -> Column:
    """``distance`` where no table need be filled, else null."""
    short = F.least(F.length(a), F.length(b)) <= _SHORT
    return F.when(F.startswith(a, b) | F.startswith(b, a), F.abs(F.length(a) - F.length(b))).when(short, F.levenshtein(a, b))


def word_distance_at_sight(a: Column, b: Column) -> Column:
    """``word_distance`` of words joined by single blanks, if one text's words are the first of the other's, else null."""
    n, m = words_joined(a), words_joined(b)
    first = lambda x, y: (x == "") | F.startswith(F.concat(y, F.lit(" ")), F.concat(x, F.lit(" ")))
    return F.when(first(a, b) | first(b, a), F.abs(n - m))


def words_joined(c: Column) -> Column:
    """How many words a text has that joins them by single blanks."""
    return F.when(c == "", F.lit(0)).otherwise(F.length(c) - F.length(F.replace(c, F.lit(" "), F.lit(""))) + 1)


def error_rate(errors: Column, length: Column) -> Column:
    """Errors by reference length; 0 for an empty reference. May exceed 1."""
    return F.when(length == 0, F.lit(0.0)).otherwise(errors / length)


def cer(reference: Column, hypothesis: Column, diacritics: bool = True) -> Column:
    ref, hyp = normalise(reference, diacritics), normalise(hypothesis, diacritics)
    return error_rate(distance(ref, hyp), F.length(ref))


def word_distance(a: Column, b: Column) -> Column:
    """Levenshtein distance of two arrays of words."""
    easy = (a == b) | (F.size(a) == 0) | (F.size(b) == 0)
    sent = lambda x: F.when(~easy, x)
    return F.when(a == b, F.lit(0)).when(easy, F.greatest(F.size(a), F.size(b))).otherwise(_word_distances(sent(a), sent(b)))


def wer(reference: Column, hypothesis: Column, diacritics: bool = True) -> Column:
    ref, hyp = tokens(normalise(reference, diacritics)), tokens(normalise(hypothesis, diacritics))
    return error_rate(word_distance(ref, hyp), F.size(ref))


def align(ref: Sequence[str], hyp: Sequence[str]) -> list[tuple[str | None, str | None]]:
    """Pairs of aligned symbols, None for a gap. From the end backwards a match is taken before a substitution, a deletion, an insertion."""
    path: list[tuple[str | None, str | None]] = []
    i, j = len(ref), len(hyp)
    while i and j and ref[i - 1] == hyp[j - 1]:
        i, j = i - 1, j - 1
        path.append((ref[i], hyp[j]))
    # the columns are the symbols of the shorter text, as long vectors cost little more than short ones
    turned = i * 2 < j
    rows, across = (hyp, ref) if turned else (ref, hyp)
    y, x = (j, i) if turned else (i, j)
    masks, whole = _masks(rows[:y]), (1 << y) - 1
    step = max(1, _KEPT_BYTES // (y // 3 + 64))  # two vectors of about y / 7 bytes for each column
    up, down, kept = whole, 0, []
    for n in range(x):
        if n % step == 0:
            kept.append((up, down))
        if x > step:
            _, up, down, _ = _column(masks.get(across[n], 0), up, down, whole)
    while i and j:
        first = ((i if turned else j) - 1) // step * step
        up, down = kept[first // step]
        columns = []
        for n in range(first, i if turned else j):
            same, up, down, more = _column(masks.get(across[n], 0), up, down, whole)
            columns.append((same, more if turned else up))
        while i > (first if turned else 0) and j > (0 if turned else first):
            same, deleted = columns[(i if turned else j) - 1 - first]
            row = (j if turned else i) - 1
            if ref[i - 1] == hyp[j - 1]:
                i, j = i - 1, j - 1
                path.append((ref[i], hyp[j]))
            elif not same >> row & 1:
                i, j = i - 1, j - 1
                path.append((ref[i], hyp[j]))
            elif deleted >> row & 1:
                i -= 1
                path.append((ref[i], None))
            else:
                j -= 1
                path.append((None, hyp[j]))
    path += [(ref[k], None) for k in range(i - 1, -1, -1)] + [(None, hyp[k]) for k in range(j - 1, -1, -1)]
    path.reverse()
    return path


def _list_of(texts: str, flags: str = "") -> T.ArrayType:
    return T.ArrayType(T.StructType([T.StructField(n, T.StringType()) for n in texts.split()] + [T.StructField(n, T.BooleanType()) for n in flags.split()]))


_PATH = _list_of("ref hyp")
CHAR_ERRORS = _list_of("gt_char ocr_char error_type position context")
WORD_ERRORS = _list_of("gt_word ocr_word", "is_merged is_split")


@F.pandas_udf(_PATH)
def align_chars(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """Path of two strings; null stands for the gap."""
    for refs, hyps in batches:
        yield pd.Series([[{"ref": r, "hyp": h} for r, h in align(a, b)] for a, b in zip(refs, hyps)])


@F.pandas_udf(_PATH)
def align_words(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """Path of two arrays of words."""
    for refs, hyps in batches:
        yield pd.Series([[{"ref": r, "hyp": h} for r, h in align(list(a), list(b))] for a, b in zip(refs, hyps)])


def char_errors_of(ref: str, hyp: str) -> list[dict]:
    """Steps that are no match, with their type, place in the word and a context of three characters of the reference."""
    if ref == hyp:
        return []
    out, at = [], 0
    for r, h in align(ref, hyp):
        if r != h:
            out.append({"gt_char": r or "", "ocr_char": h or "", "error_type": error_type_of(r or "", h or ""), "position": position_of(at, ref) if r else "word_middle", "context": ref[max(0, at - 1) : at + 2]})
        at += r is not None
    return out


@F.pandas_udf(CHAR_ERRORS)
def char_errors(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for refs, hyps in batches:
        yield pd.Series([char_errors_of(a, b) for a, b in zip(refs, hyps)])


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def char_error_counts(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """How many errors of each of ``TYPED`` a pair has, in that order; null for a null text, so that equal texts can be sent as nulls."""
    from pairloom.functions.batches import error_counts

    for refs, hyps in batches:
        yield pd.Series(error_counts(refs, hyps), dtype="object")


def word_errors_of(ref: list[str], hyp: list[str]) -> list[dict]:
    """Word pairs that differ. Merged: over half as long again as the reference word, and that word followed by a next one; split: a word of over four letters lost."""
    following: dict[str, set[str]] = {}
    for a, b in zip(ref, ref[1:]):
        following.setdefault(a, set()).add(b)
    out = []
    for r, h in align(ref, hyp) if ref != hyp else []:
        if r != h:
            merged = bool(r and h and len(h) > 1.5 * len(r) and any(h == r + x for x in following.get(r, ())))
            out.append({"gt_word": r or "", "ocr_word": h or "", "is_merged": merged, "is_split": bool(r and not h and len(r) > 4)})
    return out


@F.pandas_udf(WORD_ERRORS)
def word_errors(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for refs, hyps in batches:
        yield pd.Series([word_errors_of(list(a), list(b)) for a, b in zip(refs, hyps)])
