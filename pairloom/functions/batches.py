"""Distances and character errors of whole Arrow batches: bit vectors of many pairs side by side in numpy, and errors as flat arrays instead of a list of records for each pair.

A pair whose one text lies in the other, or that differs by substitutions alone, needs no path: those steps are the only ones that ``align`` can take there.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa

from pairloom.functions.classify import POSITIONS, TYPED, error_type_of
from pairloom.functions.edit import align, edit_distance

_WORDS, _LONG, _MASK_BYTES, _ERRORS, _ROWS, _PAIRS = 32, 800, 1 << 24, 1 << 17, 1 << 15, 1 << 11
_BITS = 21  # a code point and one more


def codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), np.uint32)


def _numbered(a: Sequence, b: Sequence) -> tuple[np.ndarray, np.ndarray]:
    """Symbols as numbers, equal ones alike."""
    if isinstance(a, str) and isinstance(b, str):
        return codes(a), codes(b)
    known: dict = {}
    of = lambda xs: np.array([known.setdefault(x, len(known)) for x in xs], np.uint32)
    return of(a), of(b)


def _middle(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Without equal symbols at the start and at the end."""
    n = min(len(a), len(b))
    apart = np.flatnonzero(a[:n] != b[:n])
    first = int(apart[0]) if len(apart) else n
    a, b, n = a[first:], b[first:], n - first
    apart = np.flatnonzero(a[len(a) - n :] != b[len(b) - n :])
    last = n - 1 - int(apart[-1]) if len(apart) else n
    return a[: len(a) - last], b[: len(b) - last]


def edit_distances(xs: Sequence[Sequence], ys: Sequence[Sequence]) -> np.ndarray:
    """Levenshtein distances of pairs of sequences. Pairs of like length go through the columns of their tables together; few or very long ones alone."""
    out, pairs = np.zeros(len(xs), np.int32), []
    for k, (x, y) in enumerate(zip(xs, ys)):
        a, b = _middle(*_numbered(x, y))
        a, b = (a, b) if len(a) >= len(b) else (b, a)
        if len(b):
            pairs.append((-(-len(a) // 64), len(b), k, a, b))
        else:
            out[k] = len(a)
    pairs.sort(key=lambda p: (p[0], -p[1]))
    first = 0
    while first < len(pairs):
        least = pairs[first][0]
        last = first
        while last < len(pairs) and pairs[last][0] <= least + least // 3:
            last += 1
        group, first = pairs[first:last], last
        _distances_of(group, out)
    return out


def several_distances(batches: Iterator[pa.RecordBatch], pairs: list[tuple[str, str, str, bool]]) -> Iterator[pa.RecordBatch]:
    """Batches without their texts: of each of ``pairs`` (two columns of texts, one of distances, and whether words joined by blanks are the symbols) the distances that are null are worked out."""
    texts = {c for a, b, *_ in pairs for c in (a, b)}
    words = lambda x: x.split(" ") if x else []
    for whole in batches:
        for first in range(0, whole.num_rows, _PAIRS):
            batch = whole.slice(first, _PAIRS)
            made = {c: batch.column(c) for c in batch.schema.names if c not in texts}
            for a, b, name, by_words in pairs:
                rows = np.flatnonzero(made[name].is_null().to_numpy(zero_copy_only=False))
                if len(rows):
                    xs, ys = (batch.column(c).take(pa.array(rows)).to_pylist() for c in (a, b))
                    out = made[name].fill_null(0).to_numpy(zero_copy_only=False).copy()
                    out[rows] = edit_distances([words(x) for x in xs], [words(y) for y in ys]) if by_words else edit_distances(xs, ys)
                    made[name] = pa.array(out, pa.int32())
            yield pa.RecordBatch.from_pydict(made)


def _distances_of(group: list[tuple], out: np.ndarray) -> None:
    words = group[-1][0]
    if words > _WORDS or len(group) < 24 * words / (0.6 + 0.03 * words):
        for _, _, k, a, b in group:
            out[k] = edit_distance(a.tolist(), b.tolist())
        return
    symbols, a = np.unique(np.concatenate([p[3] for p in group]), return_inverse=True)
    if len(group) * (len(symbols) + 2) * words * 8 > _MASK_BYTES:
        half = len(group) // 2
        _distances_of(group[:half], out)
        _distances_of(group[half:], out)
        return
    group.sort(key=lambda p: -p[1])  # pairs that are done leave at the end
    count, width, none = len(group), len(symbols) + 2, len(symbols) + 1
    n, m = np.array([len(p[3]) for p in group]), np.array([p[1] for p in group])
    rows, columns = np.full((int(n.max()), count), none, np.int64), np.zeros((int(m[0]), count), np.int64)
    for k, p in enumerate(group):
        rows[: n[k], k] = np.searchsorted(symbols, p[3]) + 1
        at = np.minimum(np.searchsorted(symbols, p[4]), len(symbols) - 1)
        columns[: m[k], k] = np.where(symbols[at] == p[4], at + 1, 0)
    base = np.arange(count) * width
    masks = np.zeros((words, count * width), np.uint64)
    for i in range(len(rows)):
        masks[i >> 6][base + rows[i]] |= np.uint64(1 << (i & 63))
    masks.reshape(words, count, width)[:, :, none] = 0
    up, down = np.full((words, count), ~np.uint64(0)), np.zeros((words, count), np.uint64)
    left = count - np.searchsorted(m[::-1], np.arange(len(columns)), side="right")
    one, top = np.uint64(1), np.uint64(63)
    for j in range(len(columns)):
        k = int(left[j])
        at = base[:k] + columns[j, :k]
        carry, right_in, both_in = None, one, None
        for w in range(words):
            u, d, own = up[w, :k], down[w, :k], masks[w].take(at)
            s = own & u
            s += u
            over = s < u if w + 1 < words else None
            if carry is not None:
                s += carry
                if over is not None:
                    over |= s < carry
            s ^= u
            s |= own
            s |= d  # rows equal to their upper left neighbour
            right = s | u
            np.invert(right, out=right)
            right |= d
            both = u & s
            if w + 1 < words:
                carry, right_out, both_out = over.astype(np.uint64), right >> top, both >> top
            right <<= one
            right |= right_in
            both <<= one
            if both_in is not None:
                both |= both_in
            np.bitwise_and(right, s, out=d)
            s |= right
            np.invert(s, out=s)
            np.bitwise_or(both, s, out=u)
            if w + 1 < words:
                right_in, both_in = right_out, both_out
    found = m.astype(np.int64)
    for w in range(words):
        bits = np.clip(n - 64 * w, 0, 64)
        whole = np.where(bits == 64, ~np.uint64(0), (one << np.minimum(bits, 63).astype(np.uint64)) - one)
        found += np.bitwise_count(up[w] & whole).astype(np.int64) - np.bitwise_count(down[w] & whole)
    out[[p[2] for p in group]] = found


Steps = tuple[np.ndarray, np.ndarray, np.ndarray]  # places in the reference, its code points (-1: gap), those of the hypothesis


def _one_sided(short: str, long: str) -> list[tuple[int, int, int]] | None:
    """``(place in short, start, end in long)`` of what ``long`` has more, taken from the end backwards; None unless it holds all of ``short`` in order."""
    found, j = [], len(long)
    for i in range(len(short), 0, -1):
        k = long.rfind(short[i - 1], 0, j)
        if k < 0:
            return None
        if k + 1 < j:
            found.append((i, k + 1, j))
        j = k
    if j:
        found.append((0, 0, j))
    found.reverse()
    return found


def _steps_of(ref: str, hyp: str) -> Steps:
    """The steps of ``align`` that are no match."""
    at, r, h, i = [], [], [], 0
    for x, y in align(ref, hyp):
        if x != y:
            at.append(i)
            r.append(ord(x) if x else -1)
            h.append(ord(y) if y else -1)
        i += x is not None
    return np.array(at, np.int64), np.array(r, np.int64), np.array(h, np.int64)


def differences(refs: Sequence[str], hyps: Sequence[str]) -> Iterator[Steps]:
    """The steps of each pair that are no match, those of ``align``."""
    even = [k for k, (a, b) in enumerate(zip(refs, hyps)) if len(a) == len(b) <= _LONG and a != b]  # a long pair costs as much to measure as to align
    distance = dict(zip(even, edit_distances([refs[k] for k in even], [hyps[k] for k in even]).tolist()))
    for k, (ref, hyp) in enumerate(zip(refs, hyps)):
        a, b = codes(ref).astype(np.int64), codes(hyp).astype(np.int64)
        if len(a) == len(b):
            at = np.flatnonzero(a != b)
            # as few substitutions as there are errors at all: every prefix of the diagonal is a best path too, so no other step is ever taken
            yield (at, a[at], b[at]) if len(at) == distance.get(k, 0) else _steps_of(ref, hyp)
            continue
        more = len(b) > len(a)
        parts = _one_sided(ref, hyp) if more else _one_sided(hyp, ref)
        if parts is None:
            yield _steps_of(ref, hyp)
            continue
        place = np.concatenate([np.arange(s, e) for _, s, e in parts])
        gap = np.full(len(place), -1, np.int64)
        yield (np.repeat([i for i, _, _ in parts], [e - s for _, s, e in parts]), gap, b[place]) if more else (place, a[place], gap)


def _word_steps(ref: list[str], hyp: list[str], distance: int | None) -> list[tuple[str | None, str | None]]:
    """The steps of ``align`` on words that are no match; ``distance`` is that of texts of equally many words."""
    if len(ref) == len(hyp):
        apart = [x for x in zip(ref, hyp) if x[0] != x[1]]
        return apart if len(apart) == distance else [x for x in align(ref, hyp) if x[0] != x[1]]
    more = len(hyp) > len(ref)
    short, long, rest, i = (ref, hyp, [], len(ref)) if more else (hyp, ref, [], len(hyp))
    for word in reversed(long):
        if i and word == short[i - 1]:
            i -= 1
        else:
            rest.append((None, word) if more else (word, None))
    return [x for x in align(ref, hyp) if x[0] != x[1]] if i else rest[::-1]


def word_errors(refs: Sequence[list[str]], hyps: Sequence[list[str]]) -> Iterator[list[tuple[str, str, bool, bool]]]:
    """``gt_word, ocr_word, is_merged, is_split`` of the word pairs of each pair of texts that differ. Merged: over half as long again as the reference word, and that
    word followed by a next one; split: a word of over four letters lost."""
    even = [k for k, (a, b) in enumerate(zip(refs, hyps)) if len(a) == len(b) <= _LONG and a != b]
    distance = dict(zip(even, edit_distances([refs[k] for k in even], [hyps[k] for k in even]).tolist()))
    for k, (ref, hyp) in enumerate(zip(refs, hyps)):
        steps = _word_steps(ref, hyp, distance.get(k))
        following: dict[str, set[str]] = {}
        if any(r and h and len(h) > 1.5 * len(r) for r, h in steps):
            for a, b in zip(ref, ref[1:]):
                following.setdefault(a, set()).add(b)
        yield [(r or "", h or "", bool(r and h and len(h) > 1.5 * len(r) and any(h == r + x for x in following.get(r, ()))), bool(r and not h and len(r) > 4)) for r, h in steps]


def error_counts(refs: Sequence[str | None], hyps: Sequence[str | None]) -> list[list[int] | None]:
    """How many errors of each of ``TYPED`` a pair has; None for a null text."""
    place = {k: n for n, k in enumerate(TYPED)}
    out: list[list[int] | None] = [None if a is None or b is None else [0] * len(TYPED) for a, b in zip(refs, hyps)]
    rest = []
    for k, (ref, hyp) in enumerate(zip(refs, hyps)):
        if out[k] is None or ref == hyp:
            continue
        short, long = (ref, hyp) if len(ref) <= len(hyp) else (hyp, ref)
        it = iter(long)
        if len(short) < len(long) and all(c in it for c in short):
            out[k][place["insertion" if short is ref else "deletion"]] = len(long) - len(short)
        else:
            rest.append(k)
    known: dict[tuple[int, int], int | None] = {}
    for k, (_, r, h) in zip(rest, differences([refs[k] for k in rest], [hyps[k] for k in rest])):
        for (x, y), n in zip(*_counted(r, h)):
            if (x, y) not in known:
                known[x, y] = place.get(error_type_of("" if x < 0 else chr(x), "" if y < 0 else chr(y)))
            if known[x, y] is not None:
                out[k][known[x, y]] += n
    return out


def _counted(r: np.ndarray, h: np.ndarray) -> tuple[list[tuple[int, int]], list[int]]:
    found, n = np.unique((r + 1) << _BITS | (h + 1), return_counts=True)
    return list(zip(((found >> _BITS) - 1).tolist(), ((found & (1 << _BITS) - 1) - 1).tolist())), n.tolist()


def _char(code: int) -> str:
    return chr(code) if code >= 0 else ""


class _Held:
    """Errors of some pairs of a batch, as flat arrays."""

    def __init__(self, refs: list[str], pairs: list[int], steps: list[Steps]):
        sizes = np.array([len(s[0]) for s in steps])
        self.pair = np.repeat(np.array(pairs, np.int64), sizes)
        self.number = np.arange(len(self.pair)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        self.at, self.r, self.h = (np.concatenate([s[n] for s in steps]) for n in range(3))
        lengths = np.array([len(x) for x in refs])
        starts = np.cumsum(lengths + 1) - lengths - 1
        self.text = codes("\n".join([*refs, ""])).astype(np.int64)
        self.start, self.length = np.repeat(starts, sizes), np.repeat(lengths, sizes)
        found, self.kind = np.unique((self.r + 1) << _BITS | (self.h + 1), return_inverse=True)
        self.kinds = [(_char(x), _char(y)) for x, y in zip(((found >> _BITS) - 1).tolist(), ((found & (1 << _BITS) - 1) - 1).tolist())]

    def cut(self, first: int) -> None:
        """From now on only the first errors of each type of a pair."""
        types = [error_type_of(r, h) for r, h in self.kinds]
        group = self.pair * len(TYPED) + np.array([TYPED.index(t) for t in types], np.int64)[self.kind]
        order = np.argsort(group, kind="stable")
        starts = np.flatnonzero(np.diff(group[order], prepend=-1))
        rank = np.arange(len(order)) - np.repeat(starts, np.diff(np.append(starts, len(order))))
        kept = np.sort(order[rank < first])
        for name in ("pair", "number", "at", "r", "h", "kind", "start", "length"):
            setattr(self, name, getattr(self, name)[kept])

    def positions(self) -> np.ndarray:
        """Numbers in ``POSITIONS``, as ``position_of`` has them."""
        n = len(self.text)
        blank = (self.text == 32) | (self.text == 10) | (self.text == 9)
        places = np.arange(n)
        before = np.maximum.accumulate(np.concatenate([[-1], np.where(blank, places, -1)[:-1]]))
        after = np.minimum.accumulate(np.concatenate([np.where(blank, places, n)[1:], [n]])[::-1])[::-1]
        at = self.start + self.at
        start, end = np.maximum(before[at] + 1, self.start), np.minimum(after[at], self.start + self.length)
        name = {k: n for n, k in enumerate(POSITIONS)}
        out = np.where(at == start, name["word_start"], np.where(at == end - 1, name["word_end"], name["word_middle"]))
        return np.where(self.r < 0, name["word_middle"], np.where(end - start == 1, name["single_char"], out))

    def contexts(self) -> pa.Array:
        at, key = self.start + self.at, np.zeros(len(self.at), np.int64)
        for step in (-1, 0, 1):
            inside = (self.at + step >= 0) & (self.at + step < self.length)
            key = key << _BITS | np.where(inside, self.text[np.clip(at + step, 0, len(self.text) - 1)] + 1, 0)
        found, which = np.unique(key, return_inverse=True)
        last = (1 << _BITS) - 1
        return pa.array(["".join(_char((x >> b & last) - 1) for b in (2 * _BITS, _BITS, 0)) for x in found.tolist()], pa.string()).take(pa.array(which))

    def named(self, names: list[str], which: np.ndarray) -> pa.Array:
        return pa.array(names, pa.string()).take(pa.array(which))


def _sent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pairs that differ; the others have null texts."""
    for batch in batches:
        batch = batch.filter(batch.column("ref").is_valid())
        if batch.num_rows:
            yield batch


def _held(batch: pa.RecordBatch) -> Iterator[_Held]:
    refs, hyps = batch.column("ref").to_pylist(), batch.column("hyp").to_pylist()
    texts, pairs, steps, n = [], [], [], 0
    for k, s in enumerate(differences(refs, hyps)):
        if len(s[0]):
            texts.append(refs[k])
            pairs.append(k)
            steps.append(s)
            n += len(s[0])
        if n >= _ERRORS:
            yield _Held(texts, pairs, steps)
            texts, pairs, steps, n = [], [], [], 0
    if n:
        yield _Held(texts, pairs, steps)


def error_rows(batches: Iterator[pa.RecordBatch], first: int | None = None) -> Iterator[pa.RecordBatch]:
    """A row for each character error of ``ref`` and ``hyp``, with the other columns of its pair; batches of a bounded size, however many errors a pair has.

    ``first``: only so many of each type of a pair, the first ones."""
    for batch in _sent(batches):
        others = [c for c in batch.schema.names if c not in ("ref", "hyp")]
        for x in _held(batch):
            if first is not None:
                x.cut(first)
            types = [error_type_of(r, h) for r, h in x.kinds]
            made = {"at": pa.array(x.number, pa.int32()), "gt_char": x.named([r for r, _ in x.kinds], x.kind), "ocr_char": x.named([h for _, h in x.kinds], x.kind), "error_type": x.named(types, x.kind), "position": x.named(POSITIONS, x.positions()), "context": x.contexts()}
            pair = pa.array(x.pair)
            whole = pa.RecordBatch.from_pydict({c: batch.column(c).take(pair) for c in others} | made)
            for start in range(0, whole.num_rows, _ROWS):
                yield whole.slice(start, _ROWS)


def error_tallies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of the errors of a batch by the other columns of their pairs, characters, type and position."""
    for batch in _sent(batches):
        others = [c for c in batch.schema.names if c not in ("ref", "hyp")]
        rows = pd.MultiIndex.from_arrays([batch.column(c).to_pandas() for c in others]).to_flat_index() if others else pd.Index([0] * batch.num_rows)
        group, _ = pd.factorize(rows)
        one = np.unique(group, return_index=True)[1]
        for x in _held(batch):
            key = (group[x.pair] * len(x.kinds) + x.kind) * len(POSITIONS) + x.positions()
            found, n = np.unique(key, return_counts=True)
            kind, place, pair = found // len(POSITIONS) % len(x.kinds), found % len(POSITIONS), found // (len(POSITIONS) * len(x.kinds))
            made = {"gt_char": x.named([r for r, _ in x.kinds], kind), "ocr_char": x.named([h for _, h in x.kinds], kind), "error_type": x.named([error_type_of(r, h) for r, h in x.kinds], kind), "position": x.named(POSITIONS, place), "count": pa.array(n, pa.int64())}
            yield pa.RecordBatch.from_pydict({c: batch.column(c).take(pa.array(one[pair])) for c in others} | made)


def word_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each word error of the arrays ``ref`` and ``hyp``, with the other columns of its pair; batches of a bounded size but for a single pair's."""
    return _of_words(batches, ["at", "gt_word", "ocr_word", "is_merged", "is_split"], lambda found: [(n, *e) for n, e in enumerate(found)])


def word_tallies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How often a pair has each word error, with its other columns."""
    return _of_words(batches, ["gt_word", "ocr_word", "count"], lambda found: [(*e, n) for e, n in Counter((r, h) for r, h, *_ in found).items()])


_KINDS = {"at": pa.int32(), "gt_word": pa.string(), "ocr_word": pa.string(), "is_merged": pa.bool_(), "is_split": pa.bool_(), "count": pa.int64()}


def _of_words(batches: Iterator[pa.RecordBatch], names: list[str], rows_of: Callable[[list], list[tuple]]) -> Iterator[pa.RecordBatch]:
    for batch in _sent(batches):
        others = [c for c in batch.schema.names if c not in ("ref", "hyp")]

        def made(pairs: list[int], rows: list[tuple]) -> Iterator[pa.RecordBatch]:
            columns = zip(*rows)
            whole = pa.RecordBatch.from_pydict({c: batch.column(c).take(pa.array(pairs)) for c in others} | {c: pa.array(x, _KINDS[c]) for c, x in zip(names, columns)})  # noqa: B023
            for first in range(0, whole.num_rows, _ROWS):
                yield whole.slice(first, _ROWS)

        pairs, rows = [], []
        for k, found in enumerate(word_errors(batch.column("ref").to_pylist(), batch.column("hyp").to_pylist())):
            if found:
                rows += rows_of(found)
                pairs += [k] * (len(rows) - len(pairs))
            if len(rows) >= _ROWS:
                yield from made(pairs, rows)
                pairs, rows = [], []
        if rows:
            yield from made(pairs, rows)
