"""The entries most like a query's error signature, exactly and without all pairs (JON17, SIG01, SIG02).

A signature has two sets (confused characters, error types) and two numbers (difficulty, invalid words); an entry that shares a character or type with a query scores the weighted sum of
both Jaccard similarities and of 1 / (1 + difference) of both numbers. Sets are bit masks, and the index is written once, sorted by sets and numbers. A query's k-th best score among a ``STEP``-th
of the entries is a threshold that its result can't fall below; it is found in the same way from a ``STEP``-th of these, down to ``LEAST`` entries. With a threshold, distinct sets of characters are
compared first: how alike they are leaves a range of difficulties for each query and set, and only entries in that range are scored. All entries take part in the last pass. Queries are a
stated set, compared in blocks of bounded size; k rows of each query and task are all that is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from pairloom.operators.gram_index import SLACK, best_of
from pairloom.plans.shared import kept

WEIGHTS = (0.4, 0.3, 0.2, 0.1)
ENTRIES, QUERIES = 1 << 16, 1 << 15
STEP, LEAST = 32, 1 << 12
_CELLS, _PAIRS, _HELD, _HASHES = 1 << 20, 1 << 18, 1 << 16, 1 << 30
_SETS, _NUMBERS = ("chars", "types"), ("difficulty", "invalid")


def signatures(errors: DataFrame, key: str, invalid: DataFrame | None = None, usual: DataFrame | None = None) -> DataFrame:
    """``key, chars, types, difficulty, invalid`` from error rows (``key, gt_char, ocr_char, error_type``, or counts of such rows with a ``count``): the sets of wrong characters and of types, the number of errors, and the number of
    invalid words from ``invalid`` (``key, invalid``; 0 elsewhere). ``usual`` (``ocr_char``): only these characters count, as ``high_confusion`` gives them."""
    char = F.col("ocr_char")
    if usual is not None:
        errors = errors.join(usual.select("ocr_char").distinct().withColumn("usual", F.lit(True)), "ocr_char", "left")
        char = F.when(F.col("usual"), F.col("ocr_char"))
    out = errors.groupBy(key).agg(F.array_sort(F.collect_set(F.nullif(char, F.lit("")))).alias("chars"), F.array_sort(F.collect_set("error_type")).alias("types"), (F.sum("count") if "count" in errors.columns else F.count("*")).alias("difficulty"))
    if invalid is None:
        return out.withColumn("invalid", F.lit(0).cast("long"))
    return out.join(invalid.select(key, F.col("invalid").cast("long").alias("invalid")), key, "left").na.fill(0, ["invalid"])


def high_confusion(matrix: DataFrame, least: int = 2, top: int | None = None, compat: bool = False) -> DataFrame:
    """``ocr_char, count``: the characters that a confusion matrix (``gt_char, ocr_char, count``) shows as wrong at least ``least`` times, most frequent first if ``top``.
    ``compat`` takes the reference's characters instead, as older indexes did."""
    char = F.col("gt_char" if compat else "ocr_char")
    out = matrix.groupBy(char.alias("ocr_char")).agg(F.sum("count").alias("count")).where((F.col("count") >= least) & (F.col("ocr_char") != ""))
    return out if top is None else out.orderBy(F.desc("count"), "ocr_char").limit(top)


def signature_index(corrections: DataFrame, signed: DataFrame, key: str = "sample_id", success_only: bool = True, max_text_len: int = 500, min_cer: float = 0.0) -> DataFrame:
    """What an index of signatures holds: ``signed`` of the corrections (``key, ocr_text, gt_text, corrected_text, cer_ocr, cer_llm``) that had errors above ``min_cer``, are not too long and, if
    ``success_only``, that the model improved; with ``llm_succeeded``."""
    rows = corrections.withColumn("llm_succeeded", F.col("cer_llm") < F.col("cer_ocr"))
    fit = (F.col("cer_ocr") > min_cer) & (F.length("gt_text") <= max_text_len) & (F.col("llm_succeeded") | F.lit(not success_only))
    return rows.where(fit).select(key, "ocr_text", "gt_text", "llm_succeeded").join(signed, key)


@dataclass
class _Side:
    """Signatures of some rows: sets as bit masks over a vocabulary (rows of 64-bit words) with their sizes, and numbers."""

    ids: pa.Array
    masks: list[np.ndarray]
    sizes: list[np.ndarray]
    numbers: list[np.ndarray]
    vocabulary: list[pa.Array]


def _side(rows: pa.Table, vocabulary: list[pa.Array] | None = None) -> _Side:
    """Of rows whose sets hold no null and nothing twice. Without a vocabulary, it is what these rows hold."""
    masks, sizes, known = [], [], []
    for k in range(2):
        sets = rows.column(1 + k).combine_chunks()
        size = pc.fill_null(pc.list_value_length(sets), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        values = pc.list_flatten(sets)
        words = vocabulary[k] if vocabulary else pc.unique(values)
        code = pc.fill_null(pc.index_in(values, value_set=words), -1).to_numpy(zero_copy_only=False).astype(np.int64)
        ends = np.concatenate(([0], np.cumsum(size)))
        bit = np.uint64(1) << (code & 63).astype(np.uint64)
        mask = np.zeros((len(size), max(1, -(-len(words) // 64))), np.uint64)
        for w in range(mask.shape[1]):
            total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(np.where(code >> 6 == w, bit, np.uint64(0)), dtype=np.uint64)))
            mask[:, w] = total[ends[1:]] - total[ends[:-1]]  # a sum of different bits; differences are right modulo 2^64
        masks.append(mask)
        sizes.append(size.astype(np.float64))
        known.append(words)
    numbers = [np.nan_to_num(rows.column(3 + k).cast(pa.float64()).to_numpy()) for k in range(2)]
    return _Side(rows.column(0).combine_chunks(), masks, sizes, numbers, known)


def _common(one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """Sizes of intersections of masks, whose words are the last axis."""
    return np.bitwise_count(one & two).sum(axis=-1, dtype=np.int32) if one.shape[-1] > 1 else np.bitwise_count(one[..., 0] & two[..., 0])


def _share(common: np.ndarray, one: np.ndarray, two: np.ndarray) -> np.ndarray:
    return np.divide(common, one + two - common, out=np.zeros(common.shape), where=common > 0)


def _slices(counts: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of places with counts of about ``_PAIRS`` in all."""
    ends, first = np.cumsum(counts), 0
    while first < len(counts):
        upto = max(first + 1, int(np.searchsorted(ends, (ends[first - 1] if first else 0) + _PAIRS, side="right")))
        yield first, upto
        first = upto


def _spread(first: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of all numbers of some ranges, the range and the number."""
    at = np.repeat(np.arange(len(counts)), counts)
    return at, np.arange(len(at)) - np.repeat(np.cumsum(counts) - counts, counts) + first[at]


def _groups(side: _Side, then: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """An order of rows that puts equal sets of characters together, then by ``then``; where each such group starts in it; the group of each place."""
    order = np.lexsort((then, side.sizes[0], *side.masks[0].T))
    mask, size = side.masks[0][order], side.sizes[0][order]
    new = np.ones(len(order), bool)
    new[1:] = (size[1:] != size[:-1]) | (mask[1:] != mask[:-1]).any(axis=1)
    return order, np.flatnonzero(new), np.cumsum(new) - 1


def _candidates(q: _Side, e: _Side, least: np.ndarray, weights: tuple[float, ...]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Queries, entries and scores of all pairs that share something and can reach the query's ``least``, and of some others."""
    asked, q_first, _ = _groups(q, q.numbers[0])
    order, e_first, group = _groups(e, e.numbers[0])
    if not len(asked) or not len(order):
        return
    q_count = np.diff(np.append(q_first, len(asked)))
    e_mask, e_size = e.masks[0][order[e_first]], e.sizes[0][order[e_first]]
    levels, level = np.unique(e.numbers[0][order], return_inverse=True)
    place = group * (len(levels) + 1) + level
    needed = np.minimum.reduceat(least[asked], q_first) - 2 * SLACK - sum(weights[1:])
    rows = max(1, _CELLS // len(e_first))
    for start in range(0, len(q_first), rows):
        some = slice(start, start + rows)
        mask, size = q.masks[0][asked[q_first[some]]], q.sizes[0][asked[q_first[some]]]
        common = _common(mask[:, None], e_mask[None]).astype(np.float32)
        share = common / np.maximum(size.astype(np.float32)[:, None] + e_size.astype(np.float32)[None] - common, 1)
        which, other = np.nonzero(weights[0] * share >= (needed[some] - 1e-5).astype(np.float32)[:, None])
        for a, b in _slices(q_count[start + which]):
            at, i = _spread(q_first[start + which[a:b]], q_count[start + which[a:b]])
            i, g, shared = asked[i], other[a:b][at], common[which[a:b], other[a:b]][at]
            base = weights[0] * _share(shared.astype(np.float64), q.sizes[0][i], e_size[g])
            typed = q.sizes[1][i] > 0
            over = least[i] - 2 * SLACK - base - weights[1] * typed - weights[3]
            with np.errstate(divide="ignore"):
                reach = np.where(over > 0, weights[2] / over - 1, np.inf)
            fit = np.flatnonzero((reach >= 0) & (typed | (shared > 0)))
            i, g, reach = i[fit], g[fit], reach[fit]
            low = np.searchsorted(place, g * (len(levels) + 1) + np.searchsorted(levels, q.numbers[0][i] - reach))
            high = np.searchsorted(place, g * (len(levels) + 1) + np.searchsorted(levels, q.numbers[0][i] + reach, side="right"))
            for c, d in _slices(high - low):
                at, j = _spread(low[c:d], (high - low)[c:d])
                # a group of a whole block is cut once more, so that memory does not depend on it
                for f in range(0, len(at), 4 * _PAIRS):
                    yield _scored(q, e, i[c:d][at[f : f + 4 * _PAIRS]], order[j[f : f + 4 * _PAIRS]], weights)


def _scored(q: _Side, e: _Side, i: np.ndarray, j: np.ndarray, weights: tuple[float, ...]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Scores of pairs; 0 where they share nothing."""
    common = [_common(q.masks[k][i], e.masks[k][j]).astype(np.float64) for k in range(2)]
    shares = [_share(c, q.sizes[k][i], e.sizes[k][j]) for k, c in enumerate(common)]
    near = [1 / (1 + np.abs(q.numbers[k][i] - e.numbers[k][j])) for k in range(2)]
    score = weights[0] * shares[0] + weights[1] * shares[1] + weights[2] * near[0] + weights[3] * near[1]
    return i, j, np.where(common[0] + common[1] > 0, score, 0.0)


def _entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    held, n = [], 0
    for batch in batches:
        held, n = [*held, batch], n + batch.num_rows
        if n >= ENTRIES:
            rows = pa.Table.from_batches(held)
            for first in range(0, n - n % ENTRIES, ENTRIES):
                yield rows.slice(first, ENTRIES)
            held, n = rows.slice(n - n % ENTRIES).to_batches(), n % ENTRIES
    if n:
        yield pa.Table.from_batches(held)


def _search(q: _Side, k: int, weights: tuple[float, ...], floor: np.ndarray, out: T.StructType, counted: bool = False):
    """The k best of each query among the entries of a task that reach its ``floor``; ``counted``: instead the numbers of pairs and of those that were scored."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        least, held, n_held, pairs, scored = floor.copy(), [], 0, 0, 0

        def shrunk() -> pd.DataFrame:
            best = best_of(pd.concat(held, ignore_index=True), k)
            full = best.groupby("q").score.agg(["size", "min"])
            full = full[full["size"] == k]
            least[full.index] = np.maximum(least[full.index], full["min"])
            return best

        for rows in _entries(batches):
            pairs += rows.num_rows * len(q.ids)
            e = _side(rows, q.vocabulary)
            for i, j, score in _candidates(q, e, least, weights):
                scored += len(i)
                fit = (score > 0) & (score >= least[i] - SLACK)
                if fit.any():
                    held.append(pd.DataFrame({"q": i[fit], "key": e.ids.take(pa.array(j[fit])).to_pandas(integer_object_nulls=True), "score": score[fit]}))
                    n_held += len(held[-1])
                if n_held > _HELD + 2 * k * len(q.ids):
                    held = [shrunk()]
                    n_held = len(held[0])
        if counted:
            yield pa.RecordBatch.from_arrays([pa.array([pairs]), pa.array([scored])], names=["pairs", "scored"])
        elif held:
            best = shrunk()
            kinds = [to_arrow_type(f.dataType) for f in out.fields]
            yield pa.RecordBatch.from_arrays([q.ids.take(pa.array(best.q.to_numpy())).cast(kinds[0]), pa.array(best.q.to_numpy(), pa.int32()), pa.Array.from_pandas(best.key, type=kinds[2]), pa.array(best.score.to_numpy())], names=out.names)

    return search


def _clean(rows: DataFrame, key: str) -> DataFrame:
    return rows.select(key, *(F.array_distinct(F.array_compact(c)).alias(c) for c in _SETS), *_NUMBERS)


def sorted_signatures(index: DataFrame) -> DataFrame:
    """Entries with like sets, and then like numbers, next to each other, in at least four parts for each core; written once for all passes and queries."""
    rows = _clean(index, "entry_id")
    parts = max(4 * index.sparkSession.sparkContext.defaultParallelism, int(index.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return kept(rows.repartitionByRange(parts, *_SETS, *_NUMBERS, "entry_id").sortWithinPartitions(*_SETS, *_NUMBERS), "signatures-sorted")


def _blocks_of_queries(queries: DataFrame) -> Iterator[_Side]:
    asked = kept(_clean(queries, "query_id"), "signatures-asked")
    blocks = max(1, -(-asked.count() // QUERIES))
    for b in range(blocks):
        rows = (asked if blocks == 1 else asked.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b)).toArrow()
        if rows.num_rows:
            yield _side(rows)


def _prepared(queries: DataFrame, index: DataFrame, k: int, weights: tuple[float, ...]) -> Iterator[tuple[_Side, DataFrame, np.ndarray, T.StructType]]:
    """For each block of queries: these, the sorted entries, the thresholds, and the schema of what is found."""
    rows = sorted_signatures(index)
    out = T.StructType([queries.schema["query_id"], T.StructField("q", T.IntegerType()), T.StructField("key", index.schema["entry_id"].dataType), T.StructField("score", T.DoubleType())])
    parts, n = [], rows.count() // STEP
    while n > k:
        parts.insert(0, STEP ** (len(parts) + 1))
        if n <= LEAST:
            break
        n //= STEP
    # part of the entries for thresholds only: any k scores bound the k-th best of all from below
    parts = [kept(rows.where(F.pmod(F.xxhash64("entry_id", *_NUMBERS), F.lit(_HASHES)) < _HASHES // p), "signatures-part") for p in parts]
    for q in _blocks_of_queries(queries):
        floor = np.zeros(len(q.ids))
        for part in parts:
            order = Window.partitionBy("q").orderBy(F.desc("score"))
            found = part.mapInArrow(_search(q, k, weights, floor, out), out).withColumn("rank", F.row_number().over(order)).where(F.col("rank") == k).select("q", "score").toArrow()
            at = found.column("q").to_numpy()
            floor[at] = np.maximum(floor[at], found.column("score").to_numpy())
        yield q, rows, floor, out


def signature_matches(queries: DataFrame, index: DataFrame, k: int = 5, weights: tuple[float, float, float, float] = WEIGHTS) -> DataFrame:
    """``query_id, entry_id, score, rank``: the k entries most like a query. Both sides have ``chars, types`` (arrays) and ``difficulty, invalid`` (numbers; null is 0)."""
    out = None
    for q, rows, floor, kind in _prepared(queries, index, k, weights):
        order = Window.partitionBy("q").orderBy(F.round("score", 6).desc(), "key")
        found = rows.mapInArrow(_search(q, k, weights, floor, kind), kind).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        found = found.select("query_id", F.col("key").alias("entry_id"), "score", "rank")
        out = found if out is None else out.unionByName(found)
    if out is None:
        out = queries.sparkSession.createDataFrame([], T.StructType([queries.schema["query_id"], T.StructField("entry_id", index.schema["entry_id"].dataType), T.StructField("score", T.DoubleType()), T.StructField("rank", T.IntegerType())]))
    return out


def signature_work(queries: DataFrame, index: DataFrame, k: int = 5, weights: tuple[float, float, float, float] = WEIGHTS) -> tuple[int, int]:
    """How many pairs of a query and an entry there are, and how many of these the last pass scores."""
    found = [r for q, rows, floor, kind in _prepared(queries, index, k, weights) for r in rows.mapInArrow(_search(q, k, weights, floor, kind, counted=True), "pairs long, scored long").collect()]
    return sum(r.pairs for r in found), sum(r.scored for r in found)
