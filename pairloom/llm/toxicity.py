"""Toxicity: a linear classifier on character n-grams whose features are scaled by naive Bayes log-count ratios.

Features are the distinct n-grams (3 to 6 characters, lower case, any characters, hashed to ``1 << log2_bins`` bins) of a whole text. The counts of
texts with each bin, by label, are taken over every training row with Spark sums. A bin's ratio r is the log of its smoothed share among toxic texts
over its share among others. Bins whose ratio is well beyond chance (a two-proportion z test) are the features, at most ``max_features`` of
them, best first; a logistic regression with L2 penalty is then fitted on inputs r * present. It is fitted on about ``fit_rows`` training rows
of each label (those with the smallest hashes of doc_id; all if there are fewer), which bounds the driver's memory: only their feature lists reach it, never texts.

A score is the logistic of the weighted sum over a whole text, so it needs one pass and no stored text. Few features, all far from chance, keep
long clean texts from drifting towards either label.

Edge cases: null and empty texts have no feature and get the intercept's score; without rows of both labels every score is the share of toxic
training rows (0 if there are none); null labels teach nothing; null doc_id is kept, taught from never, and counts as held out; a doc_id that is
repeated in either table teaches once for each pair; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairloom.llm.language_id import fold
from pairloom.llm.letters import code_points, ngram_hashes
from pairloom.llm.store import written

SIZES, LOG2_BINS, MAX_FEATURES, FIT_ROWS, CUT = (3, 4, 5, 6), 20, 4096, 20_000, 0.7
_GAP, _SLICE = 32, 1 << 17


def text_bins(text: str | None, log2_bins: int, among: np.ndarray | None = None) -> np.ndarray:
    """The distinct bins of a text's n-grams, those with ``among[bin] >= 0`` if it is given."""
    if not text:
        return np.zeros(0, np.int64)
    points = code_points(text)
    points = np.concatenate(([_GAP], points, [_GAP])).astype(np.uint32)
    out = []
    for first in range(0, len(points), _SLICE):  # very long texts piece by piece, overlapping by the longest n-gram less one
        hashes = ngram_hashes(points[first : first + _SLICE + SIZES[-1] - 1], SIZES)
        bins = (hashes >> np.uint64(64 - log2_bins)).astype(np.int64)
        out.append(np.unique(bins if among is None else bins[among[bins] >= 0]))
    return np.unique(np.concatenate(out))


def _counts(log2_bins: int):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((2, 1 << log2_bins), np.int64)
        for batch in batches:
            for label, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                sums[label][text_bins(text.as_py(), log2_bins)] += 1
        some = np.flatnonzero(sums.any(axis=0))
        for first in range(0, len(some), 1 << 16):
            b = some[first : first + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(b), pa.array(sums[1][b]), pa.array(sums[0][b])], names=["bin", "toxic", "clean"])

    return count


def _present(log2_bins: int, index: np.ndarray):
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [index[text_bins(t.as_py(), log2_bins, index)].tolist() for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.int32()))], names=["label", "features"])

    return find


def fit_logistic(lists: list[np.ndarray], labels: np.ndarray, scale: np.ndarray, penalty: float = 5e-4, steps: int = 200) -> tuple[np.ndarray, float]:
    """Weights (times ``scale``) and intercept that minimise the mean log loss plus penalty / 2 * |w|**2, by L-BFGS."""
    n, k = len(lists), len(scale)
    row = np.repeat(np.arange(n), [len(x) for x in lists])
    col = np.concatenate(lists) if len(row) else np.zeros(0, np.int64)
    value = scale[col]

    def loss(w: np.ndarray) -> tuple[float, np.ndarray]:
        z = np.bincount(row, value * w[col], minlength=n) + w[k]
        error = (1 / (1 + np.exp(-np.clip(z, -35, 35))) - labels) / n
        gradient = np.append(np.bincount(col, value * error[row], minlength=k) + penalty * w[:k], error.sum())
        return float(np.logaddexp(0, np.where(labels > 0, -z, z)).mean() + penalty / 2 * (w[:k] ** 2).sum()), gradient

    w = np.zeros(k + 1)
    at, gradient = loss(w)
    pairs: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(steps):
        if np.abs(gradient).max() < 1e-7:
            break
        step, kept = gradient.copy(), []
        for s, y in reversed(pairs):
            kept.append(f := (s @ step) / (s @ y))
            step -= f * y
        step *= (pairs[-1][0] @ pairs[-1][1]) / (pairs[-1][1] @ pairs[-1][1]) if pairs else 1 / max(1.0, np.abs(gradient).sum())
        for (s, y), f in zip(pairs, reversed(kept)):
            step += (f - (y @ step) / (s @ y)) * s
        size, slope = 1.0, gradient @ step
        while True:
            after, new = loss(w - size * step)
            if after <= at - 1e-4 * size * slope or size < 1e-9:
                break
            size /= 2
        s, y = -size * step, new - gradient
        if s @ y > 1e-12:
            pairs = [*pairs[-9:], (s, y)]
        w, at, gradient = w - size * step, after, new
        if size < 1e-9:
            break
    return w[:k] * scale, float(w[k])


class Model:
    """``index`` gives a bin's place in ``weights``, or -1."""

    def __init__(self, log2_bins: int, index: np.ndarray, weights: np.ndarray, intercept: float) -> None:
        self.log2_bins, self.index, self.weights, self.intercept = log2_bins, index, weights, intercept

    def score(self, text: str | None) -> float:
        z = self.intercept + self.weights[self.index[text_bins(text, self.log2_bins, self.index)]].sum()
        return float(1 / (1 + np.exp(-np.clip(z, -35, 35))))


def learn_toxicity(rows: DataFrame, log2_bins: int = LOG2_BINS, max_features: int = MAX_FEATURES, fit_rows: int = FIT_ROWS) -> Model:
    """A model from rows of ``doc_id, label (0 or 1), text``."""
    rows = written(rows.where("label IN (0, 1)").select("doc_id", F.col("label").cast("int").alias("label"), "text"), "toxicity-train")
    totals = {r.label: r.n for r in rows.groupBy("label").agg(F.count("*").alias("n")).collect()}
    n1, n0 = totals.get(1, 0), totals.get(0, 0)
    empty = np.full(1 << log2_bins, -1, np.int32)
    if not n1 or not n0:
        share = n1 / max(1, n1 + n0)
        return Model(log2_bins, empty, np.zeros(1), float(np.clip(np.log((share + 1e-15) / (1 - share + 1e-15)), -35, 35)))
    sums = rows.select("label", "text").mapInArrow(_counts(log2_bins), "bin long, toxic long, clean long").groupBy("bin").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    p, q, both = F.col("toxic") / n1, F.col("clean") / n0, (F.col("toxic") + F.col("clean")) / (n1 + n0)
    z = (p - q) / F.sqrt(both * (1 - both) * (1 / n1 + 1 / n0) + 1e-12)
    ratio = F.log((F.col("toxic") + 1) / (n1 + 2)) - F.log((F.col("clean") + 1) / (n0 + 2))
    best = sums.select("bin", z.alias("z"), ratio.alias("r")).where("abs(z) > 4 AND abs(r) > 0.7").orderBy(F.desc(F.abs("z")), "bin").limit(max_features).toPandas()
    index = empty
    index[best["bin"].to_numpy(np.int64)] = np.arange(len(best), dtype=np.int32)
    share = F.when(F.col("label") == 1, fit_rows / n1).otherwise(fit_rows / n0)
    sample = rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 31)) < share * (1 << 31))
    lists = sample.select("label", "text").mapInArrow(_present(log2_bins, index), "label int, features array<int>").toPandas()
    weights, intercept = fit_logistic([np.asarray(x, np.int64) for x in lists["features"]], lists["label"].to_numpy(float), best["r"].to_numpy(float))
    return Model(log2_bins, index, weights if len(weights) else np.zeros(1), intercept)


def _score(model: Model):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = [model.score(t.as_py()) for t in batch.column(0)]
            yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(2), pa.array(scores, pa.float64())], names=["doc_id", "held_out", "score"])

    return score


def score_toxicity(documents: DataFrame, labels: DataFrame, folds: int = 3, held: int = 1) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of each document; labels of fold ``held`` are not learned from."""
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    # one plan at every size: texts of the folds to learn from are dealt once, and labels are never broadcast
    train = docs.join(labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").alias("label")).hint("merge"), "doc_id").where(fold(F.col("doc_id"), folds) != held)
    model = learn_toxicity(train)
    held_out = F.coalesce(fold(F.col("doc_id"), folds) == held, F.lit(True))
    scored = docs.select("text", "doc_id", held_out.alias("held_out")).mapInArrow(_score(model), "doc_id long, held_out boolean, score double")
    return scored.withColumn("predicted", (F.col("score") >= CUT).cast("int"))
