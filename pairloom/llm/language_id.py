"""Language identification by hyperdimensional profiles.

Each letter (and the gap between words) has a fixed random vector of +1 and -1. A trigram's vector binds, by products, its letters' vectors permuted by
their places; a text bundles, by sums, the vectors of its trigrams; a language's prototype bundles its training texts. A text gets the language
whose prototype has the greatest cosine.

Learning reads every training row: partial prototypes of each partition are summed by language and dimension, and only the sums (``dims`` numbers for each
of at most ``max_languages`` languages, else an error) reach the driver and the tasks.

Edge cases: null texts and texts without a letter get ``und`` and score 0, as do all texts if nothing could be learned; equal cosines go to the
smaller language name; a very long text is one sum over its trigrams, whose number bounds the memory; rows without lang teach nothing; repeated rows come back, and teach, once each; null doc_id is kept and its row teaches
nothing; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairloom.llm.letters import letters
from pairloom.llm.store import tidy
from pairloom.llm.words import mix

DIMS, MAX_LANGUAGES, UNKNOWN = 1024, 4096, "und"
_DOCS, _SYMBOLS, _CACHE = 256, 400_000, 1 << 15


def letter_vectors(points: np.ndarray, dims: int) -> np.ndarray:
    bits = mix(points.astype(np.uint64)[:, None] * np.uint64(0x9E3779B97F4A7C15) + mix(np.arange(dims, dtype=np.uint64))[None, :])
    return np.where(bits >> np.uint64(63), 1, -1).astype(np.int8)


class TrigramVectors:
    """Vectors of trigrams; those met before are kept until there are ``_CACHE`` of them."""

    def __init__(self, dims: int) -> None:
        self.dims = dims
        # rows of ``vectors`` are filled one after another; ``place`` is the row of each key, keys sorted
        self.vectors = np.empty((_CACHE, dims), np.int8)
        self._clear()

    def _clear(self) -> None:
        self.keys, self.place = np.zeros(0, np.uint64), np.zeros(0, np.int64)

    def _made(self, keys: np.ndarray) -> np.ndarray:
        mask = np.uint64((1 << 21) - 1)
        out = np.ones((len(keys), self.dims), np.int8)
        for place in range(3):
            points, at = np.unique((keys >> np.uint64(21 * (2 - place))) & mask, return_inverse=True)
            out *= np.roll(letter_vectors(points, self.dims), 2 - place, axis=1)[at]
        return out

    def of(self, keys: np.ndarray) -> np.ndarray:
        """``keys`` are distinct and sorted, ``_CACHE`` at most."""
        new = keys[~np.isin(keys, self.keys, assume_unique=True)]
        if len(self.keys) + len(new) > _CACHE:
            self._clear()
            new = keys
        if len(new):
            n = len(self.keys)
            self.vectors[n : n + len(new)] = self._made(new)
            known = np.concatenate((self.keys, new))
            order = np.argsort(known)
            self.keys, self.place = known[order], np.concatenate((self.place, np.arange(n, n + len(new))))[order]
        return self.vectors[self.place[np.searchsorted(self.keys, keys)]]


def trigrams(symbols: np.ndarray) -> np.ndarray:
    """Three letters or gaps in a row, the middle one a letter, as one number each."""
    s = symbols.astype(np.uint64)
    keys = (s[:-2] << np.uint64(42)) | (s[1:-1] << np.uint64(21)) | s[2:]
    return keys[s[1:-1] != 0]


def _portions(texts: Iterator[str | None]) -> Iterator[tuple[list[int], list[np.ndarray]]]:
    rows: list[int] = []
    keys: list[np.ndarray] = []
    held = 0
    for i, text in enumerate(texts):
        rows.append(i)
        keys.append(trigrams(letters(text)) if text else np.zeros(0, np.uint64))
        held += len(keys[-1])
        if len(rows) >= _DOCS or held >= _SYMBOLS:
            yield rows, keys
            rows, keys, held = [], [], 0
    if rows:
        yield rows, keys


def bundles(keys: list[np.ndarray], groups: np.ndarray, n: int, vectors: TrigramVectors) -> np.ndarray:
    """Sums of the trigram vectors of the texts in each of n groups."""
    distinct, at = np.unique(np.concatenate(keys), return_inverse=True)
    out = np.zeros((n, vectors.dims))
    if not len(distinct):
        return out
    owner = np.repeat(groups, [len(k) for k in keys])
    for first in range(0, len(distinct), 2048):
        mine = (at >= first) & (at < first + 2048)
        width = min(2048, len(distinct) - first)
        counts = np.bincount(owner[mine] * width + at[mine] - first, minlength=n * width).reshape(n, width)
        out += counts.astype(np.float32) @ vectors.of(distinct[first : first + 2048]).astype(np.float32)
    return out


def _learn(dims: int):
    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vectors, sums = TrigramVectors(dims), {}
        for batch in batches:
            langs = batch.column(0).to_pylist()
            for rows, keys in _portions(x.as_py() for x in batch.column(1)):
                names, group = np.unique([langs[i] for i in rows], return_inverse=True)
                for name, vector in zip(names.tolist(), bundles(keys, group, len(names), vectors)):
                    sums[name] = sums.get(name, 0) + vector
        if sums:
            yield pa.RecordBatch.from_pydict({"lang": list(sums), "vector": [v.tolist() for v in sums.values()]}, schema=pa.schema([("lang", pa.string()), ("vector", pa.list_(pa.float64()))]))

    return tidy(learn)


def learn_languages(rows: DataFrame, dims: int = DIMS, max_languages: int = MAX_LANGUAGES) -> tuple[list[str], np.ndarray]:
    """Languages, sorted, and their prototypes from rows of ``lang, text``."""
    parts = rows.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("lang", "text").mapInArrow(_learn(dims), "lang string, vector array<double>")
    sums = parts.select("lang", F.posexplode("vector").alias("dim", "x")).groupBy("lang", "dim").agg(F.sum("x").alias("x"))
    by_lang: dict[str, np.ndarray] = {}
    for r in sums.toLocalIterator():
        by_lang.setdefault(r.lang, np.zeros(dims))[r.dim] = r.x
        if len(by_lang) > max_languages:
            raise ValueError(f"more than {max_languages} languages to learn")
    names = sorted(x for x, v in by_lang.items() if v.any())
    return names, np.stack([by_lang[x] for x in names]) if names else np.zeros((0, dims))


def _predict(names: list[str], prototypes: np.ndarray, first: int):
    """Predictions for the texts in column 0, after the columns from ``first`` on."""
    dims = prototypes.shape[1]
    unit = (prototypes / np.maximum(np.linalg.norm(prototypes, axis=1, keepdims=True), 1e-12)).astype(np.float64)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vectors = TrigramVectors(dims)
        for batch in batches:
            langs, scores, rejected = [UNKNOWN] * batch.num_rows, np.zeros(batch.num_rows), np.ones(batch.num_rows, bool)
            for rows, keys in _portions(x.as_py() for x in batch.column(0)):
                rejected[rows] = [not len(k) for k in keys]
                if not names:
                    continue
                v = bundles(keys, np.arange(len(keys)), len(keys), vectors)
                cosine = (v @ unit.T) / np.maximum(np.linalg.norm(v, axis=1), 1e-12)[:, None]
                best = cosine.argmax(axis=1)
                for k, i in enumerate(rows):
                    if len(keys[k]):
                        langs[i], scores[i] = names[best[k]], min(1.0, max(0.0, cosine[k, best[k]]))
            yield pa.RecordBatch.from_arrays([*batch.columns[first:], pa.array(langs, pa.string()), pa.array(scores), pa.array(rejected)], names=[*batch.schema.names[first:], "lang_pred", "score", "rejected"])

    return tidy(predict)


def predict_languages(rows: DataFrame, model: tuple[list[str], np.ndarray], keep: list[str]) -> DataFrame:
    """Columns ``keep`` of ``rows`` with ``lang_pred``, ``score`` and ``rejected`` (no letter) of their column ``text``."""
    others = [c for c in keep if c != "text"]  # a text that is kept goes to the workers once
    kept = rows.select("text", *[F.col(c).alias(f"c{i}") for i, c in enumerate(others)])
    first = 1 - ("text" in keep)
    types = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in kept.schema.fields[first:])
    out = kept.mapInArrow(_predict(*model, first), f"{types}, lang_pred string, score double, rejected boolean")
    return out.select(*[F.col("text" if c == "text" else f"c{others.index(c)}").alias(c) for c in keep], "lang_pred", "score", "rejected")


def fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``."""
    return F.crc32(doc_id.cast("string").cast("binary")) % folds


def identify_held_out(documents: DataFrame, folds: int = 5) -> DataFrame:
    """``doc_id, held_out, lang_pred, score, rejected``; rows of fold 0 (``held_out``) and rows without doc_id are not learned from."""
    held_out = F.coalesce(fold(F.col("doc_id"), folds) == 0, F.lit(True))
    model = learn_languages(documents.where(~held_out))
    return predict_languages(documents.select("text", "doc_id", held_out.alias("held_out")), model, ["doc_id", "held_out"])
