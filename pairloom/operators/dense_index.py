"""A dense index: lists of trained centroids, residuals as product codes, exact re-ranking (RAG03).

``train`` fits centroids, and codebooks of the residuals' parts, on a bounded sample (``SAMPLE`` vectors by hash of their id); every vector is then assigned and coded. The index is one table sorted by list: codes are a byte
for each part, and the vector itself for re-ranking. A query looks into the ``probe`` lists whose centroids are nearest to it, ranks their members by tables of its products with the codebooks, and the ``pool`` best of
each query are compared exactly. Similarity is the cosine; vectors without a direction (null, zero, not finite, or of another length than the sample's) are in no list.

Queries are a stated set, handled in blocks of bounded size that travel with the tasks; members of a list that no query of a block probes are skipped by a semi-join, and a task keeps ``pool`` rows for each query, so a large
list is as many tasks as it has partitions.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from pairloom.operators.retrieval import dense
from pairloom.plans.shared import kept

SAMPLE, ROUNDS, PARTS, ENTRIES, QUERIES, TRIED = 1 << 15, 12, 16, 256, 1024, 64
_CHUNK = 4096


def directions(rows: list, width: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The places of the vectors that have a direction, and these as rows of length 1."""
    good = [k for k, v in enumerate(rows) if v is not None and len(v) and (width is None or len(v) == width) and None not in v]
    if not good:
        return np.zeros(0, np.int64), np.zeros((0, width or 0))
    x = np.array([rows[k] for k in good], np.float64)
    with np.errstate(all="ignore"):
        norm = np.linalg.norm(x, axis=1)
        keep = np.isfinite(norm) & (norm > 0)
        return np.array(good)[keep], x[keep] / norm[keep, None]


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    half = (centres**2).sum(axis=1) / 2
    return np.concatenate([(x[k : k + _CHUNK] @ centres.T - half).argmax(axis=1) for k in range(0, len(x), _CHUNK)]) if len(x) else np.zeros(0, np.int64)


def _fitted(x: np.ndarray, n: int, rng: np.random.Generator) -> np.ndarray:
    """Centres of ``n`` clusters by Lloyd's rounds; one that loses its members takes a random vector."""
    centres = x[rng.permutation(len(x))[:n]].copy()
    for _ in range(ROUNDS):
        at = _nearest(x, centres)
        count = np.bincount(at, minlength=len(centres))
        order = np.argsort(at, kind="stable")
        full = np.flatnonzero(count)
        centres[full] = np.add.reduceat(x[order], (np.cumsum(count) - count)[full], axis=0) / count[full, None]
        lost = np.flatnonzero(count == 0)
        centres[lost] = x[rng.integers(0, len(x), len(lost))]
    return centres


@dataclass
class Quantiser:
    """Centroids, and for each part of a residual its codebook."""

    centres: np.ndarray
    books: list[np.ndarray]

    @property
    def edges(self) -> np.ndarray:
        return np.cumsum([0, *[b.shape[1] for b in self.books]])

    def coded(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """List and codes of vectors of length 1."""
        at = _nearest(x, self.centres)
        rest, e = x - self.centres[at], self.edges
        return at, np.stack([_nearest(rest[:, a:b], book) for a, b, book in zip(e[:-1], e[1:], self.books)], axis=1).astype(np.uint8)


def train(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", lists: int | None = None, sample: int = SAMPLE, seed: int = 42) -> Quantiser | None:
    """Fits a quantiser on about ``sample`` vectors; ``lists`` is the root of the number of vectors unless given. None without a vector that has a direction."""
    n = vectors.count()
    some = vectors if n <= sample else vectors.where(F.pmod(F.xxhash64(F.lit(seed), key), F.lit(1 << 20)) < int((1 << 20) * sample / n) + 1)
    rows = [r[0] for r in some.select(vector).orderBy(F.xxhash64(F.lit(seed), key)).limit(sample).collect()]
    lengths = [len(v) for v in rows if v is not None and len(v)]
    if not lengths:
        return None
    x = directions(rows, max(set(lengths), key=lengths.count))[1]
    if not len(x):
        return None
    rng = np.random.default_rng(seed)
    centres = _fitted(x, min(len(x), lists or max(1, int(n**0.5))), rng)
    rest = x - centres[_nearest(x, centres)]
    return Quantiser(centres, [_fitted(part, min(len(part), ENTRIES), rng) for part in np.array_split(rest, min(PARTS, x.shape[1]), axis=1)])


def dense_index(vectors: DataFrame, quantiser: Quantiser, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``key, list, codes, vector`` of every vector that has a direction, sorted by list; to be written once."""
    width, kind = quantiser.centres.shape[1], vectors.schema[key]

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, x = directions(batch.column(1).to_pylist(), width)
            lists, codes = quantiser.coded(x)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), pa.array(lists.astype(np.int32)), pa.array([c.tobytes() for c in codes], pa.binary()), batch.column(1).take(pa.array(at))], names=[key, "list", "codes", vector])

    out = T.StructType([kind, T.StructField("list", T.IntegerType()), T.StructField("codes", T.BinaryType()), T.StructField(vector, T.ArrayType(T.DoubleType()))])
    rows = vectors.select(key, F.col(vector).cast("array<double>").alias(vector)).mapInArrow(coded, out)
    return rows.repartitionByRange("list", key).sortWithinPartitions("list")


def _candidates(q: np.ndarray, ids: list, probed: np.ndarray, quantiser: Quantiser, pool: int, out: T.StructType):
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e, least, held = quantiser.edges, np.full(len(ids), -np.inf), []
        tables = [q[:, a:b] @ book.T for a, b, book in zip(e[:-1], e[1:], quantiser.books)]
        near = q @ quantiser.centres.T
        for batch in batches:
            lists = batch.column(1).to_numpy()
            codes = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.uint8).reshape(len(lists), -1)
            x = batch.column(3).flatten().to_numpy().reshape(len(lists), -1)
            x = x / np.linalg.norm(x, axis=1)[:, None]
            for at in np.unique(lists).tolist():
                asked, rows = np.flatnonzero(probed[:, at]), np.flatnonzero(lists == at)
                for first in range(0, len(rows) if len(asked) else 0, _CHUNK):
                    some = rows[first : first + _CHUNK]
                    rough = near[asked, at][:, None] + sum(t[asked][:, codes[some, p]] for p, t in enumerate(tables))
                    floor = np.maximum(least[asked], -np.partition(-rough, pool - 1, axis=1)[:, pool - 1] if len(some) > pool else -np.inf)
                    i, j = np.nonzero(rough >= floor[:, None])
                    held.append(pd.DataFrame({"q": asked[i], "row": batch.column(0).take(pa.array(some[j])).to_pandas(), "rough": rough[i, j], "score": (q[asked] @ x[some].T)[i, j]}))
                    if sum(map(len, held)) > 2 * pool * len(ids):
                        held = [_top(held, pool)]
                        full = held[0].groupby("q").rough.agg(["size", "min"])
                        full = full[full["size"] == pool]
                        least[full.index] = full["min"]
        if held:
            rows = _top(held, pool)
            kinds = [to_arrow_type(f.dataType) for f in out.fields]
            yield pa.RecordBatch.from_arrays([pa.array([ids[i] for i in rows.q], kinds[0]), pa.array(rows.q.to_numpy(), pa.int32()), pa.Array.from_pandas(rows.row, type=kinds[2]), pa.array(rows.rough.to_numpy()), pa.array(rows.score.to_numpy())], names=out.names)

    return search


def _top(parts: list[pd.DataFrame], n: int) -> pd.DataFrame:
    rows = pd.concat(parts, ignore_index=True).sort_values(["q", "rough"], ascending=[True, False], kind="stable")
    return rows[rows.groupby("q").cumcount() < n].reset_index(drop=True)


def near(queries: DataFrame, index: DataFrame, quantiser: Quantiser, k: int, probe: int = 32, pool: int = 200, query: str = "query_id", key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``query, key, score, rank``: the k best of each query's ``pool`` candidates by cosine, without itself; as ``retrieval.dense``, but for what the probed lists and codes miss."""
    asked, out = queries.select(query, F.col(vector).cast("array<double>").alias("v")), None
    kind = T.StructType([queries.schema[query], T.StructField("q", T.IntegerType()), T.StructField(key, index.schema[key].dataType), T.StructField("rough", T.DoubleType()), T.StructField("score", T.DoubleType())])
    blocks = max(1, -(-asked.count() // QUERIES))
    for b in range(blocks):
        rows = (asked if blocks == 1 else asked.where(F.pmod(F.xxhash64(query), F.lit(blocks)) == b)).collect()
        at, q = directions([r.v for r in rows], quantiser.centres.shape[1])
        if not len(at):
            continue
        probed = np.zeros((len(q), len(quantiser.centres)), bool)
        np.put_along_axis(probed, np.argsort(-(q @ quantiser.centres.T), axis=1)[:, :probe], True, axis=1)
        wanted = np.flatnonzero(probed.any(axis=0)).tolist()
        members = index if len(wanted) == probed.shape[1] else index.join(F.broadcast(queries.sparkSession.createDataFrame([(x,) for x in wanted], "list int")), "list", "left_semi")
        found = members.select(key, "list", "codes", vector).mapInArrow(_candidates(q, [rows[i][0] for i in at.tolist()], probed, quantiser, pool + 1, kind), kind)
        pooled = found.withColumn("n", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("rough"), key))).where((F.col("n") <= pool + 1) & ~F.col(query).eqNullSafe(F.col(key)))
        order = Window.partitionBy("q").orderBy(F.round("score", 6).desc(), key)
        part = pooled.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(query, key, "score", "rank")
        out = part if out is None else out.unionByName(part)
    if out is None:
        out = queries.sparkSession.createDataFrame([], T.StructType([queries.schema[query], T.StructField(key, index.schema[key].dataType), T.StructField("score", T.DoubleType()), T.StructField("rank", T.IntegerType())]))
    return out


def tuned(queries: DataFrame, vectors: DataFrame, index: DataFrame, quantiser: Quantiser, k: int, target: float = 0.95, query: str = "query_id", key: str = "vec_id", vector: str = "embedding") -> tuple[int, int, float]:
    """``probe, pool`` that reach the ``target`` recall for ``TRIED`` of the queries (by hash of their id), and that recall, measured against the exact search of all vectors. Data without
    clusters need many lists; with all lists and twice the pool each time the search becomes exact in the end."""
    some = queries.select(query, vector).orderBy(F.xxhash64(query)).limit(TRIED)
    true = kept(dense(some, vectors, k, query, key, vector), "dense-true")
    lists, most = len(quantiser.centres), max(20 * k, vectors.count())
    reached = lambda probe, pool: (recall(near(some, index, quantiser, k, probe, pool, query, key, vector), true, query, key), probe, pool)
    found, probe, pool = reached(max(1, lists // 16), min(most, 20 * k))
    while found < target and (probe < lists or pool < most):
        # twice the lists or twice the pool, whichever does more
        tries = [reached(*x) for x in {(min(lists, 2 * probe), pool), (probe, min(most, 2 * pool))} - {(probe, pool)}]
        found, probe, pool = max(tries, key=lambda x: (x[0], -x[2]))
    return probe, pool, found


def recall(found: DataFrame, true: DataFrame, query: str = "query_id", key: str = "vec_id") -> float:
    """The share of the true rows (``query, key``) that were found."""
    want = true.select(query, key)
    n = want.count()
    return want.join(found.select(query, key).distinct(), [query, key], "left_semi").count() / n if n else 1.0
