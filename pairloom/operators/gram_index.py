"""A block index of character n-grams, and exact top-k BM25 over it with pruning by block maxima (JON16, RAG01, RAG02, TOP09).

The index is one table, written once: a row holds up to ``DOCUMENTS`` documents of similar length as postings by gram. A set of queries is answered in blocks of
bounded size, each in three scans of the index: how many documents have each gram asked for; exact scores of documents that hold a query's rarest
grams, whose k-th best is a threshold that the result can't fall below; then each block of documents, of which the greatest contribution of each gram bounds all
scores of a query from above, so that only queries whose bound reaches their threshold are scored there. A task keeps the k best of each query and
raises the thresholds as it goes, so k rows of each query and task are all that is shuffled: no (query, document, gram) row is ever made.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from pairloom.plans.shared import kept, small_batches

K1, B = 1.5, 0.75
DOCUMENTS, CHARACTERS = 64, 1 << 18
QUERIES, QUERY_CHARACTERS = 512, 1 << 20
SAMPLE, SLACK = 64, 1e-6
_HELD = 1 << 16
_ODD = np.uint64(0x9E3779B97F4A7C15)


def gram_codes(texts: list[str], n: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each n-gram of all texts the number of its text and a code: three code points fit 63 bits; longer grams are hashed to as many."""
    lengths = np.array([len(t) for t in texts], np.int64)
    points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    ends = np.repeat(np.cumsum(lengths), lengths)
    at = np.flatnonzero(np.arange(len(points)) + n <= ends)
    code = np.zeros(len(at), np.uint64)
    for k in range(n):
        code = (code << np.uint64(21) if n <= 3 else (code ^ code >> np.uint64(29)) * _ODD) + points[at + k]
    return np.searchsorted(np.cumsum(lengths), at, side="right"), (code & np.uint64((1 << 63) - 1)).astype(np.int64)


def packed(x: np.ndarray) -> bytes:
    """Numbers from 0 in as few bytes each as the greatest needs (their width is the last byte): an engine's array takes four or eight for each, in all its copies."""
    kind = np.min_scalar_type(int(x.max())) if len(x) else np.dtype(np.uint8)
    return x.astype(kind.newbyteorder("<")).tobytes() + bytes([kind.itemsize])


def unpacked(x: pa.BinaryScalar) -> np.ndarray:
    held = memoryview(x.as_buffer())
    return np.frombuffer(held, f"<u{held[-1]}", (len(held) - 1) // held[-1]).astype(np.int64)


def _blocks(n: int, key: pa.DataType) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, texts = batch.column(0), pc.fill_null(batch.column(1), "")
            length = pc.utf8_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
            # documents of one length have like contributions, which keeps the bounds of a block low
            order, first = np.argsort(length, kind="stable"), 0
            while first < len(order):
                upto = np.cumsum(length[order[first : first + DOCUMENTS]])
                some = order[first : first + max(1, int(np.searchsorted(upto, CHARACTERS, side="right")))]
                first += len(some)
                doc, code = gram_codes(texts.take(pa.array(some)).to_pylist(), n)
                by = np.lexsort((doc, code))
                doc, code = doc[by], code[by]
                new = np.ones(len(code), bool)
                new[1:] = (code[1:] != code[:-1]) | (doc[1:] != doc[:-1])
                at = np.flatnonzero(new)
                tf, doc, code = np.diff(np.append(at, len(code))), doc[at], code[at]
                grams, starts = np.unique(code, return_index=True)
                size = np.maximum(length[some] - n + 1, 0)
                lists = [pa.array([x], pa.list_(t)) for x, t in ((keys.take(pa.array(some)).to_pylist(), key), (size, pa.int32()))]
                yield pa.RecordBatch.from_arrays(lists + [pa.array([packed(x)], pa.binary()) for x in (grams, np.append(starts, len(code)), doc, tf)] + [pa.array([len(some)], pa.int64()), pa.array([int(size.sum())], pa.int64())], names=_COLUMNS)

    return build


_COLUMNS = ["keys", "lengths", "grams", "starts", "places", "tfs", "n_documents", "n_grams"]


def gram_index(documents: DataFrame, n: int = 3, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per block: ``keys, lengths`` (number of grams) of its documents, ``grams`` (codes in order) with the ``starts`` of their postings, ``places, tfs`` (document in the block and
    times), these four ``packed``, ``n_documents, n_grams``. A null text has no grams."""
    docs = documents.select(key, text)
    kind = docs.schema[key].dataType.simpleString()
    return docs.mapInArrow(_blocks(n, to_arrow_type(docs.schema[key].dataType)), f"keys array<{kind}>, lengths array<int>, grams binary, starts binary, places binary, tfs binary, n_documents bigint, n_grams bigint")


@dataclass
class _Asked:
    """A block of queries: ids, the codes that any of them has (in order), and which query has which (by number of code), with weights once these are known."""

    ids: list
    codes: np.ndarray
    query: np.ndarray
    code: np.ndarray
    weight: np.ndarray | None = None
    rare: np.ndarray | None = None


def _asked(rows: list, n: int) -> _Asked:
    query, code = gram_codes([r[1] or "" for r in rows], n)
    pairs = np.unique(np.stack((code, query), axis=1), axis=0)
    codes, at = np.unique(pairs[:, 0], return_inverse=True)
    return _Asked([r[0] for r in rows], codes, pairs[:, 1], at)


def _frequencies(codes: np.ndarray):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(codes), np.int64)
        for batch in batches:
            for grams, starts in zip(batch.column(0), batch.column(1)):
                grams, n = unpacked(grams), np.diff(unpacked(starts))
                at = np.searchsorted(grams, codes)
                here = (at < len(grams)) & (grams[np.minimum(at, len(grams) - 1)] == codes) if len(grams) else np.zeros(len(codes), bool)
                total[here] += n[at[here]]
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["code", "df"])

    return count


def best_of(found: pd.DataFrame, k: int) -> pd.DataFrame:
    """The k best rows of each query; scores are compared to six decimals, then the smaller key is better."""
    found = found.assign(r=-found.score.round(6)).sort_values(["q", "r", "key"], kind="stable", na_position="first")
    return found[found.groupby("q").cumcount() < k].drop(columns="r")


def _scan(asked: _Asked, mean: float, k: int, floor: np.ndarray | None, out: T.StructType, counted: bool = False):
    """Scores of documents with a query's rare grams (no ``floor``), or of the blocks that can reach the ``floor`` of a query; the k best of each query in a task.
    ``counted``: instead the numbers of (query, block) pairs with a common gram and of those that were scored."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nq, held, n_held, met, scored = len(asked.ids), [], 0, 0, 0
        least = np.zeros(nq) if floor is None else floor.copy()

        def shrunk() -> pd.DataFrame:
            best = best_of(pd.concat(held, ignore_index=True), k)
            full = best.groupby("q").score.agg(["size", "min"])
            full = full[full["size"] == k]
            least[full.index] = np.maximum(least[full.index], full["min"])
            return best

        for batch in batches:
            for row in batch.to_struct_array():
                grams, size = unpacked(row["grams"]), row["lengths"].values.to_numpy()
                at = np.searchsorted(asked.codes, grams)
                mine = np.flatnonzero((at < len(asked.codes)) & (asked.codes[np.minimum(at, len(asked.codes) - 1)] == grams))
                if not len(mine):
                    continue
                starts, places, tfs = (unpacked(row[c]) for c in ("starts", "places", "tfs"))
                # contributions of this block's documents: a row for each gram that is asked for
                n = starts[mine + 1] - starts[mine]
                post = np.repeat(starts[mine] - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())
                part = np.zeros((len(mine), len(size)))
                tf, doc = tfs[post], places[post]
                part[np.repeat(np.arange(len(mine)), n), doc] = tf * (K1 + 1) / (tf + K1 * (1 - B + B * size[doc] / mean))
                column = np.full(len(asked.codes), -1)
                column[at[mine]] = np.arange(len(mine))
                own = np.flatnonzero(column[asked.code] >= 0)
                weight = np.zeros((nq, len(mine)))
                weight[asked.query[own], column[asked.code[own]]] = asked.weight[own]
                if floor is None:
                    rare = np.zeros((nq, len(mine)), np.float32)
                    own = own[asked.rare[own]]
                    rare[asked.query[own], column[asked.code[own]]] = 1
                    some = np.flatnonzero(rare.any(axis=1))
                    score = np.where(rare[some] @ (part > 0).astype(np.float32) > 0, weight[some] @ part, 0.0)
                else:
                    bound = weight @ part.max(axis=1)
                    some = np.flatnonzero((bound > 0) & (bound >= least - SLACK))
                    met, scored = met + int((bound > 0).sum()), scored + len(some)
                    score = weight[some] @ part
                q, d = np.nonzero((score > 0) & (score >= (least[some] - SLACK)[:, None]))
                if len(q) and not counted:
                    held.append(pd.DataFrame({"q": some[q], "key": row["keys"].values.take(pa.array(d)).to_pandas(), "score": score[q, d]}))
                    n_held += len(q)
                    if n_held > _HELD + k * nq:
                        held = [shrunk()]
                        n_held = len(held[0])
        if counted:
            yield pa.RecordBatch.from_arrays([pa.array([met]), pa.array([scored])], names=["met", "scored"])
        elif held:
            best = shrunk()
            kinds = [to_arrow_type(f.dataType) for f in out.fields]
            yield pa.RecordBatch.from_arrays([pa.array([asked.ids[i] for i in best.q], kinds[0]), pa.array(best.q.to_numpy(), pa.int32()), pa.Array.from_pandas(best.key, type=kinds[2]), pa.array(best.score.to_numpy())], names=out.names)

    return scan


def _prepared(queries: DataFrame, index: DataFrame, k: int, n: int, query: str, text: str, max_chars: int | None) -> Iterator[tuple[_Asked, float, np.ndarray, T.StructType]]:
    """For each block of queries: the queries with weights, the mean length, their thresholds, and the schema of what is found."""
    asked = queries.select(query, (F.col(text) if max_chars is None else F.substring(text, 1, max_chars)).alias(text))
    total = index.agg(F.sum("n_documents").alias("documents"), F.sum("n_grams").alias("grams")).head()
    size = asked.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.length(text)), F.lit(0)).alias("chars")).head()
    if not total.documents or not total.grams:
        return
    mean = total.grams / total.documents
    out = T.StructType([T.StructField(query, asked.schema[query].dataType), T.StructField("q", T.IntegerType()), T.StructField("key", index.schema["keys"].dataType.elementType), T.StructField("score", T.DoubleType())])
    blocks = max(1, -(-size.n // QUERIES), -(-size.chars // QUERY_CHARACTERS))
    for b in range(blocks):
        block = _asked((asked if blocks == 1 else asked.where(F.pmod(F.xxhash64(query, text), F.lit(blocks)) == b)).collect(), n)
        if not len(block.codes):
            continue
        df = np.zeros(len(block.codes), np.int64)
        for r in index.select("grams", "starts").mapInArrow(_frequencies(block.codes), "code long, df long").groupBy("code").agg(F.sum("df").alias("df")).collect():
            df[r.code] = r.df
        block.weight = np.log(1 + (total.documents - df + 0.5) / (df + 0.5))[block.code]
        # the rarest grams of each query that some documents have, until enough documents are met
        by = np.lexsort((df[block.code], block.query))
        by = by[df[block.code[by]] > 0]
        upto = np.cumsum(df[block.code[by]])
        first = np.searchsorted(block.query[by], block.query[by])
        before = upto - df[block.code[by]]
        block.rare = np.zeros(len(block.code), bool)
        block.rare[by[before - before[first] < SAMPLE * k]] = True
        found = index.mapInArrow(_scan(block, mean, k, None, out), out)
        order = Window.partitionBy("q").orderBy(F.desc("score"))
        floor = np.zeros(len(block.ids))
        for r in found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") == k).select("q", "score").collect():
            floor[r.q] = r.score
        yield block, mean, floor, out


def bm25(queries: DataFrame, index: DataFrame, k: int, n: int = 3, query: str = "item_id", key: str = "doc_id", text: str = "text", max_chars: int | None = None) -> DataFrame:
    """``query, key, score, rank``: the k best documents of each query that share a gram with it, exactly. ``max_chars``: only so many characters of a query count."""
    out = None
    with small_batches(queries.sparkSession):
        for block, mean, floor, kind in _prepared(queries, index, k, n, query, text, max_chars):
            found = index.mapInArrow(_scan(block, mean, k, floor, kind), kind)
            order = Window.partitionBy("q").orderBy(F.round("score", 6).desc(), "key")
            found = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(query, F.col("key").alias(key), "score", "rank")
            found = kept(found, "bm25")  # the scan runs here, while batches are small
            out = found if out is None else out.unionByName(found)
    if out is None:
        out = queries.sparkSession.createDataFrame([], T.StructType([queries.schema[query], T.StructField(key, index.schema["keys"].dataType.elementType), T.StructField("score", T.DoubleType()), T.StructField("rank", T.IntegerType())]))
    return out


def bm25_work(queries: DataFrame, index: DataFrame, k: int, n: int = 3, query: str = "item_id", text: str = "text") -> tuple[int, int]:
    """How many pairs of a query and a block have a gram in common, and how many of these ``bm25`` scores."""
    met = scored = 0
    with small_batches(queries.sparkSession):
        for block, mean, floor, kind in _prepared(queries, index, k, n, query, text, None):
            for r in index.mapInArrow(_scan(block, mean, k, floor, kind, counted=True), "met long, scored long").collect():
                met, scored = met + r.met, scored + r.scored
    return met, scored
