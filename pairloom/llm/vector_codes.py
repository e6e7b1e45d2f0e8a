"""Product codes of vectors, learnt over the distinct values of their integer parts.

A component x counts as floor(1024 * x). A vector is cut into ``PARTS`` equal parts, and equal parts of one position are one row with a weight
(``distinct_parts``). Lloyd's rounds run over these rows: each task sums the weighted parts nearest to each entry, partial sums are added up by entry, and
the codebooks (at most 256 entries of each position, whatever the table) come back to the driver between rounds. At last each distinct part gets its code
and squared error, which a join on position and part brings to all vectors that hold it.

All arithmetic is exact: distances are matrix products in doubles where every term and sum stays below 2**53, else 64-bit integers. A part travels as the
narrowest of 16, 32 or 64-bit integers that holds it, so equal parts have equal bytes.

Hot values: the sums that find distinct parts are partial first, and both sides of the join are written tables, so that Spark may split a part that a third of
the vectors hold. Nothing but the 256 first vectors and the codebooks is collected.

Edge cases: vectors that are null, or hold a null or non-finite component, give no row. A vector shorter than the longest counts as continued with zeros, and so do
all where four does not divide the longest; empty vectors are all zeros. Repeated vec_ids are rows of their own (in the first codebook in the order of their
parts), null vec_ids come last. Fewer than 256 vectors make as many entries. Integers beyond the range in which 64 bits hold a vector's error count as its
ends (about 131,000 in a component of 64); a label's error that 64 bits do not hold is null. An empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairloom.llm.store import tidy, written

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
_BLOCK = 2048


def _pack(values: np.ndarray) -> list[bytes]:
    """Rows of integers as bytes, each row in the narrowest type that holds it."""
    if not values.shape[1]:
        return [b""] * len(values)
    low, high = values.min(axis=1), values.max(axis=1)
    out: list[bytes] = [b""] * len(values)
    done = np.zeros(len(values), bool)
    for kind in (np.int16, np.int32, np.int64):
        fit = ~done & (low >= np.iinfo(kind).min) & (high <= np.iinfo(kind).max)
        raw, size = values[fit].astype(kind).tobytes(), values.shape[1] * np.dtype(kind).itemsize
        for k, i in enumerate(np.flatnonzero(fit).tolist()):
            out[i] = raw[k * size : (k + 1) * size]
        done |= fit
    return out


def _unpack(parts: list[bytes], width: int) -> np.ndarray:
    out = np.zeros((len(parts), width), np.int64)
    size = np.array([len(p) for p in parts])
    for kind in (np.int16, np.int32, np.int64):
        some = np.flatnonzero(size == width * np.dtype(kind).itemsize)
        if width and len(some):
            out[some] = np.frombuffer(b"".join([parts[i] for i in some.tolist()]), kind).reshape(-1, width)
    return out


def integer_parts(n: int, width: int):
    """Batches (vec_id, label, vector) of vectors of up to ``n`` components as ``vec_id, label, p0 .. p3``; vectors that do not count are left out."""
    limit = math.isqrt(2**62 // max(1, n)) // 2

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, _BLOCK):
                batch = whole.slice(start, _BLOCK)
                batch = batch.filter(batch.column(2).is_valid())
                vectors = batch.column(2)
                size = vectors.value_lengths().fill_null(0).to_numpy().astype(np.int64)
                flat = vectors.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)  # nulls are NaN
                at = np.concatenate(([0], np.cumsum(size)))
                bad = np.concatenate(([0], np.cumsum(~np.isfinite(flat))))
                keep = bad[at[1:]] == bad[at[:-1]]
                values = np.zeros((len(size), PARTS * width))
                values[np.repeat(np.arange(len(size)), size), np.arange(len(flat)) - np.repeat(at[:-1], size)] = flat
                values = np.floor(SCALE * np.clip(values[keep], -(2.0**62) / SCALE, 2.0**62 / SCALE)).clip(-limit, limit).astype(np.int64)
                ids = [batch.column(k).filter(pa.array(keep)) for k in (0, 1)]
                parts = [pa.array(_pack(values[:, k * width : (k + 1) * width]), pa.binary()) for k in range(PARTS)]
                yield pa.RecordBatch.from_arrays([*ids, *parts], names=["vec_id", "label", *[f"p{k}" for k in range(PARTS)]])

    return work


def nearest(parts: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each part the first of its nearest entries and the squared distance, exactly."""
    most = max([1, *(int(np.abs(x).max()) for x in (parts, entries) if x.size)])
    exact = 4 * max(1, parts.shape[1]) * most * most < 2**53
    code, error = np.empty(len(parts), np.int64), np.empty(len(parts), np.int64)
    c = entries.astype(np.float64 if exact else np.int64)
    square = (c * c).sum(axis=1)
    for k in range(0, len(parts), _BLOCK):
        x = parts[k : k + _BLOCK].astype(c.dtype)
        if exact:
            far = square - 2 * (x @ c.T)
            code[k : k + _BLOCK] = best = far.argmin(axis=1)
            error[k : k + _BLOCK] = far[np.arange(len(x)), best] + (x * x).sum(axis=1)
        else:
            far = np.stack([((x - e) ** 2).sum(axis=1) for e in c], axis=1)
            code[k : k + _BLOCK] = best = far.argmin(axis=1)
            error[k : k + _BLOCK] = far[np.arange(len(x)), best]
    return code, error


def _by_position(batch: pa.RecordBatch, books: list[np.ndarray]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Of rows (position, part, ..): position, rows, parts, codes and errors."""
    position, parts = batch.column(0).to_numpy(), batch.column(1).to_pylist()
    for p in np.unique(position).tolist():
        rows = np.flatnonzero(position == p)
        values = _unpack([parts[i] for i in rows.tolist()], books[p].shape[1])
        yield p, rows, values, *nearest(values, books[p])


def _sums(books: list[np.ndarray]):
    """Weighted sums of the parts nearest to each entry: ``position, entry, place, total`` with the weight itself at place -1."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = [np.zeros((len(b), b.shape[1] + 1), np.int64) for b in books]
        for batch in batches:
            weight = batch.column(2).to_numpy()
            for p, rows, values, code, _ in _by_position(batch, books):
                np.add.at(total[p], code, np.column_stack((weight[rows], values * weight[rows, None])))
        for p, sums in enumerate(total):
            entry = np.flatnonzero(sums[:, 0])
            columns = np.arange(sums.shape[1])
            yield pa.RecordBatch.from_arrays([
                pa.array(np.full(len(entry) * len(columns), p, np.int32)), pa.array(np.repeat(entry, len(columns)).astype(np.int32)), pa.array(np.tile(columns - 1, len(entry)).astype(np.int32)), pa.array(sums[entry].ravel()),
            ], names=["position", "entry", "place", "total"])

    return work


def _codes(books: list[np.ndarray]):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            code, error = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64)
            for _, rows, _, c, e in _by_position(batch, books):
                code[rows], error[rows] = c, e
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(code), pa.array(error)], names=["position", "part", "code", "error"])

    return work


def next_books(distinct: DataFrame, books: list[np.ndarray]) -> list[np.ndarray]:
    """The codebooks after one of Lloyd's rounds over ``position, part, weight``; an entry that no part is nearest to stays."""
    sums = distinct.select("position", "part", "weight").mapInArrow(tidy(_sums(books)), "position int, entry int, place int, total long").groupBy("position", "entry", "place").agg(F.sum("total").alias("total"))
    out, total = [b.copy() for b in books], [np.zeros((len(b), b.shape[1] + 1), np.int64) for b in books]
    for r in sums.collect():  # at most 256 entries of each position
        total[r.position][r.entry, r.place + 1] = r.total
    for p, t in enumerate(total):
        used = t[:, 0] > 0
        out[p][used] = t[used, 1:] // t[used, :1]
    return out


def compress_vectors(vectors: DataFrame, rounds: int = ROUNDS) -> tuple[DataFrame, list[np.ndarray]]:
    """``vec_id, label, code, error`` of each row of ``vectors`` (``vec_id, label, embedding``) that counts, and the codebook of each position."""
    vectors = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "label", F.col("embedding").cast("array<double>").alias("embedding"))
    longest = vectors.agg(F.max(F.size("embedding"))).head()[0] or 0
    width = -(-max(0, longest) // PARTS)
    kind = vectors.schema["label"].dataType.simpleString()
    names = [f"p{k}" for k in range(PARTS)]
    cut = vectors.mapInArrow(tidy(integer_parts(PARTS * width, width)), f"vec_id long, label {kind}, {', '.join(f'{n} binary' for n in names)}")
    cut = written(cut.withColumn("row", F.monotonically_increasing_id()), "codes-parts")
    first = cut.orderBy(F.asc_nulls_last("vec_id"), *names).limit(ENTRIES).select(*names).collect()
    books = [_unpack([bytes(r[n]) for r in first], width) for n in names]
    at = F.posexplode(F.array(*names)).alias("position", "part")
    distinct = written(cut.select(at).groupBy("position", "part").agg(F.count("*").alias("weight")), "codes-distinct")
    for _ in range(rounds if first else 0):
        books = next_books(distinct, books)
    coded = written(distinct.select("position", "part").mapInArrow(tidy(_codes(books)), "position int, part binary, code long, error long"), "codes-coded")
    # vec_id and label travel with the first part only
    own = [F.when(F.col("position") == 0, F.col(c)).alias(c) for c in ("vec_id", "label")]
    joined = cut.select("row", "vec_id", "label", at).select("row", "position", "part", *own).join(coded, ["position", "part"])
    code = F.sum(F.col("code") * F.expr(f"shiftleft(1L, 8 * ({PARTS - 1} - position))"))
    whole = joined.groupBy("row").agg(F.max("vec_id").alias("vec_id"), F.max("label").alias("label"), code.alias("code"), F.sum("error").alias("error"))
    return whole.select("vec_id", "label", F.lower(F.lpad(F.hex("code"), 2 * PARTS, "0")).alias("code"), "error"), books


def books_digest(books: list[np.ndarray]) -> str:
    """SHA-256 of the decimal components of all entries, by position and entry, with commas between."""
    return hashlib.sha256(",".join(str(x) for b in books for x in b.ravel().tolist()).encode()).hexdigest()


def code_report(vectors: DataFrame) -> DataFrame:
    """``vec_id, code, error, label_error, codebooks_sha256``; ``label_error`` is the error of all vectors of the label (nulls together)."""
    coded, books = compress_vectors(vectors)
    coded = written(coded, "codes-vectors")
    by_label = coded.groupBy(F.col("label").alias("of")).agg(F.sum(F.col("error").cast("decimal(38,0)")).alias("total"))
    by_label = written(by_label.select("of", F.expr("try_cast(total AS long)").alias("label_error")), "codes-labels")
    return coded.join(by_label, F.col("label").eqNullSafe(F.col("of"))).select("vec_id", "code", "error", "label_error", F.lit(books_digest(books)).alias("codebooks_sha256"))
