"""Audit of filter orders over a packed bitmap index.

Five filters judge each document once (``judged``): A under 50 words; B under 65 distinct words of 100; C over 5 capitals A-Z of 100 code points; D any of
``#$%&*|``; E the whole text is that of a document with a smaller doc_id. What a filter removes in an order depends only on the set of filters before
it, so 120 orders of five steps need the counts of 32 sets.

The index (``bitmap_index``) has, for each part (source) in each run of ``ROWS`` rows of a partition, one bitset per filter and label and one of the rows that are
there, 64 rows a word. For every set of filters ``surviving`` takes AND-NOT of the rows and the sets' bitsets, and the popcount of that alone and with each label,
over all parts of a batch at once; sums over partitions are partial first, so a source with most of the rows is no task of its own. Thirty-two counts of each
part make its 600 rows.

Edge cases: a null text is an empty one; a null source is the part ''; a null doc_id has no smaller one, so E passes it, and no labels; of rows that repeat a
doc_id and its text, each counts, and E removes none of them for the others; a label counts if any row of ``labels`` for the doc_id has 1 (null is none); very
long texts are read whole; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import permutations
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairloom.llm.store import tidy, written
from pairloom.llm.words import chunks

FILTERS, LABELS = "ABCDE", ("good", "toxic")
LEAST_WORDS, DISTINCT_PERCENT, CAPITAL_PERCENT = 50, 65, 5
ROWS = 1 << 16
_SETS = 1 << len(FILTERS)
_MARKED = np.zeros(256, bool)
_MARKED[[ord(c) for c in "#$%&*|"]] = True


def _judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``doc_id, part, fails`` (filters A to D as bits 0 to 3) and ``digest`` of texts ``doc_id, part, text``."""
    for batch in batches:
        for c in chunks(batch.column(2)):
            n_words = np.diff(c.bounds)
            doc = np.repeat(np.arange(c.n), n_words)
            order = np.lexsort((c.hash, doc))
            new = np.ones(len(doc), bool)
            new[1:] = (doc[order][1:] != doc[order][:-1]) | (c.hash[order][1:] != c.hash[order][:-1])
            distinct = np.bincount(doc[order][new], minlength=c.n)
            count = lambda of: np.diff(np.concatenate(([0], np.cumsum(of, dtype=np.int64)))[c.offsets])
            capitals, points, marks = count((c.data >= 65) & (c.data <= 90)), count((c.data & 0xC0) != 0x80), count(_MARKED[c.data])
            fails = (n_words < LEAST_WORDS) | (100 * distinct < DISTINCT_PERCENT * n_words) << 1 | (100 * capitals > CAPITAL_PERCENT * points) << 2 | (marks > 0) << 3
            raw, at = c.data.tobytes(), c.offsets.tolist()
            digest = [hashlib.sha256(raw[a:b]).digest() for a, b in zip(at[:-1], at[1:])]
            part = [batch.column(k).slice(c.first, c.n) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([*part, pa.array(fails.astype(np.int32)), pa.array(digest, pa.binary())], names=["doc_id", "part", "fails", "digest"])


def judged(documents: DataFrame) -> DataFrame:
    """``doc_id, part, fails`` of each row of ``documents`` (``doc_id, text, source``): bit k of ``fails`` is filter k of ``FILTERS``."""
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("source", F.lit("")).alias("part"), "text")
    rows = written(docs.mapInArrow(tidy(_judged), "doc_id long, part string, fails int, digest binary"), "audit-judged")
    # only texts that several rows have; written, so that Spark can split the rows of a text that many have
    first = written(rows.groupBy("digest").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n"), "audit-first")
    again = F.coalesce(F.col("doc_id") > F.col("first"), F.lit(False)).cast("int")
    return rows.join(first, "digest", "left").select("doc_id", "part", F.col("fails").bitwiseOR(F.shiftleft(again, 4)).alias("fails"))


def labelled(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """Adds ``good`` (quality 1) and ``toxic`` (toxic 1) to rows with ``doc_id``; false where nothing is known."""
    one = lambda c: F.coalesce(F.max(F.col(c) == 1), F.lit(False))
    known = labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(one("quality").alias("good"), one("toxic").alias("toxic"))
    named = rows.where("doc_id IS NOT NULL").join(written(known, "audit-labels"), "doc_id", "left").select("part", "fails", *LABELS)
    return named.unionByName(rows.where("doc_id IS NULL").select("part", "fails"), allowMissingColumns=True).na.fill(False, list(LABELS))


def _packed(table: pa.Table) -> pa.RecordBatch:
    """One row per part: its rows packed, each part from a new word on."""
    part = table.column(0).combine_chunks().dictionary_encode()
    part = part.combine_chunks() if isinstance(part, pa.ChunkedArray) else part
    code = part.indices.to_numpy()
    n = np.bincount(code, minlength=len(part.dictionary))
    words = -(-n // 64)
    word_at = np.concatenate(([0], np.cumsum(words)))
    order = np.argsort(code, kind="stable")
    place = np.arange(len(code)) + np.repeat(64 * word_at[:-1] - np.concatenate(([0], np.cumsum(n)[:-1])), n)
    fails = table.column(1).to_numpy()[order]

    def bitset(on: np.ndarray) -> pa.Array:
        bits = np.zeros(64 * word_at[-1], np.uint8)
        bits[place] = on
        raw = np.packbits(bits, bitorder="little").tobytes()
        return pa.array([raw[8 * a : 8 * b] for a, b in zip(word_at[:-1].tolist(), word_at[1:].tolist())], pa.binary())

    sets = [bitset(np.ones(len(code), bool)), *[bitset(fails >> k & 1) for k in range(len(FILTERS))], *[bitset(table.column(2 + k).combine_chunks().to_numpy(zero_copy_only=False)[order]) for k in range(len(LABELS))]]
    return pa.RecordBatch.from_arrays([part.dictionary, *sets], names=["part", "present", *FILTERS, *LABELS])


def _index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= ROWS:
            yield _packed(pa.Table.from_batches(held))
            held, n = [], 0
    if n:
        yield _packed(pa.Table.from_batches(held))


def bitmap_index(rows: DataFrame) -> DataFrame:
    """``part, present, A .. E, good, toxic``: bitsets (little-endian words of 64 rows) of the rows ``part, fails, good, toxic`` of each run of a partition."""
    columns = ", ".join(f"{c} binary" for c in ("present", *FILTERS, *LABELS))
    return rows.select("part", "fails", *LABELS).mapInArrow(tidy(_index), f"part string, {columns}")


def _surviving(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if not batch.num_rows:
            continue
        size = np.array([len(x) // 8 for x in batch.column(1).to_pylist()])
        at = np.cumsum(size) - size
        present, *bits = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint64) for k in range(1, batch.num_columns))
        filters, labels = bits[: len(FILTERS)], bits[len(FILTERS) :]
        total = lambda x: np.add.reduceat(np.bitwise_count(x).astype(np.int64), at)
        left: list[np.ndarray] = [present]
        for s in range(1, _SETS):
            last = s.bit_length() - 1
            left.append(left[s ^ (1 << last)] & ~filters[last])
        counts = [[total(x) for x in left], *[[total(x & b) for x in left] for b in labels]]
        n = batch.num_rows
        flat = [pa.array(np.concatenate(c)) for c in counts]
        rows = pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(np.tile(np.arange(n), _SETS))), pa.array(np.repeat(np.arange(_SETS, dtype=np.int32), n)), *flat], names=["part", "passed", "kept", *LABELS])
        yield rows.filter(pa.array(flat[0].to_numpy() > 0))


def surviving(index: DataFrame) -> DataFrame:
    """``part, passed, kept, good, toxic``: the rows of each part that no filter of the set ``passed`` (bits) fails; sets that leave none are left out, but for the empty set none is."""
    counts = index.mapInArrow(tidy(_surviving), f"part string, passed int, kept long, {', '.join(f'{c} long' for c in LABELS)}")
    return counts.groupBy("part", "passed").agg(*[F.sum(c).alias(c) for c in ("kept", *LABELS)])


def order_audit(counts: DataFrame) -> DataFrame:
    """The 600 rows ``filter_order, step`` of each part from its counts ``surviving``."""
    held = counts.groupBy("part").agg(F.map_from_entries(F.collect_list(F.struct("passed", F.struct("kept", *LABELS)))).alias("left"))
    left = lambda s, c="kept": F.coalesce(F.try_element_at("left", F.lit(s) if isinstance(s, int) else s)[c], F.lit(0))
    # each set of the other filters stands before a filter in as many orders as the orders of the set times those of the rest
    weight = [factorial(s.bit_count()) * factorial(len(FILTERS) - 1 - s.bit_count()) for s in range(_SETS - 1)]
    shapley = [sum((weight[s] * (left(s) - left(s | 1 << k)) for s in range(_SETS - 1) if not s >> k & 1), F.lit(0)) for k in range(len(FILTERS))]
    held = held.withColumn("shapley", F.array(*[x.cast("long") for x in shapley]))
    steps = held.withColumn("filter_order", F.explode(F.lit(["".join(p) for p in permutations(FILTERS)]))).withColumn("step", F.explode(F.expr(f"sequence(1, {len(FILTERS)})")))
    place = F.instr(F.lit(FILTERS), F.expr("substring(filter_order, step, 1)"))
    before = sum((F.when(F.instr("filter_order", c) < F.col("step"), 1 << k).otherwise(0) for k, c in enumerate(FILTERS)), F.lit(0))
    steps = steps.withColumn("before", before).withColumn("own", F.expr(f"shiftleft(1, instr('{FILTERS}', substring(filter_order, step, 1)) - 1)")).withColumn("after", F.col("before") + F.col("own"))
    removed, others = left(F.col("before")) - left(F.col("after")), _SETS - 1 - F.col("own")
    out = {
        "kept": left(F.col("after")), "removed": removed, "redundant": left(0) - left(F.col("own")) - removed, "unique_fails": left(others) - left(_SETS - 1),
        **{f"{c}_lost": left(F.col("before"), c) - left(F.col("after"), c) for c in LABELS}, "shapley": F.element_at("shapley", place),
    }
    return steps.select("part", "filter_order", "step", *[v.cast("long").alias(k) for k, v in out.items()])


def audit_filters(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """``part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley`` over ``documents`` (``doc_id, text, source``)."""
    return order_audit(surviving(bitmap_index(labelled(judged(documents), labels))))
