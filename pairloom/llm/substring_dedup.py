"""Substring dedup by relative Lempel-Ziv parsing against an index over all reference blocks.

The corpus is its own reference. Content decides where its blocks lie: every window of ``length`` words is owned by the smallest of its
``gram``-word hashes (its anchor), and the stretch of text whose windows one anchor owns is one block. Equal windows have equal anchors at equal
places, so the index from anchors to blocks, dealt out by anchor, holds all blocks in which a window of a document can occur, and no others.

A document is parsed greedily from anchor to anchor. The longest factor that a block can give, the whole stretch, is looked up first; where it also
starts elsewhere, all its windows are duplicate spans. Where the stretch differs from every other stretch of its anchor, a factor ends inside it, and
only there, at factor boundaries, single windows are looked up. Lookups compare two independent 64-bit hashes (anchor and contents).

Hot passages: every lookup is a count with partial sums and an equi-join that Spark may split; no group of a key is gathered anywhere. Adjoining
duplicate windows merge into maximal spans. Nothing is broadcast or collected.

Edge cases: null text is an empty text; texts under ``length`` words have no window and stay whole; a repeated row counts as another occurrence, so
it loses what it repeats; null doc_id is kept as such; other columns are ignored (``documents`` needs the two named columns only).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairloom.llm.store import tidy, written
from pairloom.llm.words import chunks, mix, run_hashes

LENGTH, GRAM = 35, 12


def owners(grams: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For the windows of one text, given the hashes of its grams and the number of grams in a window: each anchor's place, and the first and the
    number of the consecutive windows that it owns (the leftmost of equal minima owns)."""
    place = np.lib.stride_tricks.sliding_window_view(grams, span).argmin(axis=1) + np.arange(len(grams) - span + 1)
    first = np.flatnonzero(np.concatenate(([True], place[1:] != place[:-1])))
    return place[first], first, np.diff(np.append(first, len(place)))


def _blocks(length: int, gram: int):
    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for c in chunks(batch.column(2)):
                doc, place, first, count = [], [], [], []
                for d in np.flatnonzero(np.diff(c.bounds) >= length):
                    a, b = c.bounds[d], c.bounds[d + 1]
                    at = np.arange(a, b - gram + 1)
                    p, f, n = owners(run_hashes(c.hash[a:b], at - a, at - a + gram), length - gram + 1)
                    doc.append(np.full(len(p), d))
                    place.append(p + a)
                    first.append(f + a)
                    count.append(n)
                if not doc:
                    continue
                doc, place, first, count = map(np.concatenate, (doc, place, first, count))
                anchor = run_hashes(c.hash, place, place + gram)
                stretch = mix(run_hashes(c.hash, first, first + count - 1 + length) + np.uint64(1) * (place - first).astype(np.uint64))
                rows = pa.array(doc + c.first)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(rows), batch.column(1).take(rows), pa.array(anchor.view(np.int64)), pa.array(stretch.view(np.int64)), pa.array((first - c.bounds[doc]).astype(np.int32)), pa.array(count.astype(np.int32))],
                    names=["did", "row_key", "anchor", "stretch", "first", "n_windows"],
                )

    return tidy(parse)


def _windows(length: int):
    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bounds = batch.column(3)
            for c in chunks(batch.column(2)):
                rows, anchors, firsts = [], [], []
                for d in range(c.n):
                    for b in bounds[c.first + d].as_py():
                        rows.append(np.full(b["n_windows"], c.first + d))
                        anchors.append(np.full(b["n_windows"], b["anchor"], dtype=np.int64))
                        firsts.append(np.arange(b["first"], b["first"] + b["n_windows"]))
                if not rows:
                    continue
                rows, anchors, firsts = map(np.concatenate, (rows, anchors, firsts))
                at = c.bounds[rows - c.first] + firsts
                window, rows = run_hashes(c.hash, at, at + length), pa.array(rows)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), batch.column(1).take(rows), pa.array(anchors), pa.array(window.view(np.int64)), pa.array(firsts.astype(np.int32))], names=["did", "row_key", "anchor", "window", "first"])

    return tidy(look)


def _cut(first: int):
    """Cuts the spans (column 2) out of the texts (column 3); the columns from ``first`` on stay."""
    return tidy(lambda batches: _without_spans(batches, first))


def _without_spans(batches: Iterator[pa.RecordBatch], first: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        spans = batch.column(2)
        out: dict[str, list] = {k: [] for k in ("row", "n_words", "n_removed", "kept", "digest", "spans")}
        for c in chunks(batch.column(3)):
            for d in range(c.n):
                n = int(c.bounds[d + 1] - c.bounds[d])
                edges = np.zeros(n + 1, dtype=np.int64)
                if (s := spans[c.first + d]).is_valid and len(s):
                    flat = s.values.flatten()
                    np.add.at(edges, flat[0].to_numpy(), 1)
                    np.add.at(edges, flat[1].to_numpy(), -1)
                gone = np.cumsum(edges)[:n] > 0
                turns = np.flatnonzero(np.diff(np.concatenate(([0], gone.view(np.int8), [0]))))
                kept = c.words(d, ~gone)
                out["row"].append(c.first + d)
                out["n_words"].append(n)
                out["n_removed"].append(int(gone.sum()))
                out["kept"].append(kept.decode())
                out["digest"].append(hashlib.sha256(kept).hexdigest())
                out["spans"].append([{"first": int(a), "n_words": int(b - a)} for a, b in zip(turns[::2], turns[1::2])])
            if out["row"]:
                rows = pa.array(out.pop("row"))
                yield pa.RecordBatch.from_arrays(
                    [*[c.take(rows) for c in batch.columns[first:]], pa.array(out["n_words"], pa.int64()), pa.array(out["n_removed"], pa.int64()), pa.array(out["digest"]), pa.array(out["kept"]), pa.array(out["spans"], pa.list_(pa.struct([("first", pa.int32()), ("n_words", pa.int32())])))],
                    names=[*batch.schema.names[first:], "n_words", "n_removed", "kept_sha256", "kept_text", "spans"],
                )
            out = {k: [] for k in ("row", "n_words", "n_removed", "kept", "digest", "spans")}


def remove_repeats(documents: DataFrame, length: int = LENGTH, gram: int = GRAM, keep: tuple[str, ...] = ()) -> DataFrame:
    """``doc_id, n_words, n_removed, kept_sha256, kept_text, spans`` of each row of ``documents`` (``doc_id, text``), and its columns ``keep``."""
    if not 0 < gram < length:
        raise ValueError("gram must be positive and under length")
    others = [c for c in keep if c != "text"]  # a text that is kept goes to the workers once
    kept = [f"c{i}" for i in range(len(others))]
    docs = documents.select(F.coalesce("doc_id", F.lit(0)).cast("long").alias("did"), F.xxhash64("doc_id", "text").alias("row_key"), "text", F.col("doc_id").cast("long").alias("doc_id"), *[F.col(c).alias(k) for c, k in zip(others, kept)])
    blocks = written(docs.select("did", "row_key", "text").mapInArrow(_blocks(length, gram), "did long, row_key long, anchor long, stretch long, first int, n_windows int"), "rlz-blocks")
    # counts are written before they are joined: a join right above a sum shares its exchange, which Spark then can't split at a hot key
    index = written(blocks.groupBy("anchor").agg(F.count("*").alias("n"), (F.min("stretch") == F.max("stretch")).alias("same")).where("n > 1").select("anchor", "same"), "rlz-index")
    shared = written(blocks.join(index, "anchor"), "rlz-shared")
    other = shared.where("not same")
    longest = written(other.groupBy("anchor", "stretch").agg(F.count("*").alias("n"), F.min(F.struct("did", "row_key", "first", "n_windows")).alias("one")), "rlz-longest")
    repeated = longest.where("n > 1").select("anchor", "stretch")
    whole = shared.where("same").select("did", "row_key", "first", "n_windows").unionByName(other.join(repeated, ["anchor", "stretch"]).select("did", "row_key", "first", "n_windows"))
    # of equal stretches one goes on as a reference: a boundary window of another stretch may start inside it
    boundaries = longest.groupBy("one.did", "one.row_key").agg(F.collect_list(F.struct("anchor", "one.first", "one.n_windows")).alias("bounds"))
    text = docs.select("did", "row_key", "text")
    windows = written(text.join(boundaries, ["did", "row_key"]).select("did", "row_key", "text", "bounds").mapInArrow(_windows(length), "did long, row_key long, anchor long, window long, first int"), "rlz-windows")
    found = written(windows.groupBy("anchor", "window").agg(F.count("*").alias("n")).where("n > 1").select("anchor", "window"), "rlz-found")
    single = windows.join(found, ["anchor", "window"]).select("did", "row_key", "first", F.lit(1).alias("n_windows"))
    spans = whole.unionByName(single).select("did", "row_key", "first", (F.col("first") + F.col("n_windows") - 1 + length).alias("last"))
    spans = spans.distinct().groupBy("did", "row_key").agg(F.collect_list(F.struct("first", "last")).alias("spans"))
    cut = docs.join(spans, ["did", "row_key"], "left").select("did", "row_key", "spans", "text", "doc_id", *kept)
    first = 4 - ("text" in keep)
    types = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in cut.schema.fields[first:])
    out = cut.mapInArrow(_cut(first), f"{types}, n_words long, n_removed long, kept_sha256 string, kept_text string, spans array<struct<first: int, n_words: int>>")
    return out.select("doc_id", *[F.col("text" if c == "text" else kept[others.index(c)]).alias(c) for c in keep], "n_words", "n_removed", "kept_sha256", "kept_text", "spans")
