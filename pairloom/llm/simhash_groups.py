"""Near duplicates by SimHash fingerprints, found with the pigeonring filter.

A text's fingerprint has bit k where over half of the XXH64 hashes (seed 42) of its four-word shingles, repeats included, have it. Texts link whose fingerprints
differ in at most ``RADIUS`` bits; equal fingerprints are one node.

The 64 bits form a ring of ``len(WIDTHS)`` = 5 segments. If two fingerprints differ in at most 4 bits, then from some segment on round the ring, every chain of the next
l segments differs in at most floor(4 * l / 5) bits: 0 in the first, 1 in the first two, 2, 3, and 4 in all. So each node is sent to five buckets, by the
value of each segment (a chain of one). Within a bucket the nodes are turned so that the chain starts at the top: chains of two are found by looking up the
next segment as it is and with each one bit turned (in buckets of a few dozen nodes, by counting the differences of all pairs), longer chains are counted one by one, and only what no
chain rules out has all its bits compared.
A node pair that is linked through others already is not compared (members of one component stand together and are stepped over), as only the
components are asked for. A bucket emits at most one link fewer than it has nodes.

Large buckets: the sizes of the 40,960 buckets are counted first. Members of one with over ``limit`` nodes are dealt anew by chains of two (the next segment as it is,
and with one bit turned), 2**26 buckets for each start. A bucket of those that is still too large is a heap of very near copies: its nodes
that differ in one bit are linked by keys that leave one bit out, with sums and no comparison; then it is cut into shards, by component, and only
pairs of shards that hold different components are joined. No bucket is dropped, capped or sampled.

Edge cases: null and empty texts and texts without words have fingerprint zero and link like any other; fewer than four words are one shingle; very long texts
are hashed whole; repeated rows come back once each; rows without doc_id link as well (component_id is the smallest doc_id reachable, null if there is
none); an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairloom.llm.components import components
from pairloom.llm.ngram_join import Forest, sorted_groups
from pairloom.llm.store import tidy, written
from pairloom.llm.words import Chunk, chunks

WORDS, SEED, RADIUS = 4, 42, 4
WIDTHS = (13, 13, 13, 13, 12)
BUCKET = 1 << 17
_STARTS = tuple(sum(WIDTHS[:k]) for k in range(len(WIDTHS)))
_PAIRS, _LONG, _SHINGLES, _FEW = 1 << 20, 256, 1 << 15, 96
_P = [np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5)]  # fixed: primes of XXH64


def turned(x: np.ndarray, k: int) -> np.ndarray:
    return x << np.uint64(k) | x >> np.uint64(64 - k) if k else x


def xxh64(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = SEED) -> np.ndarray:
    """XXH64 of data[start:end] (bytes) for each pair of bounds; long strings one by one, all others together."""
    out = np.empty(len(starts), np.uint64)
    size = ends - starts
    for i in np.flatnonzero(size > _LONG).tolist():
        out[i] = xxhash.xxh64_intdigest(data[starts[i] : ends[i]].tobytes(), seed)
    some = np.flatnonzero(size <= _LONG)
    if not len(some):
        return out
    padded = np.concatenate((data, np.zeros(8, np.uint8)))
    eight = np.lib.stride_tricks.as_strided(padded[:8].view("<u8"), (len(data) + 1,), (1,))
    four = np.lib.stride_tricks.as_strided(padded[:4].view("<u4"), (len(data) + 1,), (1,))
    at, size = starts[some].copy(), size[some]
    p1, p2, p3, p4, p5 = _P
    mixed = lambda lane: turned(lane * p2, 31) * p1
    h = np.full(len(some), np.uint64(seed) + p5, np.uint64)
    if len(wide := np.flatnonzero(size >= 32)):
        start = np.array([seed, seed, seed, seed], np.uint64) + np.array([p1, p2, 0, 0], np.uint64) + np.array([p2, 0, 0, 0], np.uint64) - np.array([0, 0, 0, p1], np.uint64)
        acc = np.repeat(start[:, None], len(wide), axis=1)
        on = np.arange(len(wide))
        while len(on):
            for k in range(4):
                acc[k, on] = turned(acc[k, on] + eight[at[wide[on]] + 8 * k] * p2, 31) * p1
            at[wide[on]] += 32
            on = on[at[wide[on]] + 32 <= ends[some][wide[on]]]
        joined = turned(acc[0], 1) + turned(acc[1], 7) + turned(acc[2], 12) + turned(acc[3], 18)
        for k in range(4):
            joined = (joined ^ mixed(acc[k])) * p1 + p4
        h[wide] = joined
    h += size.astype(np.uint64)
    end = ends[some]
    while len(on := np.flatnonzero(end - at >= 8)):
        h[on] = turned(h[on] ^ mixed(eight[at[on]]), 27) * p1 + p4
        at[on] += 8
    if len(on := np.flatnonzero(end - at >= 4)):
        h[on] = turned(h[on] ^ four[at[on]].astype(np.uint64) * p1, 23) * p2 + p3
        at[on] += 4
    while len(on := np.flatnonzero(end > at)):
        h[on] = turned(h[on] ^ data[at[on]].astype(np.uint64) * p5, 11) * p1
        at[on] += 1
    h = (h ^ h >> np.uint64(33)) * p2
    h = (h ^ h >> np.uint64(29)) * p3
    out[some] = h ^ h >> np.uint64(32)
    return out


def shingle_hashes(c: Chunk, n: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all shingles (repeats included) of the texts of a chunk, and the bounds of each text's part."""
    size = c.ends - c.starts
    first = np.concatenate(([0], np.cumsum(size + 1)))
    # the words with one space after each
    joined = np.arange(first[-1]) + np.repeat(c.starts - first[:-1], size + 1)
    joined = c.data[np.minimum(joined, max(0, len(c.data) - 1))]
    joined[first[1:] - 1] = 0x20
    n_words = np.diff(c.bounds)
    n_grams = np.where(n_words >= n, n_words - n + 1, np.minimum(n_words, 1))
    bounds = np.concatenate(([0], np.cumsum(n_grams)))
    at = np.arange(bounds[-1]) + np.repeat(c.bounds[:-1] - bounds[:-1], n_grams)
    last = np.minimum(at + n, np.repeat(c.bounds[1:], n_grams)) - 1
    return xxh64(joined, first[at], first[last + 1] - 1), bounds


def majority(hashes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """For each text the bits that over half of its hashes have."""
    counts = np.zeros((len(bounds) - 1, 64), np.int64)
    for k in range(0, len(hashes), _SHINGLES):
        part = hashes[k : k + _SHINGLES]
        bits = np.unpackbits(part.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        first, last = np.searchsorted(bounds, k, side="right") - 1, np.searchsorted(bounds, k + len(part), side="left")
        edges = np.maximum(bounds[first:last] - k, 0)
        full = np.flatnonzero(np.diff(np.append(edges, len(part))) > 0)
        counts[first + full] += np.add.reduceat(bits, edges[full], axis=0, dtype=np.int64)
    over = 2 * counts > np.diff(bounds)[:, None]
    return np.packbits(over, axis=1, bitorder="little").view("<u8").ravel()


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for c in chunks(batch.column(1), lower=True):
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(c.first, c.n), pa.array(majority(*shingle_hashes(c)).view(np.int64))], names=["doc_id", "fp"])


def chain_masks(start: int) -> list[tuple[np.uint64, int]]:
    """For chains of 1, 2 .. segments from ``start`` on, of a fingerprint turned so that they are its top bits: the mask and the greatest difference."""
    widths = [WIDTHS[(start + k) % len(WIDTHS)] for k in range(len(WIDTHS))]
    return [(np.uint64((1 << 64) - (1 << 64 - sum(widths[:n]))), RADIUS * n // len(WIDTHS)) for n in range(1, len(widths) + 1)]


def _ranges(first: np.ndarray, end: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers and places of the ranges of all rows, about ``_PAIRS`` at a time."""
    n = np.maximum(end - first, 0)
    upto = np.concatenate(([0], np.cumsum(n)))
    for k in range(0, int(upto[-1]), _PAIRS):
        place = np.arange(k, min(k + _PAIRS, int(upto[-1])))
        row = np.searchsorted(upto, place, side="right") - 1
        yield row, first[row] + place - upto[row]


def bucket_links(fps: np.ndarray, start: int, labels: np.ndarray, sides: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Links (as places in ``fps``) that join all components which the chains from segment ``start`` on join: fingerprints that share that segment and have
    ``labels`` so far. ``sides`` (0, 1): only pairs of both sides count."""
    masks = chain_masks(start)
    ring = turned(fps, _STARTS[start])
    forest = Forest(labels)
    a: list[np.ndarray] = []
    b: list[np.ndarray] = []

    def check(i: np.ndarray, j: np.ndarray) -> None:
        apart = forest.label[i] != forest.label[j]
        if sides is not None:
            apart &= sides[i] != sides[j]
        i, j = i[apart], j[apart]
        for mask, budget in masks[1:]:
            near = np.bitwise_count((ring[i] ^ ring[j]) & mask) <= budget
            i, j = i[near], j[near]
        one = forest.joins(i, j)
        a.append(i[one])
        b.append(j[one])

    if len(fps) <= _FEW:  # every pair at once costs less than a look-up of each turned bit
        check(*np.triu_indices(len(fps), 1))
        return np.concatenate(a), np.concatenate(b)
    order = np.argsort(ring)
    check(order[:-1], order[1:])
    width = WIDTHS[(start + 1) % len(WIDTHS)]
    shift = np.uint64(64 - WIDTHS[start] - width)
    follows = (ring >> shift & np.uint64((1 << width) - 1)).astype(np.int64)
    for flip in [0, *(1 << k for k in range(width))]:
        if (forest.label == forest.label[0]).all():
            break
        label = forest.label
        # components stand together within the nodes of one next segment, so that a node steps over its own
        order = np.lexsort((label, follows))
        key = follows[order] * len(fps) + label[order]
        target = (follows ^ flip) * len(fps)
        # each two components meet from the smaller label
        for row, place in _ranges(np.searchsorted(key, target + label, side="right"), np.searchsorted(key, target + len(fps), side="left")):
            check(row, order[place])
    return np.concatenate(a), np.concatenate(b)


def _linked(keys: int):
    """Links of each group (``keys`` columns of the bucket, the segment first; then fp, component, side); between the two sides only, where there are two."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in sorted_groups(batches, keys):
            if group.num_rows < 2:
                continue
            fps, labels, side = (group.column(keys + k).to_numpy() for k in range(3))
            a, b = bucket_links(fps.view(np.uint64), group.column(0)[0].as_py(), labels, side if (side != side[0]).any() else None)
            yield pa.RecordBatch.from_arrays([pa.array(fps[a]), pa.array(fps[b])], names=["a", "b"])

    return work


def _segment(fp: Column, k: int) -> Column:
    width = WIDTHS[k]
    return F.shiftrightunsigned(fp, 64 - _STARTS[k] - width).bitwiseAND((1 << width) - 1)


def _grouped(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.repartition(*keys).sortWithinPartitions(*keys)


def _left_out(fp: Column, k: int) -> Column:
    return fp.bitwiseAND(F.lit(~(1 << k) if k < 63 else (1 << 63) - 1))


def _heaps(members: DataFrame, limit: int) -> DataFrame:
    """Links ``a, b`` within large groups ``segment, value, next`` of ``fp``."""
    fps = written(members.select("fp").distinct(), "simhash-heaped")
    keys = written(fps.select("fp", F.explode(F.array(*[F.struct(F.lit(k).alias("bit"), _left_out(F.col("fp"), k).alias("rest")) for k in range(64)])).alias("key")).select("fp", "key.*"), "simhash-keys")
    near = written(keys.groupBy("bit", "rest").agg(F.min("fp").alias("a"), F.max("fp").alias("b")).where("a <> b").select("a", "b"), "simhash-one-bit")
    label = components(near, "simhash-heaps")
    keyed = ["segment", "value", "next"]
    rows = written(members.join(label, F.col("fp") == F.col("id"), "left").select(*keyed, "fp", F.coalesce("component", "fp").alias("component")), "simhash-members")
    sizes = rows.groupBy(*keyed, "component").agg(F.count("*").alias("n"))
    rest = sizes.where(F.col("n") <= limit).groupBy(*keyed).agg(F.sum("n").alias("rest"))
    # a component of its own shards where it is large, the others together by component
    named = sizes.join(rest, keyed, "left").select(*keyed, "component", (F.col("n") > limit).alias("pure"), F.ceil(F.when(F.col("n") > limit, F.col("n")).otherwise(F.col("rest")) / limit).alias("shards"))
    number = F.pmod(F.xxhash64(F.when(F.col("pure"), F.col("fp")).otherwise(F.col("component"))), F.col("shards"))
    shard = F.struct("pure", F.when(F.col("pure"), F.col("component")).otherwise(F.lit(0)).alias("of"), number.alias("number")).alias("shard")
    dealt = written(rows.join(written(named, "simhash-named"), [*keyed, "component"]).select(*keyed, "fp", "component", shard), "simhash-shards")
    shards = written(dealt.select(*keyed, "shard").distinct(), "simhash-shard-list")
    one, two = (shards.select(*keyed, F.col("shard").alias(x)) for x in ("low", "high"))
    apart = ~(F.col("low.pure") & F.col("high.pure") & (F.col("low.of") == F.col("high.of")))
    pairs = written(one.join(two, keyed).where((F.col("low") <= F.col("high")) & apart).withColumn("pair", F.xxhash64("low", "high")), "simhash-shard-pairs")
    sent = pairs.select(*keyed, "pair", F.posexplode(F.array_distinct(F.array("low", "high"))).alias("side", "shard")).join(dealt, [*keyed, "shard"])
    links = _grouped(sent.select(*keyed, "pair", "fp", "component", "side"), *keyed, "pair").mapInArrow(tidy(_linked(4)), "a long, b long")
    return near.unionByName(links)


def fingerprint_links(nodes: DataFrame, limit: int = BUCKET) -> DataFrame:
    """Links ``a, b`` between distinct fingerprints ``fp`` that give all components of those within ``RADIUS`` bits."""
    at = [F.struct(F.lit(k).alias("segment"), _segment(F.col("fp"), k).alias("value"), _segment(F.col("fp"), (k + 1) % len(WIDTHS)).alias("next")) for k in range(len(WIDTHS))]
    dealt = nodes.select("fp", F.explode(F.array(*at)).alias("at")).select("at.*", "fp")
    large = written(dealt.groupBy("segment", "value").agg(F.count("*").alias("n")).where(F.col("n") > limit).select("segment", "value"), "simhash-large")
    alone = [F.col("fp").alias("component"), F.lit(0).alias("side")]
    few = dealt.join(F.broadcast(large), ["segment", "value"], "left_anti")  # at most 40,960 rows
    out = _grouped(few.select("segment", "value", "fp", *alone), "segment", "value").mapInArrow(tidy(_linked(2)), "a long, b long")
    if not large.head(1):
        return out
    many = dealt.join(F.broadcast(large), ["segment", "value"], "left_semi")
    width = F.element_at(F.array(*[F.lit(WIDTHS[(k + 1) % len(WIDTHS)]) for k in range(len(WIDTHS))]), F.col("segment") + 1)
    flips = F.concat(F.array(F.lit(0).cast("long")), F.transform(F.sequence(F.lit(0), width - 1), lambda k: F.call_function("shiftleft", F.lit(1).cast("long"), k)))
    chained = many.select("segment", "value", "next", "fp", F.explode(flips).alias("flip")).select("segment", "value", F.col("next").bitwiseXOR(F.col("flip")).alias("next"), "fp", (F.col("flip") != 0).cast("int").alias("side"))
    chained = written(chained, "simhash-chained")
    # only a node that is there as it is gives a bucket something to find
    keyed = ["segment", "value", "next"]
    sizes = written(chained.groupBy(*keyed).agg(F.count("*").alias("n"), F.min("side").alias("least")).where("n > 1 AND least = 0").select(*keyed, (F.col("n") > limit).alias("large")), "simhash-sizes")
    met = chained.join(sizes, keyed)
    pairs = _grouped(met.where("NOT large").select(*keyed, "fp", *alone), *keyed).mapInArrow(tidy(_linked(3)), "a long, b long")
    return out.unionByName(pairs).unionByName(_heaps(written(met.where("large").select(*keyed, "fp"), "simhash-heap"), limit))


def simhash_groups(documents: DataFrame, limit: int = BUCKET) -> DataFrame:
    """``doc_id, fingerprint, component_id`` of each row of ``documents`` (``doc_id, text``)."""
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = written(docs.mapInArrow(tidy(_fingerprints), "doc_id long, fp long"), "simhash-rows")
    nodes = written(rows.groupBy("fp").agg(F.min("doc_id").alias("doc_id")), "simhash-nodes")
    label = components(written(fingerprint_links(nodes.select("fp"), limit), "simhash-links"), "simhash-component")
    by_node = written(nodes.join(label, F.col("fp") == F.col("id"), "left").select("fp", "doc_id", F.coalesce("component", "fp").alias("component")), "simhash-labels")
    # written before they are joined, so that Spark can split a large component or the rows of one fingerprint
    smallest = written(by_node.groupBy("component").agg(F.min("doc_id").alias("component_id")), "simhash-smallest")
    named = written(by_node.join(smallest, "component").select("fp", "component_id"), "simhash-named")
    return rows.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
