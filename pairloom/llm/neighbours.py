"""Approximate nearest neighbours: NN-descent builds a neighbour graph by iterative Spark joins, and queries walk it greedily.

Vectors. Null, zero and empty vectors, and those with null or non-finite components, take no part, nor do vectors of another length than most have.
Equal vectors are one node, named by its smallest vec_id; the ``k + 1`` smallest ids of a node are kept, which is all that any query can return of
them, so a vector that a third of the rows share costs no more than another. Graph and search compare the vectors themselves (as 32-bit floats where that
loses nothing, else 64-bit, and in double precision), so that near copies are told apart however close they lie; the whole beam is measured again at the end.

Graph. Start: ``trees`` random hyperplane hashes deal the nodes to leaves of about ``leaf`` nodes; within a leaf each node gets its nearest ``degree``
others. Thresholds are medians of a sample of at most ``SAMPLE`` nodes, of their own for each cell of the first ``CELLS`` levels, so that a dense cluster
is divided like the rest; a leaf over twice its size is dealt out further, so that memory per task is bounded. Descent: each round joins every node (as a
hub) with its neighbours and with its ``degree`` nearest reverse neighbours, compares all of them with each other, and keeps what is nearer than a node's
farthest neighbour. The hubs of a leaf are one task, which gets each vector once.

Search. Every query starts at its own node. A round joins the ``width`` nearest nodes not yet expanded with their neighbours, both ways, and keeps the
``beam`` nearest seen; it ends when nothing is left to expand, or after ``rounds``. The queries' vectors go to parts of about ``PART`` nodes and are compared there.

All tables of a round are written to the shared folder; nothing but the sample and the hyperplanes reaches the driver. Recall on the synthetic
embeddings is in the README, against brute force. Further columns are ignored; repeated rows (vec_id and vector) count as candidates once; rows
without vec_id take no part; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pairloom.llm.store import written

TREES, LEAF, DEGREE, DESCENTS, SAMPLE = 8, 2048, 32, 2, 20_000
WIDTH, BEAM, ROUNDS, CELLS, PART = 96, 256, 5, 9, 512
_LISTS = pa.schema([("node", pa.int64()), ("ids", pa.list_(pa.int64())), ("gaps", pa.list_(pa.float32()))])
LISTS = "node long, ids array<long>, gaps array<float>"


def encode(vectors: np.ndarray) -> tuple[list[bytes], np.ndarray]:
    """The rows' components as 32-bit floats where these are exact, else as 64-bit floats, and the scale of each row: 4-byte units per component."""
    with np.errstate(over="ignore"):
        short = vectors.astype(np.float32)
    exact = (short == vectors).all(axis=1)
    return [(x if e else v).tobytes() for e, x, v in zip(exact, short, vectors)], np.where(exact, 1.0, 2.0)


def decode(codes, scale) -> np.ndarray:
    scale = np.asarray(scale)
    if not len(scale) or (scale == scale[0]).all():
        return np.frombuffer(b"".join(codes), np.float32 if not len(scale) or scale[0] == 1 else np.float64).reshape(len(codes), -1).astype(np.float64)
    return np.stack([np.frombuffer(c, np.float32 if s == 1 else np.float64).astype(np.float64) for c, s in zip(codes, scale)])


def squared_gaps(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Squared distances, measured from the first of ``x``, so that little is lost between near ones."""
    x, y = x - x[:1], y - x[:1]
    return np.maximum((x**2).sum(1)[:, None] + (y**2).sum(1)[None] - 2 * (x @ y.T), 0)


def nearest(rows: np.ndarray, ids: np.ndarray, gaps: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k nearest distinct ids of each row, by row and gap (ties to the smaller id)."""
    order = np.lexsort((gaps, ids, rows))
    rows, ids, gaps = rows[order], ids[order], gaps[order]
    if len(rows):
        keep = np.concatenate(([True], (rows[1:] != rows[:-1]) | (ids[1:] != ids[:-1])))
        rows, ids, gaps = rows[keep], ids[keep], gaps[keep]
    order = np.lexsort((ids, gaps, rows))
    rows, ids, gaps = rows[order], ids[order], gaps[order]
    keep = np.arange(len(rows)) - np.searchsorted(rows, rows) < k
    return rows[keep], ids[keep], gaps[keep]


def lists_batch(rows: np.ndarray, ids: np.ndarray, gaps: np.ndarray) -> pa.RecordBatch:
    """One list per distinct row; rows are sorted."""
    first = np.flatnonzero(np.concatenate((np.ones(min(1, len(rows)), bool), rows[1:] != rows[:-1])))
    bounds = pa.array(np.append(first, len(rows)).astype(np.int32))
    return pa.RecordBatch.from_arrays([pa.array(rows[first]), pa.ListArray.from_arrays(bounds, pa.array(ids.astype(np.int64))), pa.ListArray.from_arrays(bounds, pa.array(gaps.astype(np.float32)))], schema=_LISTS)


def _flat(batch: pa.RecordBatch, at: int) -> tuple[np.ndarray, np.ndarray]:
    """Values of a list column and the length of each list."""
    column = batch.column(at)
    return column.flatten().to_numpy(zero_copy_only=False), column.value_lengths().fill_null(0).to_numpy()


def whole_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Batches sorted by their first column, cut so that no group lies across two."""
    held: pa.Table | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        held = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
        key = held.column(0).to_numpy()
        last = int(np.searchsorted(key, key[-1]))
        if last:
            yield held.slice(0, last).combine_chunks()
            held = held.slice(last)
    if held is not None and held.num_rows:
        yield held.combine_chunks()


def _merge(k: int):
    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.float32))
        for batch in batches:
            ids, n = _flat(batch, 1)
            gaps, _ = _flat(batch, 2)
            rows = np.repeat(batch.column(0).to_numpy(), n)
            rows, ids, gaps = nearest(np.concatenate((kept[0], rows)), np.concatenate((kept[1], ids)), np.concatenate((kept[2], gaps)), k)
            done = rows < rows[-1] if len(rows) else np.zeros(0, bool)
            if done.any():
                yield lists_batch(rows[done], ids[done], gaps[done])
            kept = (rows[~done], ids[~done], gaps[~done])
        if len(kept[0]):
            yield lists_batch(*kept)

    return merge


def merged(lists: DataFrame, k: int) -> DataFrame:
    """The k nearest of all lists of each node; memory holds one batch and k, whatever the number of lists."""
    return lists.repartition("node").sortWithinPartitions("node").mapInArrow(_merge(k), LISTS)


def _codes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        values, n = _flat(batch, 1)
        if len(n):
            codes, scale = encode(values.reshape(len(n), -1).astype(np.float64))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(codes, pa.binary()), pa.array(scale)], names=["node", "code", "scale"])


def _cuts(x: np.ndarray, planes: np.ndarray) -> np.ndarray:
    """For each tree, level and cell the median of the sample's projections; a cell without sample has that of all."""
    trees, depth, _ = planes.shape
    cuts = np.zeros((trees, depth, 1 << min(depth, CELLS)))
    for t in range(trees):
        at = np.zeros(len(x), np.int64)
        for d in range(depth):
            side, cell = x @ planes[t, d], at >> max(0, d - CELLS)
            cuts[t, d] = np.median(side)
            order = np.argsort(cell, kind="stable")
            for part in np.split(order, np.flatnonzero(np.diff(cell[order])) + 1):
                cuts[t, d, cell[part[0]]] = np.median(side[part])
            at = 2 * at + (side > cuts[t, d, cell])
    return cuts


def _leaves(planes: np.ndarray, cuts: np.ndarray):
    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees, depth, _ = planes.shape
        for batch in batches:
            if not batch.num_rows:
                continue
            x = decode(batch.column(1).to_pylist(), batch.column(2).to_numpy())
            for t in range(trees):
                leaf = np.zeros(len(x), np.int64)
                for d in range(depth):
                    leaf = 2 * leaf + (x @ planes[t, d] > cuts[t, d, leaf >> max(0, d - CELLS)])
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), t, np.int32)), pa.array(leaf), *batch.columns], names=["tree", "leaf", "node", "code", "scale"])

    return deal


def _leaf_neighbours(degree: int):
    def inside(leaf: pd.DataFrame) -> pd.DataFrame:
        ids, x = leaf["node"].to_numpy(), decode(leaf["code"].tolist(), leaf["scale"].to_numpy())
        k, out = min(degree, len(ids) - 1), {"node": [], "ids": [], "gaps": []}
        if k > 0:
            for first in range(0, len(ids), 512):
                gap = squared_gaps(x[first : first + 512], x)
                gap[np.arange(len(gap)), np.arange(first, first + len(gap))] = np.inf
                best = np.argpartition(gap, k - 1, axis=1)[:, :k]
                out["node"] += ids[first : first + 512].tolist()
                out["ids"] += list(ids[best])
                out["gaps"] += list(np.take_along_axis(gap, best, 1).astype(np.float32))
        return pd.DataFrame(out)

    return inside


def _compare(degree: int):
    """For each hub of a part, the neighbours that its members could give each other; the part's vectors come once each."""

    def compare(vectors: pa.Table, hubs: pa.Table) -> pa.Table:
        known, order = _by_id(vectors.column("other"))
        x, worst = decode(vectors.column("code").to_pylist(), vectors.column("scale").to_numpy())[order], vectors.column("worst").to_numpy()[order]
        kept, rows, found, gaps = [], [], [], []
        for k, members in enumerate(hubs.column("ids"), 1):
            at = np.searchsorted(known, members.values.to_numpy())
            gap = squared_gaps(x[at], x[at])
            np.fill_diagonal(gap, np.inf)
            i, j = np.nonzero(gap < worst[at, None])
            rows.append(known[at[i]])
            found.append(known[at[j]])
            gaps.append(gap[i, j])
            if k % 256 == 0 or k == hubs.num_rows:
                kept.append(nearest(np.concatenate(rows), np.concatenate(found), np.concatenate(gaps), degree))
                rows, found, gaps = [], [], []
        out = nearest(*(np.concatenate(c) for c in zip(*kept)), degree) if kept else (np.zeros(0, np.int64),) * 3
        return pa.Table.from_batches([lists_batch(*out)])

    return compare


def _by_id(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    ids = column.to_numpy()
    order = np.argsort(ids)
    return ids[order], order


def _reverse(graph: DataFrame, degree: int) -> DataFrame:
    """``node, other``: the nodes that hold ``node`` among their neighbours, the ``degree`` nearest of them."""
    pairs = graph.select(F.col("node").alias("other"), F.explode(F.arrays_zip("ids", "gaps")).alias("x")).select(F.col("x.ids").alias("node"), "other", "x.gaps")
    ranked = pairs.withColumn("k", F.row_number().over(Window.partitionBy("node").orderBy("gaps", "other")))
    return ranked.where(F.col("k") <= degree).select("node", "other")


def _both_ways(graph: DataFrame, degree: int) -> DataFrame:
    return graph.select("node", F.explode("ids").alias("other")).unionByName(_reverse(graph, degree)).distinct()


def neighbour_graph(codes: DataFrame, n: int, trees: int = TREES, leaf: int = LEAF, degree: int = DEGREE, descents: int = DESCENTS, seed: int = 7) -> DataFrame:
    """``node, ids, gaps``: about the nearest ``degree`` nodes of each node of ``codes`` (``node, code, scale``)."""
    sample = codes.orderBy(F.xxhash64("node"), "node").limit(SAMPLE).toPandas()
    depth = max(0, math.ceil(math.log2(max(1, n) / leaf)))
    dims = len(sample["code"].iloc[0]) // int(4 * sample["scale"].iloc[0]) if len(sample) else 1
    planes = np.random.default_rng(seed).standard_normal((trees, depth, dims))
    x = decode(sample["code"].tolist(), sample["scale"].to_numpy()) if len(sample) else np.zeros((1, dims))
    dealt = written(codes.mapInArrow(_leaves(planes, _cuts(x, planes)), "tree int, leaf long, node long, code binary, scale double"), "ann-leaves")
    sizes = dealt.groupBy("tree", "leaf").agg(F.ceil(F.count("*") / (2 * leaf)).alias("parts"))
    parts = written(sizes, "ann-sizes")
    split = dealt.join(parts, ["tree", "leaf"]).withColumn("part", F.pmod(F.xxhash64("node", "tree"), F.col("parts")))
    lists = split.groupBy("tree", "leaf", "part").applyInPandas(_leaf_neighbours(degree), LISTS)
    graph = written(merged(lists, degree), "ann-graph")
    home = split.where("tree = 0").select("node", "leaf", "part")
    for _ in range(descents):
        farthest = graph.select("node", F.when(F.size("gaps") >= degree, F.array_max("gaps")).otherwise(F.lit(float("inf"))).cast("double").alias("worst"))
        members = codes.join(farthest, "node", "left").select(F.col("node").alias("other"), "code", "scale", F.coalesce("worst", F.lit(float("inf"))).alias("worst"))
        hubs = written(_both_ways(graph, degree).groupBy("node").agg(F.collect_list("other").alias("ids")).join(home, "node"), "ann-hubs")
        vectors = hubs.select(F.col("leaf").alias("of_leaf"), F.col("part").alias("of_part"), F.explode("ids").alias("other")).distinct().join(members, "other")
        found = vectors.groupBy("of_leaf", "of_part").cogroup(hubs.groupBy("leaf", "part")).applyInArrow(_compare(degree), LISTS)
        graph = written(merged(graph.unionByName(found), degree), "ann-graph")
    return graph


_STATE = "node long, ids array<long>, gaps array<float>, expanded array<boolean>"
_STATE_SCHEMA = pa.schema([("node", pa.int64()), ("ids", pa.list_(pa.int64())), ("gaps", pa.list_(pa.float32())), ("expanded", pa.list_(pa.bool_()))])


def _measure(beam: int):
    """The gaps between the queries that ask in a part and the nodes there that they ask for, the ``beam`` nearest of each."""

    def measure(vectors: pa.Table, asks: pa.Table) -> pa.Table:
        out = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        if asks.num_rows:
            known, order = _by_id(vectors.column("of_node"))
            x = decode(vectors.column("of_code").to_pylist(), vectors.column("of_scale").to_numpy())[order]
            y = decode(asks.column("code").to_pylist(), asks.column("scale").to_numpy())
            for k, (node, others) in enumerate(zip(asks.column("node").to_pylist(), asks.column("others"))):
                at = np.searchsorted(known, others.values.to_numpy())
                at = at[known[at] != node]
                out.append(nearest(np.full(len(at), node), known[at], squared_gaps(y[k : k + 1], x[at])[0], beam))
        order = np.argsort(rows := np.concatenate([o[0] for o in out]), kind="stable")
        return pa.Table.from_batches([lists_batch(rows[order], *(np.concatenate([o[i] for o in out])[order] for i in (1, 2)))])

    return measure


def _advance(beam: int, width: int):
    """Rows sorted by query node and kind: first the state (kind 0), then the lists of what was measured (kind 1)."""

    def advance(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches):
            node = table.column(0).to_numpy()
            bounds = np.flatnonzero(np.concatenate(([True], node[1:] != node[:-1], [True])))
            rows = []
            for a, b in zip(bounds[:-1], bounds[1:]):
                ids, gaps = (np.concatenate([x.values.to_numpy() for x in table.column(i).slice(a, b - a)]) for i in (2, 3))
                # those of the last round's front have now been expanded
                before = np.asarray(table.column(4)[a].as_py(), bool)
                before[np.flatnonzero(~before)[:width]] = True
                done = np.concatenate((before, np.zeros(len(ids) - len(before), bool)))
                _, first = np.unique(ids, return_index=True)
                first = first[np.lexsort((ids[first], gaps[first]))][:beam]
                rows.append({"node": int(node[a]), "ids": ids[first], "gaps": gaps[first], "expanded": done[first]})
            yield pa.RecordBatch.from_pylist(rows, _STATE_SCHEMA)

    return advance


def search(starts: DataFrame, codes: DataFrame, graph: DataFrame, degree: int = DEGREE, width: int = WIDTH, beam: int = BEAM, rounds: int = ROUNDS) -> DataFrame:
    """``node, ids, gaps``: the nodes found near each node of ``starts`` (``node``), by greedy search of the graph."""
    near = written(_both_ways(graph, degree).groupBy("node").agg(F.collect_list("other").alias("near")), "ann-near")
    own = codes.join(starts, "node", "left_semi")
    parts = max(1, codes.count() // PART)
    part = lambda node: F.pmod(F.xxhash64(node), F.lit(parts))
    there = codes.select(part("node").alias("of_part"), *[F.col(c).alias(f"of_{c}") for c in ("node", "code", "scale")])
    state = own.select("node", F.array().cast("array<long>").alias("ids"), F.array().cast("array<float>").alias("gaps"), F.array().cast("array<boolean>").alias("expanded"))
    front = own.select("node", F.col("node").alias("at"))
    for _ in range(rounds + 1):
        step = front.join(near.withColumnRenamed("node", "at"), "at").select("node", F.explode("near").alias("other"))
        asks = step.groupBy("node", part("other").alias("part")).agg(F.collect_set("other").alias("others")).join(own, "node")
        found = there.groupBy("of_part").cogroup(asks.groupBy("part")).applyInArrow(_measure(beam), LISTS)
        rows = state.select("node", F.lit(0).alias("kind"), "ids", "gaps", "expanded").unionByName(found.select("node", F.lit(1).alias("kind"), "ids", "gaps", F.lit(None).cast("array<boolean>").alias("expanded")))
        state = written(rows.repartition("node").sortWithinPartitions("node", "kind").mapInArrow(_advance(beam, width), _STATE), "ann-state")
        open_ = F.transform(F.filter(F.arrays_zip("ids", "expanded"), lambda x: ~x["expanded"]), lambda x: x["ids"])
        front = state.select("node", F.explode(F.slice(open_, 1, width)).alias("at"))
        if not front.head(1):
            break
    return state.select("node", "ids", "gaps")


def nearest_of_queries(embeddings: DataFrame, every: int = 100, k: int = 10) -> DataFrame:
    """``query_id, rank, vec_id, score``: the k nearest rows found of each row whose vec_id is divisible by ``every``, by Euclidean distance."""
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v")).where("vec_id IS NOT NULL AND size(v) > 0")
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = rows.where(finite & F.exists("v", lambda x: x != 0)).distinct()
    common = rows.groupBy(F.size("v").alias("dims")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "dims").limit(1)
    dims = common.head()
    rows = rows.where(F.size("v") == (dims.dims if dims else 0))
    ranked = rows.withColumn("k", F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))).where(F.col("k") <= k + 1)
    nodes = written(ranked.groupBy("v").agg(F.min("vec_id").alias("node"), F.sort_array(F.collect_list("vec_id")).alias("members")), "ann-nodes")
    codes = written(nodes.select("node", "v").mapInArrow(_codes, "node long, code binary, scale double"), "ann-codes")
    graph = neighbour_graph(codes, nodes.count())
    asked = rows.where(F.col("vec_id") % every == 0).join(nodes, "v").select(F.col("vec_id").alias("query_id"), "node")
    asked = written(asked, "ann-asked")
    found = search(asked.select("node").distinct(), codes, graph)
    near = found.select("node", F.explode("ids").alias("other")).unionByName(found.select("node", F.col("node").alias("other")))
    here, there = nodes.select("node", F.col("v").alias("a")), nodes.select(F.col("node").alias("other"), F.col("v").alias("b"), "members")
    gap = F.sqrt(F.aggregate(F.zip_with("a", "b", lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))
    measured = written(near.join(here, "node").join(there, "other").select("node", gap.alias("score"), F.explode("members").alias("vec_id")), "ann-measured")
    # a node's queries share what was found for it: its k + 1 nearest rows suffice for each
    best = measured.withColumn("k", F.row_number().over(Window.partitionBy("node").orderBy("score", "vec_id"))).where(F.col("k") <= k + 1).drop("k")
    answers = asked.join(best, "node").where("query_id <> vec_id")
    ranked = answers.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
