"""N-gram Jaccard join by signature trees.

A document's set holds the hashes of its distinct five-word shingles; two documents link when 100 * intersection >= 75 * union. Equal sets are one
class; the join runs over one representative of each class.

1. Routing. ``BANDS`` keys of two minimum hashes each send a class to the groups in which its partners can be. Two sets of similarity s share no key
   with probability (1 - s**2)**BANDS, at the threshold 4e-15: less than the chance that two of the 64-bit shingle hashes meet. Within a group,
   ``BITS``-bit token bitmaps bound the overlap from above; classes that chains of pairs within the bound join are one block. No link leaves a
   block, each class is in one block only, and nothing is decided yet: the bound only rules pairs out.
2. Trees. The members of a block form signature trees: a node holds the OR and the AND of its members' token bitmaps and the range of their set sizes. A
   dual traversal drops a pair of nodes whose greatest possible overlap is too small, takes a pair whole where the tokens that all members of
   both share are enough already, and descends otherwise, down to pairs of members, which are decided on their exact sets. Every link is found:
   it is counted for both sides, and a forest of the links gives the components.

Large blocks: a block of more than ``SHARD`` members or ``SHINGLES`` shingles is cut into shards, and each pair of shards is a tree join of its own, so memory
is bounded at any block size and tasks are even; taken node pairs keep a block of very near copies from being spelt out pair by pair. Routing, whose
members are small, cuts groups of more than ``ROUTED`` in the same way. Steps around the trees are sums and equi-joins that Spark may split.

Edge cases: null and empty texts have empty sets and link with nothing (their component is their own doc_id); fewer than five words are one shingle;
very long texts count as many shingles and get shards of their own; repeated rows come back once each and link with each other; a null doc_id keeps its
row (component_id null unless it joins a group, whose smallest id it then takes); an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairloom.llm.components import components
from pairloom.llm.store import tidy, written
from pairloom.llm.words import Chunk, chunks, mix, run_hashes

WORDS, PERCENT = 5, 75
BANDS, BITS, TOKENS, LEAF, FAN, SHARD, SHINGLES, ROUTED = 40, 2048, 4096, 16, 8, 512, 1 << 19, 4096
_NODES, _WIDE, _TASK_BYTES = 1 << 13, 1 << 27, 8 << 20
_rng = np.random.Generator(np.random.PCG64(75))
_MUL = _rng.integers(1, 2**63, 2 * BANDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _rng.integers(0, 2**63, 2 * BANDS, dtype=np.uint64)


def shingle_sets(c: Chunk, n: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingle hashes of all texts of a chunk, sorted within each text, and the bounds of each text's part."""
    at, grams = c.grams(n)
    doc = c.doc_of(at)
    short = np.flatnonzero((np.diff(c.bounds) > 0) & (np.diff(c.bounds) < n))
    if len(short):
        doc = np.concatenate((doc, short))
        grams = np.concatenate((grams, mix(run_hashes(c.hash, c.bounds[short], c.bounds[short + 1]) + np.diff(c.bounds)[short].astype(np.uint64))))
    order = np.lexsort((grams, doc))
    doc, grams = doc[order], grams[order]
    if len(doc):
        keep = np.concatenate(([True], (doc[1:] != doc[:-1]) | (grams[1:] != grams[:-1])))
        doc, grams = doc[keep], grams[keep]
    return grams, np.searchsorted(doc, np.arange(c.n + 1))


def bitmaps(row: np.ndarray, bit: np.ndarray, n: int, bits: int) -> np.ndarray:
    out = np.zeros((n, bits // 64), np.uint64)
    bit = bit.astype(np.int64)
    np.bitwise_or.at(out.reshape(-1), row * (bits // 64) + (bit >> 6), np.uint64(1) << (bit & 63).astype(np.uint64))
    return out


def _profiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for c in chunks(batch.column(2), lower=True):
            sets, bounds = shingle_sets(c)
            size = np.diff(bounds)
            full = np.flatnonzero(size)
            keys = np.zeros((len(full), BANDS), np.uint64)
            low, high = np.zeros(c.n, np.uint64), np.zeros(c.n, np.uint64)
            if len(full):
                at = bounds[full]
                for k in range(BANDS):
                    one, two = (np.minimum.reduceat(sets * _MUL[j] + _ADD[j], at) for j in (2 * k, 2 * k + 1))
                    keys[:, k] = mix(one + mix(two + np.uint64(k)))
                low[full], high[full] = np.add.reduceat(mix(sets), at), np.add.reduceat(mix(sets ^ np.uint64(0x5851F42D4C957F2D)), at)
            listed = np.zeros(c.n + 1, np.int32)
            listed[1:] = np.cumsum(np.where(size > 0, BANDS, 0))
            raw = bitmaps(np.repeat(np.arange(c.n), size), sets & np.uint64(BITS - 1), c.n, BITS)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(c.first, c.n), batch.column(1).slice(c.first, c.n), pa.array(size.astype(np.int64)), pa.array(low.view(np.int64)), pa.array(high.view(np.int64)), pa.ListArray.from_arrays(pa.array(listed), pa.array(keys.view(np.int64).ravel())), pa.array([r.tobytes() for r in raw], pa.binary())],
                names=["doc_id", "text_key", "n_shingles", "low", "high", "keys", "bits"],
            )


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for c in chunks(batch.column(1), lower=True):
            sets, bounds = shingle_sets(c)
            raw = sets.tobytes()
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(c.first, c.n), pa.array([raw[8 * a : 8 * b] for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())], pa.binary())], names=["id", "tokens"])


def sorted_groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """The groups of rows that are sorted by their first ``keys`` columns, wherever batches end."""
    held: pa.Table | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        here = pa.Table.from_batches([batch])
        here = here if held is None else pa.concat_tables([held, here])
        edge = np.zeros(here.num_rows - 1, bool)
        for k in range(keys):
            column = here.column(k).to_numpy()
            edge |= column[1:] != column[:-1]
        cuts = [0, *(np.flatnonzero(edge) + 1).tolist()]
        for a, b in zip(cuts[:-1], cuts[1:]):
            yield here.slice(a, b - a)
        held = here.slice(cuts[-1])
    if held is not None:
        yield held


class Forest:
    """Union-find over the places of an array of labels; ``joins`` tells which of some pairs join two components."""

    def __init__(self, labels: np.ndarray) -> None:
        self.label = np.unique(labels, return_inverse=True)[1]

    def joins(self, i: np.ndarray, j: np.ndarray) -> list[int]:
        out: list[int] = []
        while len(apart := np.flatnonzero(self.label[i] != self.label[j])):
            x, y = self.label[i[apart]], self.label[j[apart]]
            _, first = np.unique(np.minimum(x, y) * len(self.label) + np.maximum(x, y), return_index=True)
            up: dict[int, int] = {}
            for k in first.tolist():
                a, b = _root(up, int(x[k])), _root(up, int(y[k]))
                if a != b:
                    up[a] = b
                    out.append(int(apart[k]))
            to = np.arange(len(self.label))
            for a in up:
                to[a] = _root(up, a)
            self.label = to[self.label]
        return out


def _root(up: dict[int, int], x: int) -> int:
    while (y := up.get(x, x)) != x:
        up[x] = up.get(y, y)
        x = y
    return x


def may_overlap(bits: np.ndarray, size: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Whether the bitmaps of members i (down) and j (across) leave room for enough common tokens."""
    lost = np.bitwise_count(bits[i, None] & ~bits[None, j]).sum(axis=2, dtype=np.int64)
    gained = np.bitwise_count(~bits[i, None] & bits[None, j]).sum(axis=2, dtype=np.int64)
    one, two = size[i, None], size[None, j]
    common = np.minimum(one - lost, two - gained)
    return (common > 0) & (100 * common >= PERCENT * (one + two - common))


def _may_join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of pairs (a, b, sizes, bitmaps) those within the bound."""
    for batch in batches:
        good = np.zeros(batch.num_rows, bool)
        for k in range(0, batch.num_rows, 4096):
            part = batch.slice(k, 4096)
            x, y = (np.frombuffer(b"".join(part.column(c).to_pylist()), np.uint64).reshape(part.num_rows, -1) for c in (4, 5))
            one, two = part.column(2).to_numpy(), part.column(3).to_numpy()
            common = np.minimum(one - np.bitwise_count(x & ~y).sum(axis=1, dtype=np.int64), two - np.bitwise_count(y & ~x).sum(axis=1, dtype=np.int64))
            good[k : k + 4096] = (common > 0) & (100 * common >= PERCENT * (one + two - common))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(good))


def _chains(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each two shards of a routing group (key, low, high, shard, id, component, size, bits): pairs within the bound that join all that such pairs join."""
    a, b = [], []
    for group in sorted_groups(batches, 3):
        low, high = group.column(1)[0].as_py(), group.column(2)[0].as_py()
        shard, ids, size = (group.column(k).to_numpy() for k in (3, 4, 6))
        bits = np.frombuffer(b"".join(group.column(7).to_pylist()), np.uint64).reshape(len(ids), -1)
        forest = Forest(group.column(5).to_numpy())
        rows, columns = (np.flatnonzero(shard == s) for s in (low, high))
        for k in range(0, len(rows), 32):
            if (forest.label == forest.label[0]).all():
                break
            i = rows[k : k + 32]
            j = columns if low < high else columns[columns > i[0]]
            j = j[(forest.label[j] != forest.label[i[0]])] if len(i) == 1 else j
            x, y = np.nonzero(may_overlap(bits, size, i, j)) if len(j) else ([], [])
            x, y = i[x], j[y]
            one = forest.joins(x, y)
            a.append(ids[x[one]])
            b.append(ids[y[one]])
        if len(a) > 4096:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], names=["a", "b"])
            a, b = [], []
    if a:
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], names=["a", "b"])


class SignatureTree:
    """Levels of nodes over members in the given order; each node has the OR and AND of its members' token bitmaps, the greatest number of
    tokens that the bitmaps show, and the range of set sizes. Level 0 is the members."""

    def __init__(self, bits: np.ndarray, shown: np.ndarray, size: np.ndarray) -> None:
        self.n, self.levels = len(size), [{"any": bits, "all": bits, "shown": shown, "least": size, "most": size, "span": 1}]
        for fan in [LEAF] + [FAN] * 20:
            top = self.levels[-1]
            if len(top["least"]) <= 1:
                break
            at = np.arange(0, len(top["least"]), fan)
            self.levels.append({
                "any": np.bitwise_or.reduceat(top["any"], at), "all": np.bitwise_and.reduceat(top["all"], at), "shown": np.maximum.reduceat(top["shown"], at),
                "least": np.minimum.reduceat(top["least"], at), "most": np.maximum.reduceat(top["most"], at), "span": top["span"] * fan, "fan": fan,
            })

    def below(self, level: int, node: np.ndarray, other: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        fan, n = self.levels[level]["fan"], len(self.levels[level - 1]["least"])
        child, other = (node[:, None] * fan + np.arange(fan)).ravel(), np.repeat(other, fan)
        return child[child < n], other[child < n]


def overlap_bounds(p: dict, i: np.ndarray, q: dict, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether members under nodes i of p and j of q may be similar enough, and whether all of them are (if each bit is one token)."""
    lost_i = np.bitwise_count(p["all"][i] & ~q["any"][j]).sum(axis=1, dtype=np.int64)
    lost_j = np.bitwise_count(q["all"][j] & ~p["any"][i]).sum(axis=1, dtype=np.int64)
    common = np.minimum(p["shown"][i] - lost_i, q["shown"][j] - lost_j)
    union = np.maximum(p["least"][i] + q["least"][j] - common, np.maximum(p["least"][i], q["least"][j]))
    shared = np.bitwise_count(p["all"][i] & q["all"][j]).sum(axis=1, dtype=np.int64)
    sure = (shared > 0) & (100 * shared >= PERCENT * (p["most"][i] + q["most"][j] - shared))
    return (common > 0) & (100 * common >= PERCENT * union), sure


def dual_traversal(p: SignatureTree, q: SignatureTree, exact: bool) -> Iterator[tuple[int, np.ndarray, int, np.ndarray]]:
    """Level and nodes of p, level and nodes of q: pairs that link as a whole (``exact``: each bit is one token), or else pairs of members that no bound
    rules out. p and q may be one tree, whose pairs come once each. Bounded work list."""
    own = p is q
    work = [(len(p.levels) - 1, len(q.levels) - 1, np.zeros(1, np.int64), np.zeros(1, np.int64))]
    while work:
        lp, lq, i, j = work.pop()
        if len(i) > _NODES:
            work += [(lp, lq, i[k : k + _NODES], j[k : k + _NODES]) for k in range(0, len(i), _NODES)]
            continue
        may, sure = overlap_bounds(p.levels[lp], i, q.levels[lq], j)
        if own:
            sure, may = sure & (i != j), may | (i == j)
        if exact:
            if sure.any():
                yield lp, i[sure], lq, j[sure]
            may &= ~sure
        if lp == lq == 0:
            if not exact and may.any():
                yield 0, i[may], 0, j[may]
            continue
        i, j = i[may], j[may]
        if not len(i):
            continue
        if own:
            j, i = q.below(lq, j, i)
            i, j = p.below(lp, i, j)
            up = (i < j) if lp == 1 else (i <= j)
            work.append((lp - 1, lq - 1, i[up], j[up]))
        elif lp >= lq:
            i, j = p.below(lp, i, j)
            work.append((lp - 1, lq, i, j))
        else:
            j, i = q.below(lq, j, i)
            work.append((lp, lq - 1, i, j))


class TreeJoin:
    """The links between two shards of a block, or within one, decided on exact sets."""

    def __init__(self, tokens: list[bytes], shard: np.ndarray) -> None:
        size = np.array([len(t) // 8 for t in tokens], np.int64)
        flat = np.frombuffer(b"".join(tokens), np.uint64)
        bounds = np.concatenate(([0], np.cumsum(size)))
        # similar sets next to each other: by their smallest hash, then size
        order = np.lexsort((size, flat[bounds[:-1]], shard))
        self.order, self.split = order, int((shard == shard[order[0]]).sum())
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        known, at, times = np.unique(flat, return_inverse=True, return_counts=True)
        # a token of one member only can't be common: it counts in the size alone
        number = np.cumsum(times > 1) - 1
        shared = times[at] > 1
        self.row, self.token = place[np.repeat(np.arange(len(size)), size)[shared]], number[at[shared]]
        self.tokens = int(number[-1]) + 1 if len(number) else 0
        self.exact = self.tokens <= TOKENS
        width = max(64, min(TOKENS, -(-self.tokens // 64) * 64))
        bits, shown, size = bitmaps(self.row, self.token % width, len(size), width), np.bincount(self.row, minlength=len(size)), size[order]
        self.size, n = size, self.split
        self.p = SignatureTree(bits[:n], shown[:n], size[:n])
        self.q = SignatureTree(bits[n:], shown[n:], size[n:]) if n < len(size) else self.p
        self.first_q = n if n < len(size) else 0

    def _common(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Exact numbers of common tokens, where bits of the tree stand for several tokens."""
        if not hasattr(self, "wide"):
            width = -(-self.tokens // 64) * 64
            self.wide = bitmaps(self.row, self.token, len(self.size), width) if len(self.size) * width // 8 <= _WIDE else None
            by_row = np.lexsort((self.token, self.row))
            self.lists = np.split(self.token[by_row], np.searchsorted(self.row[by_row], np.arange(1, len(self.size))))
        if self.wide is None:
            return np.array([len(np.intersect1d(self.lists[a], self.lists[b], assume_unique=True)) for a, b in zip(i.tolist(), j.tolist())], np.int64)
        step = max(1, (1 << 21) // self.wide.shape[1])
        return np.concatenate([np.bitwise_count(self.wide[i[k : k + step]] & self.wide[j[k : k + step]]).sum(axis=1, dtype=np.int64) for k in range(0, len(i), step)])

    def links(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """Ranges of members (first and end in tree order, on both sides) all of whose pairs link."""
        for lp, i, lq, j in dual_traversal(self.p, self.q, self.exact):
            if not self.exact:
                common = self._common(i, j + self.first_q)
                good = (common > 0) & (100 * common >= PERCENT * (self.size[i] + self.size[j + self.first_q] - common))
                i, j = i[good], j[good]
            x, y = self.p.levels[lp]["span"], self.q.levels[lq]["span"]
            yield i * x, np.minimum((i + 1) * x, self.p.n), j * y + self.first_q, np.minimum((j + 1) * y, self.q.n) + self.first_q


def _tree_join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each two shards (block, low, high, shard, id, rows, tokens): ``a = b`` with the number of rows that a links with there, and links a, b (0) of a forest."""
    for group in sorted_groups(batches, 3):
        shard, ids, rows = (group.column(k).to_numpy() for k in (3, 4, 5))
        if len(ids) < 2 or (group.column(1)[0].as_py() < group.column(2)[0].as_py()) != (shard.min() < shard.max()):
            continue
        join = TreeJoin(group.column(6).to_pylist(), shard)
        ids, rows = ids[join.order], rows[join.order]
        sums, count = np.concatenate(([0], np.cumsum(rows))), np.zeros(len(ids) + 1, np.int64)
        forest, a, b = Forest(np.arange(len(ids))), [], []
        for i, i_end, j, j_end in join.links():
            for first, end, x, y in ((i, i_end, j, j_end), (j, j_end, i, i_end)):
                weight = sums[y] - sums[x]
                np.add.at(count, first, weight)
                np.subtract.at(count, end, weight)
            # two ranges that link as a whole are one component: each member with the first of the other side
            for first, end, x in ((i, i_end, j), (j, j_end, i)):
                n = end - first
                member = np.repeat(first - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())
                mate = np.repeat(x, n)
                one = forest.joins(member, mate)
                a.append(ids[member[one]])
                b.append(ids[mate[one]])
        count = np.cumsum(count)[:-1]
        some = np.flatnonzero(count)
        a, b = np.concatenate([ids[some], *a]), np.concatenate([ids[some], *b])
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(np.concatenate((count[some], np.zeros(len(a) - len(some), np.int64))))], names=["a", "b", "links"])


def _tree_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same, but every link a < b, in bounded batches."""
    for group in sorted_groups(batches, 3):
        shard, ids = group.column(3).to_numpy(), group.column(4).to_numpy()
        if len(ids) < 2 or (group.column(1)[0].as_py() < group.column(2)[0].as_py()) != (shard.min() < shard.max()):
            continue
        join = TreeJoin(group.column(6).to_pylist(), shard)
        ids, held, n = ids[join.order], [], 0
        for i, i_end, j, j_end in join.links():
            # range by range along the first side, member by member where a range has several
            for k in range(int((i_end - i).max(initial=0))):
                some = i + k < i_end
                n_j = (j_end - j)[some]
                x = np.repeat(ids[(i + k)[some]], n_j)
                y = ids[np.repeat(j[some] - np.concatenate(([0], np.cumsum(n_j)[:-1])), n_j) + np.arange(n_j.sum())]
                held.append((np.minimum(x, y), np.maximum(x, y)))
                n += len(x)
                if n >= 1 << 16:
                    yield _pairs_batch(held)
                    held, n = [], 0
        if held:
            yield _pairs_batch(held)


def _pairs_batch(held: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*held)], names=["a", "b"])


def _dealt(rows: DataFrame) -> DataFrame:
    """Rows with ``shards`` of their group, with ``low, high, shard``: once for each pair of shards that their own shard (by ``id``) is in."""
    one = rows.where("shards = 1").select("*", *[F.lit(0).alias(c) for c in ("shard", "low", "high")])
    cut = rows.where("shards > 1").withColumn("shard", F.pmod(F.xxhash64("id"), F.col("shards")).cast("int")).withColumn("with", F.explode(F.expr("sequence(0, CAST(shards - 1 AS INT))")))
    return one.unionByName(cut.withColumn("low", F.least("shard", "with")).withColumn("high", F.greatest("shard", "with")).drop("with"))


def _by_group(rows: DataFrame, n_bytes: float, *keys: str) -> DataFrame:
    """Rows sorted by group, in as many partitions as their bytes ask for (a number that Spark does not lower)."""
    spark = rows.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")) if n_bytes > 0 else 1, int(n_bytes // _TASK_BYTES) + 1)
    return rows.repartition(parts, *keys).sortWithinPartitions(*keys)


def _classes(documents: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_key"), "text")
    profile = written(docs.mapInArrow(tidy(_profiles), "doc_id long, text_key long, n_shingles long, low long, high long, keys array<long>, bits binary"), "join-profile")
    sets = profile.where("n_shingles > 0")
    # classes have ids of their own, as doc_id may be null or repeated
    classes = sets.groupBy("low", "high", "n_shingles").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("rows"), F.min(F.struct(F.coalesce("doc_id", F.lit(0)).alias("did"), "text_key")).alias("one"), F.first("keys").alias("keys"), F.first("bits").alias("bits"))
    return docs, profile, written(classes.withColumn("id", F.monotonically_increasing_id()), "join-classes")


def _blocks(classes: DataFrame) -> DataFrame:
    """``id, component``: the blocks of step 1, without classes that are alone."""
    routed = classes.select("id", F.explode("keys").alias("key"))
    groups = routed.groupBy("key").agg(F.min("id").alias("least"), F.max("id").alias("most"), F.count("*").alias("n"), F.sum(F.xxhash64("id").cast("decimal(20,0)")).alias("members")).where("n > 1")
    # groups of the same members are one group
    groups = written(groups.groupBy("n", "members", "least", "most").agg(F.min("key").alias("key")).drop("members"), "join-groups")
    member = written(routed.join(groups, "key"), "join-members")
    star = member.select(F.least("id", "least").alias("a"), F.greatest("id", "least").alias("b")).unionByName(member.select(F.least("id", "most").alias("a"), F.greatest("id", "most").alias("b"))).where("a <> b").distinct()
    one, two = (classes.select(F.col("id").alias(x), F.col("n_shingles").alias(f"size_{x}"), F.col("bits").alias(f"bits_{x}")) for x in "ab")
    near = star.join(one, "a").join(two, "b").select("a", "b", "size_a", "size_b", "bits_a", "bits_b").mapInArrow(tidy(_may_join), "a long, b long")
    near = written(near, "join-near")
    label = components(near, "join-chained")
    # members of a group of four or more that are still apart (the star has all pairs of three)
    labelled = written(member.where("n > 3").select("key", "n", "id").join(label, "id", "left").select("key", "n", "id", F.coalesce("component", "id").alias("component")), "join-labelled")
    mixed = written(labelled.groupBy("key").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x <> y").select("key"), "join-mixed")
    apart = written(labelled.join(mixed, "key", "left_semi").withColumn("shards", F.ceil(F.col("n") / ROUTED)), "join-apart")
    apart = _dealt(apart).join(classes.select("id", "n_shingles", "bits"), "id")
    apart = apart.select("key", "low", "high", "shard", "id", "component", "n_shingles", "bits")
    chained = _by_group(apart, 1, "key", "low", "high").mapInArrow(tidy(_chains), "a long, b long")
    return components(near.unionByName(written(chained, "join-chains")), "join-block")


def _blocked_sets(docs: DataFrame, classes: DataFrame) -> DataFrame:
    """The members of each two shards of each block, sorted: ``block, low, high, shard, id, rows, tokens``."""
    block = _blocks(classes)
    inside = written(block.join(classes.select("id", "rows", "n_shingles", "one"), "id").select("id", F.col("component").alias("block"), "rows", "n_shingles", "one"), "join-inside")
    shards = F.greatest(F.ceil(F.count("*") / SHARD), F.ceil(F.sum("n_shingles") / SHINGLES)).alias("shards")
    sizes = written(inside.groupBy("block").agg(shards, F.sum("n_shingles").alias("tokens")), "join-sizes")
    total = sizes.agg(F.sum(8 * F.col("shards") * F.col("tokens"))).head()[0] or 0
    found = docs.select(F.coalesce("doc_id", F.lit(0)).alias("did"), "text_key", "text").join(inside.select("id", "one.did", "one.text_key"), ["did", "text_key"])
    # rows of one class that are repeated give the same text
    sets = written(found.groupBy("id").agg(F.first("text").alias("text")).mapInArrow(tidy(_sets), "id long, tokens binary"), "join-sets")
    dealt = _dealt(written(inside.select("id", "block", "rows").join(sizes.select("block", "shards"), "block"), "join-sharded")).join(sets, "id")
    return _by_group(dealt.select("block", "low", "high", "shard", "id", "rows", "tokens"), total, "block", "low", "high")


def linked_classes(documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """All links between different sets, as pairs of class representatives ``class_a, class_b`` (smallest doc_id of each; null if it has none), and the
    membership ``doc_id, class_id``."""
    docs, profile, classes = _classes(documents)
    pairs = _blocked_sets(docs, classes).mapInArrow(tidy(_tree_pairs), "a long, b long")
    a, b = (classes.select(F.col("id").alias(x), F.col("doc_id").alias(f"class_{x}")) for x in "ab")
    named = classes.select("low", "high", "n_shingles", F.col("doc_id").alias("class_id"))
    return pairs.join(a, "a").join(b, "b").select("class_a", "class_b"), profile.join(named, ["low", "high", "n_shingles"]).select("doc_id", "class_id")


def _grouped(documents: DataFrame) -> DataFrame:
    docs, profile, classes = _classes(documents)
    joined = written(_blocked_sets(docs, classes).mapInArrow(tidy(_tree_join), "a long, b long, links long"), "join-links")
    near = components(joined.where("a <> b").select("a", "b"), "join-component")
    links = joined.where("a = b").groupBy(F.col("a").alias("id")).agg(F.sum("links").alias("links"))
    by_class = written(classes.select("id", "low", "high", "n_shingles", "doc_id", "rows").join(near, "id", "left").join(links, "id", "left").withColumn("component", F.coalesce("component", "id")), "join-labels")
    # written before they are joined, so that Spark can split a large component or class
    smallest = written(by_class.groupBy("component").agg(F.min("doc_id").alias("component_id")), "join-smallest")
    named = written(by_class.join(smallest, "component").select("low", "high", "n_shingles", "component", "component_id", F.col("doc_id").alias("class_id"), (F.coalesce("links", F.lit(0)) + F.col("rows") - 1).alias("n_links")), "join-named")
    return profile.select("doc_id", "text_key", "n_shingles", "low", "high").join(named, ["low", "high", "n_shingles"], "left")


def similar_groups(documents: DataFrame) -> DataFrame:
    """``doc_id, n_shingles, component_id, class_id, n_links`` of each row of ``documents`` (``doc_id, text``); ``n_links`` counts the other rows that it links with."""
    full = F.col("n_shingles") > 0
    own = [F.when(full, F.col(c)).otherwise(F.col("doc_id")).alias(c) for c in ("component_id", "class_id")]
    return _grouped(documents).select("doc_id", "n_shingles", *own, F.when(full, F.col("n_links")).otherwise(F.lit(0)).cast("long").alias("n_links"))


def one_of_each(documents: DataFrame) -> DataFrame:
    """``doc_id, text_key`` (xxhash64 of the text) of one row of each component, that with the smallest doc_id (null last, then smallest key), and of each row with an empty set."""
    rows = _grouped(documents)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "text_key")).alias("one")
    stay = rows.where("n_shingles > 0").groupBy("component").agg(first).select("one.doc_id", "one.text_key")
    return stay.unionByName(rows.where("n_shingles = 0").select("doc_id", "text_key")).distinct()
