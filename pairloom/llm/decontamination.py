"""Benchmark decontamination by SimHash of item-sized windows, with DataFrame functions only.

Words are runs of characters other than 0x20 and 0x09-0x0D, A-Z in lower case. A window of an item's length in words (the whole document, if shorter) is
contaminated by the item if their multisets of five-word shingles have a weighted Jaccard similarity (sum of smaller counts over sum of larger
counts) of 0.75 or more. Items or documents of one to four words are one shingle, the whole sequence, and match only each other.

1. Shingles of all documents meet the items' shingles; a window can only be similar enough if that many of its shingles occur in some item of its length,
   so windows below that bound are never formed. The bound drops no match.
2. Each remaining window, and each item, gets a 64-bit SimHash, shingles weighted by their counts.
3. Multi-index Hamming blocks: the fingerprint is cut into ``BLOCKS`` parts of 16 bits; two fingerprints within ``RADIUS`` bits agree in some part up to
   RADIUS // BLOCKS bits, and the items' index holds every such variant, so an equi-join on (length, part's place, part) finds all of them, and
   unrelated pairs with a probability of 0.8 %.
4. At similarity 0.75 fingerprints differ in about 11 bits (standard deviation 3), so the radius alone would lose matches. Items of which a document holds as
   many shingles as a match needs (a sound bound) are therefore candidates of its windows too, wherever the index has not met the two.
5. Candidates are verified by their exact weighted similarity; the best window of each document and item stays (the first of equals).

The items' shingles and index rows are broadcast only if there are at most ``MAX_BROADCAST`` (counted first); beyond that Spark shuffles. Hits of a shingle are never
gathered by shingle, only by document, so a passage that a third of the documents hold is spread evenly.

Edge cases: null and empty texts, and such items, match nothing; repeated rows are reported once each; a very long text is one array of
hashes, of which only the windows near enough hits are spelt out; a null doc_id or item_id is kept; an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import string
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairloom.llm.store import written

WORDS, PERCENT, RADIUS, BLOCKS, MAX_BROADCAST = 5, 75, 11, 4, 200_000
_SPLIT = "[\\x20\\x09-\\x0D]+"


def words_of(text: Column) -> Column:
    lower = F.translate(text, string.ascii_uppercase, string.ascii_lowercase)
    return F.filter(F.split(F.coalesce(lower, F.lit("")), _SPLIT), lambda w: w != "")


def _shingled(rows: DataFrame) -> DataFrame:
    """Adds ``n_words`` and ``shingles`` (hashes, in order) to rows with a column ``text``."""
    hashed = rows.withColumn("w", F.transform(words_of(F.col("text")), lambda x: F.xxhash64(x))).drop("text").withColumn("n_words", F.size("w"))
    five = F.expr("transform(sequence(0, n_words - 5), i -> xxhash64(w[i], w[i + 1], w[i + 2], w[i + 3], w[i + 4]))")
    none = F.array().cast("array<bigint>")
    return hashed.withColumn("shingles", F.when(F.col("n_words") >= WORDS, five).when(F.col("n_words") > 0, F.array(F.xxhash64("n_words", "w"))).otherwise(none)).drop("w")


def _fingerprint(shingles: str) -> Column:
    """64-bit SimHash of an array of hashes, each occurrence counting once: bit b is set if most shingles have it."""
    return F.expr(
        f"aggregate(sequence(0, 63), 0L, (f, b) -> f | if(2 * aggregate({shingles}, 0, (s, x) -> s + CAST(shiftrightunsigned(x, b) & 1L AS INT)) > size({shingles}), shiftleft(1L, b), 0L))"
    )


def _part(place: str) -> str:
    return f"CAST(shiftrightunsigned(fingerprint, {64 // BLOCKS} * {place}) & {2 ** (64 // BLOCKS) - 1}L AS INT)"


def contaminated(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``doc_id, item_id, first_word, n_words, similarity, distance``: the best window of each document for each item that contaminates it."""
    docs = _keyed(documents)
    return docs.select("did", "row_key", F.col("doc_id").cast("long").alias("doc_id")).join(_matches(docs, benchmark), ["did", "row_key"]).select("doc_id", "item_id", F.col("first_word").cast("int").alias("first_word"), F.col("n_words").cast("int").alias("n_words"), "similarity", "distance")


def without_contaminated(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``documents``, all columns, that no item contaminates."""
    docs = _keyed(documents, F.struct("*").alias("row"))
    return docs.join(_matches(docs, benchmark).select("did", "row_key").distinct(), ["did", "row_key"], "left_anti").select("row.*")


def _keyed(documents: DataFrame, *more: Column) -> DataFrame:
    return documents.select(F.coalesce("doc_id", F.lit(0)).cast("long").alias("did"), F.xxhash64("doc_id", "text").alias("row_key"), "doc_id", "text", *more)


def _met(window: DataFrame, item: DataFrame) -> DataFrame:
    """Windows and items of one length whose fingerprints are within ``RADIUS`` bits, by the index of the items' blocks."""
    width = 64 // BLOCKS
    flips = [sum(1 << b for b in bits) for k in range(RADIUS // BLOCKS + 1) for bits in combinations(range(width), k)]
    places = F.expr(f"sequence(0, {BLOCKS - 1})")
    index = item.select("item", "length", F.col("fingerprint").alias("print_b"), "fingerprint", F.explode(places).alias("place"))
    index = index.select("item", "length", "print_b", "place", F.explode(F.transform(F.array(*[F.lit(x) for x in flips]), lambda x: F.expr(_part("place")).bitwiseXOR(x))).alias("part"))
    if item.count() * BLOCKS * len(flips) <= MAX_BROADCAST:
        index = F.broadcast(index)
    probe = window.select("did", "row_key", "length", "first_word", "fingerprint", F.explode(places).alias("place")).withColumn("part", F.expr(_part("place")))
    near = probe.join(index, ["length", "place", "part"]).where(F.bit_count(F.col("fingerprint").bitwiseXOR(F.col("print_b"))) <= RADIUS)
    return near.select("did", "row_key", "length", "first_word", "item").distinct()


def _matches(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    item = _shingled(benchmark.select("item_id", "text")).where("n_words > 0").withColumnRenamed("n_words", "length").distinct()
    item = written(item.withColumn("fingerprint", _fingerprint("shingles")).withColumn("item", F.monotonically_increasing_id()), "leak-items")
    wanted = written(item.select(F.explode("shingles").alias("shingle"), "length").distinct(), "leak-shingles")
    small = F.broadcast if wanted.count() <= MAX_BROADCAST else (lambda x: x)
    # an item meets windows of its own length, or whole shorter texts; short sequences only whole texts of the same length
    # the outer form, as Spark puts a filter on the array, worked out anew for each element, before the plain one
    hits = _shingled(docs.select("did", "row_key", "text")).select("did", "row_key", "n_words", F.posexplode_outer("shingles").alias("at", "shingle")).join(small(wanted), "shingle")
    spots = hits.groupBy("did", "row_key", "n_words", "length").agg(F.array_sort(F.collect_set("at")).alias("at")).withColumn("size", F.expr("greatest(least(length, n_words) - 4, 1)"))
    spots = spots.withColumn("least", F.expr(f"CAST(ceil({PERCENT} * size / 100.0D) AS INT)")).where("size(at) >= least")
    # a window that starts at s holds enough hits if some hit j >= s and the hit least - 1 after it lie inside
    ranges = F.expr("filter(transform(sequence(0, size(at) - least), j -> struct(greatest(0, at[j + least - 1] - size + 1) AS low, least(at[j], greatest(n_words - length, 0)) AS high)), r -> r.low <= r.high)")
    starts = F.array_distinct(F.flatten(F.transform(ranges, lambda r: F.sequence(r["low"], r["high"]))))
    spots = written(spots.select("did", "row_key", "length", "size", starts.alias("starts")).where("size(starts) > 0"), "leak-spots")
    by_doc = spots.groupBy("did", "row_key").agg(F.collect_list(F.struct("length", "size", "starts")).alias("spots"))
    held = written(docs.select("did", "row_key", "text").distinct().join(by_doc, ["did", "row_key"]), "leak-texts")
    window = _shingled(held).select("did", "row_key", "n_words", "shingles", F.explode("spots").alias("s")).select("did", "row_key", "n_words", "shingles", "s.length", "s.size", F.explode("s.starts").alias("first_word"))
    window = window.withColumn("own", F.expr("slice(shingles, first_word + 1, size)")).select("did", "row_key", "length", "first_word", F.expr("least(length, n_words)").alias("n_words"), "own")
    window = written(window.withColumn("fingerprint", _fingerprint("own")), "leak-windows")
    met = _met(window, item).select("did", "row_key", "length", "first_word", "item")
    # items of which the document holds enough shingles for a window to match: for c common ones of a and b, 100 c >= PERCENT (a + b - c)
    own = item.select("item", "length", F.size("shingles").alias("theirs"), F.explode(F.array_distinct("shingles")).alias("shingle"))
    own = F.broadcast(own) if (item.agg(F.sum(F.size("shingles"))).head()[0] or 0) <= MAX_BROADCAST else own
    inside = _shingled(held).select("did", "row_key", "n_words", F.transform("spots", lambda s: s["length"]).alias("lengths"), F.explode_outer("shingles").alias("shingle"))
    counts = inside.join(own, "shingle").where("array_contains(lengths, length)").groupBy("did", "row_key", "n_words", "item", "length", "theirs").agg(F.count("*").alias("n"))
    enough = counts.where(f"n * {100 + PERCENT} >= {PERCENT} * (greatest(least(length, n_words) - 4, 1) + theirs)").select("did", "row_key", "length", "item")
    rest = window.select("did", "row_key", "length", "first_word").join(enough, ["did", "row_key", "length"])
    pairs = met.unionByName(rest).distinct()
    candidate = pairs.join(window, ["did", "row_key", "length", "first_word"]).join(item.select("item", "item_id", F.col("shingles").alias("theirs"), F.col("fingerprint").alias("print_b")), "item")
    candidate = candidate.withColumn("distance", F.bit_count(F.col("fingerprint").bitwiseXOR(F.col("print_b"))))
    common = F.expr("aggregate(array_distinct(theirs), 0, (s, x) -> s + least(size(filter(theirs, y -> y = x)), size(filter(own, y -> y = x))))")
    alike = candidate.withColumn("common", common).withColumn("all", F.expr("size(theirs) + size(own) - common")).where(F.col("common") * 100 >= PERCENT * F.col("all"))
    alike = alike.select("did", "row_key", "item_id", "item", "first_word", "n_words", (F.col("common") / F.col("all")).alias("similarity"), F.col("distance").cast("int").alias("distance"))
    best = alike.groupBy("did", "row_key", "item").agg(F.min(F.struct(-F.col("similarity"), "first_word", "n_words", "similarity", "distance", "item_id")).alias("b"))
    return written(best.select("did", "row_key", "b.item_id", "b.first_word", "b.n_words", "b.similarity", "b.distance"), "leak-found")
