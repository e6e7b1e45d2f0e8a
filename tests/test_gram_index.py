"""BM25 over the block index against plain counting."""

import math
import random
from collections import Counter

import pytest

from pairloom.operators import gram_index, retrieval
from pairloom.plans.shared import kept


def plain(queries, docs, k, n):
    grams = [(i, Counter((t or "")[j : j + n] for j in range(len(t or "") - n + 1))) for i, t in docs]
    df = Counter(g for _, c in grams for g in c)
    mean = sum(sum(c.values()) for _, c in grams) / len(docs)
    out = []
    for q, text in queries:
        asked = {(text or "")[j : j + n] for j in range(len(text or "") - n + 1)}
        scores = []
        for i, c in grams:
            size = sum(c.values())
            if asked & set(c):
                scores.append((sum(math.log(1 + (len(docs) - df[g] + 0.5) / (df[g] + 0.5)) * c[g] * 2.5 / (c[g] + 1.5 * (0.25 + 0.75 * size / mean)) for g in asked if g in c), i))
        scores.sort(key=lambda x: (-round(x[0], 6), x[1] is not None, x[1]))
        out += [(q, i, round(s, 5), rank) for rank, (s, i) in enumerate(scores[:k], 1)]
    return sorted(out, key=repr)


def corpus(seed, n):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdef😀é") for _ in range(r.randint(1, 6)))
    vocabulary = [word() for _ in range(60)]
    return [" ".join(r.choice(vocabulary) for _ in range(r.choice([0, 1, 2, 8, 30, 200]))) for _ in range(n)]


@pytest.mark.parametrize("n", [2, 3, 4])
def test_equals_plain_counting(spark, monkeypatch, n):
    monkeypatch.setattr(gram_index, "DOCUMENTS", 5)
    monkeypatch.setattr(gram_index, "QUERIES", 9)
    texts = corpus(n, 150)
    docs = [*enumerate(texts), (900, None), (901, texts[3]), (902, texts[3]), (None, texts[3]), (903, texts[3] * 40)]
    queries = [(i, t[:60]) for i, t in enumerate(corpus(7, 15))] + [(50, texts[3]), (51, texts[3]), (52, None), (53, "q"), (54, "zzzzzz")]
    index = kept(gram_index.gram_index(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), n), "grams")
    q = spark.createDataFrame(queries, "item_id long, text string")
    for k in (1, 4):
        got = gram_index.bm25(q, index, k, n)
        assert got.columns == ["item_id", "doc_id", "score", "rank"]
        assert sorted(((r.item_id, r.doc_id, round(r.score, 5), r["rank"]) for r in got.collect()), key=repr) == plain(queries, docs, k, n)
    met, scored = gram_index.bm25_work(q, index, 1, n)
    assert 0 < scored <= met


def test_blocks_that_cannot_win_are_not_scored(spark, monkeypatch):
    monkeypatch.setattr(gram_index, "SAMPLE", 4)
    docs = [(i, f"common words {i % 7} " * 3) for i in range(2000)] + [(5000 + i, "the quick brown fox jumps") for i in range(6)]
    index = kept(gram_index.gram_index(spark.createDataFrame(docs, "doc_id long, text string").repartition(2)), "grams")
    q = spark.createDataFrame([(1, "quick brown fox words")], "item_id long, text string")
    met, scored = gram_index.bm25_work(q, index, 3)
    assert met > 20 and scored <= 4
    assert [r.doc_id for r in gram_index.bm25(q, index, 3).orderBy("rank").collect()] == [5000, 5001, 5002]


def test_nothing_to_find(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    q = spark.createDataFrame([("a", "some text")], "item_id string, text string")
    assert gram_index.bm25(q, gram_index.gram_index(none), 3).collect() == []
    docs = spark.createDataFrame([("x", "some text"), ("y", "some")], "doc_id string, text string")
    assert [(r.item_id, r.doc_id) for r in gram_index.bm25(q, gram_index.gram_index(docs), 3).orderBy("rank").collect()] == [("a", "x"), ("a", "y")]
    assert gram_index.bm25(q.where("false"), gram_index.gram_index(docs), 3).collect() == []
    only = gram_index.bm25(q.withColumn("text", q.text), gram_index.gram_index(docs), 3, max_chars=2)
    assert only.collect() == []


def test_modes(spark):
    docs = spark.createDataFrame([(1, "the quick fox", [1.0, 0.0]), (2, "lazy dogs sleep", [0.9, 0.1]), (3, "quick quick fox", [0.0, 1.0])], "vec_id long, text string, embedding array<float>")
    q = spark.createDataFrame([(9, "quick fox", [1.0, 0.1])], "query_id long, text string, embedding array<float>")
    index = gram_index.gram_index(docs, key="vec_id")
    best = lambda mode: [r.vec_id for r in retrieval.retrieve(q, 2, mode, index, docs).orderBy("rank").collect()]
    lexical = best("bm25")
    assert set(lexical) == {1, 3} and best("dense") == [2, 1] or best("dense") == [1, 2]
    assert best("hybrid")[0] == 1
    with pytest.raises(ValueError):
        retrieval.retrieve(q, 2, "other", index, docs)


def test_postings_take_few_bytes(spark):
    """Blocks as arrays of integers filled the executors of large tables (F12, F20)."""
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(corpus(5, 400))], "doc_id long, text string").repartition(1)
    index = gram_index.gram_index(docs)
    held = [(sum(len(r[c]) for c in ("starts", "places", "tfs")), len(gram_index.unpacked(gram_index.pa.scalar(bytes(r.places))))) for r in index.collect()]
    assert sum(n for _, n in held) > 10_000 and sum(b for b, _ in held) < 3 * sum(n for _, n in held)
    wide = kept(index, "grams", wide=True)
    q = spark.createDataFrame([(1, corpus(5, 400)[7][:40] or "abc")], "item_id long, text string")
    rows = lambda x: sorted(map(tuple, gram_index.bm25(q, x, 5).collect()))
    assert rows(wide) == rows(index)


def test_tasks_get_few_bytes_at_a_time(spark, monkeypatch):
    """Batches of up to 64 MB of texts and postings, several copies of each in every task, filled the executors of large tables (F12)."""
    blocks, scan, seen, name = gram_index._blocks, gram_index._scan, spark.sparkContext.accumulator(0), "spark.sql.execution.arrow.maxBytesPerBatch"

    def told(batches):
        for batch in batches:
            if batch.nbytes > 6 << 20:
                seen.add(1)
            yield batch

    monkeypatch.setattr(gram_index, "_blocks", lambda *a: lambda batches, f=blocks(*a): f(told(batches)))
    monkeypatch.setattr(gram_index, "_scan", lambda *a, **b: lambda batches, f=scan(*a, **b): f(told(batches)))
    before = spark.conf.get(name)
    docs = spark.createDataFrame([(i, "".join(chr(97 + (i * j * j) % 26) for j in range(500)) * 60) for i in range(400)], "doc_id long, text string").repartition(1)
    index = kept(gram_index.gram_index(docs), "grams", wide=True)
    found = gram_index.bm25(spark.createDataFrame([(1, "aaa bcd"), (2, "abc")], "item_id long, text string"), index, 3)
    assert found.count() > 0 and seen.value == 0 and spark.conf.get(name) == before
