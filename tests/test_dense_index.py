"""The dense index against the exact search."""

import numpy as np
import pytest

from pairloom.operators import dense_index, retrieval
from pairloom.plans.shared import kept


def vectors(spark, seed, n, width=24, clusters=None):
    r = np.random.default_rng(seed)
    x = r.normal(size=(n, width)) if clusters is None else r.normal(size=(clusters, width))[r.integers(0, clusters, n)] + 0.2 * r.normal(size=(n, width))
    rows = [(i, [float(y) for y in v]) for i, v in enumerate(x)]
    odd = [(n, None), (n + 1, []), (n + 2, [0.0] * width), (n + 3, [float("nan")] * width), (n + 4, [1.0]), (n + 5, [None] + [1.0] * (width - 1)), (n + 6, rows[0][1])]
    return spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>").repartition(4)


@pytest.mark.parametrize("clusters", [None, 30])
def test_tuned_recall(spark, monkeypatch, clusters):
    monkeypatch.setattr(dense_index, "QUERIES", 40)
    e = vectors(spark, 3, 2500, clusters=clusters)
    q = e.where("vec_id % 25 = 0").withColumnRenamed("vec_id", "query_id")
    quantiser = dense_index.train(e, lists=40)
    index = kept(dense_index.dense_index(e, quantiser), "index")
    assert index.count() == 2501 and index.select("list").distinct().count() <= 40
    probe, pool, found = dense_index.tuned(q, e, index, quantiser, 5)
    assert found >= 0.95 and (clusters is None or probe <= 10)
    got = dense_index.near(q, index, quantiser, 5, probe, pool)
    assert got.columns == ["query_id", "vec_id", "score", "rank"] and got.where("query_id = vec_id").count() == 0
    assert dense_index.recall(got, retrieval.dense(q, e.where("vec_id < 2500 OR vec_id = 2506"), 5)) >= 0.93
    whole = {(r.query_id, r.vec_id): (round(r.score, 5), r["rank"]) for r in dense_index.near(q, index, quantiser, 5, 40, 2600).collect()}
    exact = {(r.query_id, r.vec_id): (round(r.score, 5), r["rank"]) for r in retrieval.dense(q, e.where("vec_id < 2500 OR vec_id = 2506"), 5).collect()}
    assert whole == exact


def test_few_or_no_vectors(spark):
    e = vectors(spark, 1, 3, 4)
    quantiser = dense_index.train(e)
    index = dense_index.dense_index(e, quantiser)
    q = e.where("vec_id = 0").withColumnRenamed("vec_id", "query_id")
    assert [r.vec_id for r in dense_index.near(q, index, quantiser, 1).collect()] == [9]  # a copy of the query's vector
    assert dense_index.near(q.where("false"), index, quantiser, 1).collect() == []
    assert dense_index.train(e.where("vec_id IN (3, 4, 5)")) is None and dense_index.train(e.where("false")) is None
    assert dense_index.recall(q, q.where("false"), "query_id", "query_id") == 1.0
