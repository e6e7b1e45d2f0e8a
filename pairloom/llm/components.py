"""Connected components by hooking and contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairloom.llm.store import written


def components(links: DataFrame, name: str = "components") -> DataFrame:
    """``id, component`` of each node of ``links`` (``a, b`` longs, any order): the smallest id reachable.

    Each round hooks every node to its smallest neighbour if that is smaller, and contracts; a round at least halves what is not finished. The
    rounds' tables are written to the shared folder, and sums over a node's links are partial first, so that a hub is no task of its own.
    """
    edges = written(_tidy(links), f"{name}-edges")
    labels = edges.select(F.explode(F.array("a", "b")).alias("id")).distinct().select("id", F.col("id").alias("component"))
    while edges.head(1):
        hooks = written(edges.groupBy("b").agg(F.min("a").alias("parent")), f"{name}-hooks")
        labels = written(labels.join(hooks, labels.component == hooks.b, "left").select("id", F.coalesce("parent", "component").alias("component")), f"{name}-labels")
        to_a, to_b = hooks.select(F.col("b").alias("a"), F.col("parent").alias("pa")), hooks.select("b", F.col("parent").alias("pb"))
        moved = edges.join(to_a, "a", "left").select(F.coalesce("pa", "a").alias("a"), "b").join(to_b, "b", "left").select("a", F.coalesce("pb", "b").alias("b"))
        edges = written(_tidy(moved), f"{name}-edges")
    return labels


def _tidy(links: DataFrame) -> DataFrame:
    return links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
