"""Exact order statistics of groups of any size (AGG02).

The value at a rank is found by narrowing: a group's range is cut into ``BUCKETS`` equal parts, their weights are partial sums, and the part that holds the rank is the next range, from its least
value to its greatest. All groups and ranks go on at once, and a rank with at most ``limit`` different values left is read off in order. So what a task holds is
bounded, however many rows one group has; a round makes at most ``BUCKETS`` rows of each group and rank.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairloom.plans.shared import kept

BUCKETS, LIMIT = 256, 4096

RANKS: dict[str, Callable[[Column], Column]] = {
    "low": lambda n: F.floor((n - 1) / 2),
    "high": lambda n: F.floor(n / 2),
    "p95": lambda n: F.least(n - 1, F.floor(n * 0.95)),
}


def on(by: list[str], a: DataFrame, b: DataFrame) -> Column:
    """Equal groups, nulls being one."""
    return reduce(lambda x, y: x & y, [a[c].eqNullSafe(b[c]) for c in by], F.lit(True))


def counted(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """``by, value, weight``: the different values of each group."""
    return rows.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).cast("double").alias("value")).agg(F.count("*").alias("weight"))


def at_ranks(values: DataFrame, by: list[str], ranks: dict[str, Callable[[Column], Column]] = RANKS, limit: int = LIMIT) -> DataFrame:
    """``by`` and a column for each of ``ranks`` (a name, and the place from 0 as a function of the group's size) from the weighted different ``value`` of each group."""
    values = kept(values.select(*by, "value", "weight"), "percentile-values")
    sizes = values.groupBy(*by).agg(F.sum("weight").alias("n"), F.count("*").alias("left"), F.min("value").alias("lo"), F.max("value").alias("hi"))
    each = F.explode(F.array(*[F.struct(F.lit(name).alias("name"), place(F.col("n")).cast("long").alias("rank")) for name, place in ranks.items()]))
    state = kept(sizes.select(*by, each.alias("x"), "left", "lo", "hi").select(*by, "x.*", "left", "lo", "hi"), "percentile-ranks")
    open_ = (F.col("left") > limit) & (F.col("lo") < F.col("hi"))
    while state.where(open_).head(1):
        part = F.least(F.floor((F.col("value") - F.col("lo")) / (F.col("hi") - F.col("lo")) * BUCKETS), F.lit(BUCKETS - 1))
        within = _within(values, state.where(open_), by).withColumn("part", part)
        parts = within.groupBy(*by, "name", "rank", "part").agg(F.sum("weight").alias("w"), F.count("*").alias("left"), F.min("value").alias("lo"), F.max("value").alias("hi"))
        parts = parts.withColumn("upto", F.sum("w").over(Window.partitionBy(*by, "name").orderBy("part")))
        narrowed = parts.where((F.col("upto") > F.col("rank")) & (F.col("upto") - F.col("w") <= F.col("rank")))
        narrowed = narrowed.select(*by, "name", (F.col("rank") - F.col("upto") + F.col("w")).alias("rank"), "left", "lo", "hi")
        state = kept(state.where(~open_).unionByName(narrowed), "percentile-ranks")
    single = state.where("lo = hi").select(*by, "name", F.col("lo").alias("found"))
    rest = _within(values, state.where("lo < hi"), by).withColumn("upto", F.sum("weight").over(Window.partitionBy(*by, "name").orderBy("value")))
    rest = rest.where(F.col("upto") > F.col("rank")).groupBy(*by, "name").agg(F.min("value").alias("found"))
    found = single.unionByName(rest)
    return found.groupBy(*by).agg(*[F.max(F.when(F.col("name") == name, F.col("found"))).alias(name) for name in ranks])


def _within(values: DataFrame, state: DataFrame, by: list[str]) -> DataFrame:
    """The values in the range of each rank that is left."""
    inside = (values["value"] >= state["lo"]) & (values["value"] <= state["hi"])
    return values.join(state, on(by, values, state) & inside).select(*[values[c] for c in by], "name", "rank", "lo", "hi", "value", "weight")


def statistics(rows: DataFrame, by: list[str], rates: list[str], limit: int = LIMIT) -> DataFrame:
    """``by`` and the ``_median`` and ``_p95`` of each rate; the percentile is the nearest rank at floor(0.95 n)."""
    stacked = rows.select(*by, F.explode(F.array(*[F.struct(F.lit(r).alias("rate"), F.col(r).cast("double").alias("value")) for r in rates])).alias("x")).select(*by, "x.*")
    found = at_ranks(counted(stacked, [*by, "rate"], "value"), [*by, "rate"], limit=limit)
    of = lambda r, c: F.max(F.when(F.col("rate") == r, c))
    middle = (F.col("low") + F.col("high")) / 2
    return found.groupBy(*by).agg(*[x for r in rates for x in (of(r, middle).alias(f"{r}_median"), of(r, F.col("p95")).alias(f"{r}_p95"))])
