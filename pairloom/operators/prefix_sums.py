"""Running totals and positions within groups of any size (WIN01), in two levels.

A window over a group puts the group's whole order in one task. Here rows are dealt by ranges of (group, order); each range is summed on its own, the sums of the ranges before it in its group (a
row for each group and range) are its offset, and a window runs within one range only. A group with most of the rows is as many tasks as it has ranges.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pairloom.operators.percentiles import on
from pairloom.plans.shared import kept


def running_totals(rows: DataFrame, by: list[str], order: list[str], totals: dict[str, str], ranges: int | None = None) -> DataFrame:
    """``rows`` with a column for each of ``totals`` (name, and the column to sum): the sum over the rows of its group up to and with itself in ``order``.

    Rows of a group with equal ``order`` are in no set order. Null groups are groups; a null order comes first; a null to sum is 0."""
    n = ranges or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = kept(rows.repartitionByRange(n, *by, *order).withColumn("_range", F.spark_partition_id()), "running-rows")
    sums = dealt.groupBy(*by, "_range").agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(f"_{name}") for name, c in totals.items()])
    before = Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = kept(sums.select(*by, "_range", *[F.coalesce(F.sum(f"_{name}").over(before), F.lit(0)).alias(f"_{name}") for name in totals]), "running-offsets")
    within = Window.partitionBy(*by, "_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    own = dealt.select("*", *[F.coalesce(F.sum(c).over(within), F.lit(0)).alias(name) for name, c in totals.items()])
    joined = own.join(offsets, on([*by, "_range"], own, offsets))
    return joined.select(*[own[c] for c in rows.columns if c not in totals], *[(own[name] + offsets[f"_{name}"]).alias(name) for name in totals])


def positions(rows: DataFrame, by: list[str], order: list[str], name: str = "position", ranges: int | None = None) -> DataFrame:
    """``rows`` with their place from 0 within their group."""
    counted = running_totals(rows.withColumn("_one", F.lit(1)), by, order, {name: "_one"}, ranges)
    return counted.withColumn(name, F.col(name) - 1).drop("_one")
