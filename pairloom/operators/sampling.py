"""Deterministic samples and leakage-safe splits (SMP01, SMP05-SMP11, FLT06, FLT11).

Order is that of the md5 of seed and id, which any engine can repeat; no rows are collected."""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairloom.functions.classify import difficulty
from pairloom.operators.percentiles import on
from pairloom.operators.prefix_sums import positions
from pairloom.plans.shared import kept

SEED = 42
SHARES = {"correct": 10, "easy": 10, "medium": 40, "hard": 40}  # percent
MIX = {"correct": 5, "easy": 5, "medium": 10, "hard": 5}


def shuffled(key: Column, seed: int = SEED) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), key.cast("string")))


def stratified(rows: DataFrame, stratum: str, targets: dict[str, int], key: str, diversity: str | None = None, seed: int = SEED) -> DataFrame:
    """As many rows of each stratum as its target; with ``diversity`` one of each of its values first, then the rest."""
    draw = shuffled(F.col(key), seed)
    rows = rows.withColumn("_draw", draw)
    turn = F.row_number().over(Window.partitionBy(stratum, diversity).orderBy("_draw", key)) if diversity else F.lit(1)
    rows = rows.withColumn("_later", (turn > 1).cast("int")).withColumn("_k", F.row_number().over(Window.partitionBy(stratum).orderBy("_later", "_draw", key)))
    most = F.lit(0)
    for name, n in targets.items():
        most = F.when(F.col(stratum) == name, F.lit(n)).otherwise(most)
    # the fixed limit is one that Spark applies before it shuffles rows to their stratum's task
    return rows.where(F.col("_k") <= max(targets.values(), default=0)).where(F.col("_k") <= most).drop("_draw", "_later", "_k")


def split_by_ratio(rows: DataFrame, key: str, group: list[str], ratio: float, pinned: DataFrame | None = None, seed: int = SEED) -> DataFrame:
    """Adds ``split``: pinned keys are validation, and so is as much of the rest of each group as makes ``ratio`` of it. Places are found in two levels, as in ``validation_split``."""
    marked = rows if pinned is None else rows.join(pinned.select(key).distinct().withColumn("_pin", F.lit(1)), key, "left")
    pin = F.lit(0) if pinned is None else F.coalesce("_pin", F.lit(0))
    marked = marked.withColumn("_free", 1 - pin).withColumn("_draw", shuffled(F.col(key), seed))
    sizes = kept(marked.groupBy(*group).agg(F.count("*").alias("_n")), "split-sizes")
    placed = positions(marked, group, ["_free", "_draw", key], "_place")
    val = (placed["_free"] == 0) | (placed["_place"] < F.floor(sizes["_n"] * ratio))
    return placed.join(sizes, on(group, placed, sizes)).select(*[placed[c] for c in rows.columns], F.when(val, "val").otherwise("train").alias("split"))


def targets_of(n: int, percent: dict[str, int] = SHARES) -> dict[str, int]:
    """How many of ``n`` each stratum gets by its percentage (rounded half to even); the last one gets the rest."""
    names = list(percent)
    out = {name: round(n * percent[name] / 100) for name in names[:-1]}
    return out | {names[-1]: n - sum(out.values())}


def by_difficulty(rows: DataFrame, targets: dict[str, int] | int, key: str = "sample_id", diversity: tuple[str, ...] = ("font", "dataset"), min_chars: int = 5, seed: int = SEED) -> DataFrame:
    """Samples of each difficulty, those of different fonts first (where there is none, of different data sets), from rows as ``pairs.scored`` gives them; near-empty references and runaways take no
    part. ``targets`` are numbers by difficulty, or one number that is shared out by ``SHARES``."""
    fit = rows.where((F.col("chars") >= min_chars) & ~F.col("is_runaway")).withColumn("difficulty", difficulty(F.col("cer"))).withColumn("_of", F.coalesce(*diversity))
    return stratified(fit, "difficulty", targets_of(targets) if isinstance(targets, int) else targets, key, "_of", seed).drop("_of")


def prompt_mix(rows: DataFrame, key: str = "sample_id", seed: int = SEED) -> DataFrame:
    """The examples that a prompt is crafted from: ``MIX`` of each difficulty."""
    return by_difficulty(rows, MIX, key, seed=seed)


def validation_split(rows: DataFrame, key: str, group: list[str], ratio: float, pinned: DataFrame | None = None, empty: str | None = None, seed: int = SEED) -> DataFrame:
    """Adds ``split``. Of each group ``ratio`` (rounded half to even, one at least) is validation: pinned keys always, and as many others in hashed order as are missing; of these others, those
    that are ``empty`` (a boolean column) go back to training without a substitute. Places are found in two levels, so a group of any size is no task of its own."""
    marked = rows.withColumn("_pin", F.lit(False))
    if pinned is not None:
        marked = rows.join(pinned.select(key).distinct().withColumn("_pin", F.lit(True)), key, "left").withColumn("_pin", F.coalesce("_pin", F.lit(False)))
    sizes = kept(marked.groupBy(*group).agg(F.count("*").alias("_n"), F.count_if("_pin").alias("_pins")), "split-sizes")
    placed = positions(marked.withColumn("_draw", shuffled(F.col(key), seed)), [*group, "_pin"], ["_draw", key], "_place")
    joined = placed.join(sizes, on(group, placed, sizes)).select(*[placed[c] for c in (*rows.columns, "_pin", "_place")], "_n", "_pins")
    wanted = F.greatest(F.lit(1), F.bround(F.col("_n") * ratio)) - F.col("_pins")
    extra = ~F.col("_pin") & (F.col("_place") < wanted) & (F.lit(True) if empty is None else ~F.coalesce(F.col(empty), F.lit(False)))
    return joined.withColumn("split", F.when(F.col("_pin") | extra, "val").otherwise("train")).select(*rows.columns, "split")


def aligned_split(rows: DataFrame, index: str, source: str, ratio: float, pinned: DataFrame | None = None, empty: str | None = None, seed: int = SEED) -> DataFrame:
    """Adds ``split`` to rows whose ``index`` every ``source`` has (the others are left out), the same for all sources of an index. An index is empty where any source's row is."""
    n = rows.select(source).distinct().count()
    blank = F.lit(False) if empty is None else F.coalesce(F.bool_or(empty), F.lit(False))
    common = rows.groupBy(index).agg(F.countDistinct(source).alias("_k"), blank.alias("_blank")).where(F.col("_k") == n).select(index, "_blank")
    held = None if pinned is None else pinned.select(index).distinct().join(common.select(index), index, "left_semi")
    split = validation_split(common, index, [], ratio, held, "_blank", seed).select(index, "split")
    return rows.join(split, index)


def single_page_split(training: DataFrame, testing: DataFrame, key: str, pages: str, text: str, n: int = 200, seed: int = SEED) -> DataFrame:
    """``key, split``: training documents of one page, and ``n`` (0: all) of the testing documents of one page whose text has no word in Latin letters."""
    test = testing.where((F.size(pages) == 1) & F.col(text).isNotNull() & ~F.col(text).rlike("[a-zA-Z]{2,}")).select(key)
    test = drawn(test, key, n, seed) if n > 0 else test
    return training.where(F.size(pages) == 1).select(key, F.lit("training").alias("split")).unionByName(test.withColumn("split", F.lit("testing")))


def split_by_overlap(rows: DataFrame, reserved: DataFrame, key: str) -> DataFrame:
    """Rows whose key the reserved set has are validation, the others training."""
    held = reserved.select(key).distinct().withColumn("_r", F.lit(1))
    return rows.join(held, key, "left").withColumn("split", F.when(F.col("_r") == 1, "val").otherwise("train")).drop("_r")


def drawn(rows: DataFrame, key: str, n: int, seed: int = SEED) -> DataFrame:
    return rows.orderBy(shuffled(F.col(key), seed), key).limit(n)


def train_and_dev(rows: DataFrame, key: str, train: int = 50, dev: int = 20, seed: int = SEED) -> DataFrame:
    """``train`` rows and the ``dev`` next ones of the shuffled table, marked in ``split``; where there are too few, training is filled first."""
    taken = rows.orderBy(shuffled(F.col(key), seed), key).limit(train + dev)
    place = F.row_number().over(Window.orderBy(shuffled(F.col(key), seed), key))
    return taken.withColumn("_k", place).withColumn("split", F.when(F.col("_k") <= train, "train").otherwise("dev")).drop("_k")


def compat_shuffle(ids: list[str], seed: int = SEED) -> list[str]:
    """The order of a seeded shuffle of a small pool on the driver, for exact parity with older selections."""
    out = list(ids)
    random.Random(seed).shuffle(out)
    return out
