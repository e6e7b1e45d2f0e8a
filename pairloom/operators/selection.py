"""Picks for tests, examples and prompt development (SMP02-SMP04, FLT08, FLT10, FLT12), means over normal samples (FLT03, AGG28), and rankings (TOP04, TOP06).

Order within a pool is that of the md5 of seed and id, as in ``sampling``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairloom.functions.classify import difficulty, training_class
from pairloom.operators.pairs import RUNAWAY
from pairloom.operators.sampling import SEED, shuffled, stratified
from pairloom.plans.shared import kept

# Pools of prompt development and how many of each a full pick of 300 takes; bounds of the strata of examples.
DEV_TARGETS = {"degraded_real": 80, "false_positive": 40, "unfixed_hard": 40, "runaway": 40, "improved": 40, "perfect": 20, "correct_ocr": 40}
EXAMPLE_STRATA = (0.05, 0.15, 0.35)


def fit_for_examples(rows: DataFrame, least: int, most: int, ratio: float = RUNAWAY) -> DataFrame:
    """Rows whose reference has ``least`` to ``most`` characters and whose OCR text is no runaway."""
    size = F.length("gt_text")
    return rows.where(size.between(least, most) & (F.length("ocr_text") <= ratio * F.greatest(size, F.lit(1))))


def by_number(rows: DataFrame, key: str, numbers: DataFrame, inside: bool = True) -> DataFrame:
    """Rows whose id ends in one of the numbers (``n``) after its font prefix, or all others; an id without a number is in none."""
    numbered = rows.withColumn("_n", F.nullif(F.regexp_extract(key, "_([0-9]+)$", 1), F.lit("")).cast("long"))
    return numbered.join(numbers.select(F.col("n").cast("long").alias("_n")).distinct(), "_n", "left_semi" if inside else "left_anti").select(*rows.columns)


def single_page(rows: DataFrame, pages: str = "pages") -> DataFrame:
    return rows.where(F.size(pages) == 1)


def mean_over_normal(rows: DataFrame, key: str, empty: float | None = 0.0) -> DataFrame:
    """``key, n, cer, wer`` of each data set over its normal samples, and the mean over data sets (key null), each set counting once.

    Unlike elsewhere an empty reference is no normal sample here. Sets without one have the value ``empty``."""
    normal = (F.col("chars") > 0) & (F.col("length_ratio") <= RUNAWAY)
    mean = lambda c: F.coalesce(F.avg(F.when(normal, F.col(c))), F.lit(empty).cast("double")).alias(c)
    rates = [c for c in ("cer", "wer") if c in rows.columns]
    each = rows.groupBy(key).agg(F.count_if(normal).alias("n"), *[mean(c) for c in rates])
    return each.unionByName(each.agg(F.lit(None).cast("string").alias(key), F.sum("n").alias("n"), *[F.avg(c).alias(c) for c in rates]))


def degraded_then_hard(rows: DataFrame, n: int, hard: float = 0.05) -> DataFrame:
    """The ``n`` worst of the degraded samples by how much they lost, then the ``n`` hardest of the unchanged ones by their OCR error rate, if that is over ``hard``; ``turn, rank`` give the order.

    What the rankings need is written once, as texts cost far more to compare than rows to read again."""
    rows = kept(rows, "ranked-samples")
    sorted_by = lambda kind, turn, by: (
        rows.where((training_class(F.col("cer_ocr"), F.col("cer_llm")) == kind) & (F.lit(turn == 0) | (F.col("cer_ocr") > hard))).orderBy(F.desc(by), "sample_id").limit(n)
        .withColumn("turn", F.lit(turn)).withColumn("rank", F.row_number().over(Window.partitionBy("turn").orderBy(F.desc(by), "sample_id")))
    )
    return sorted_by("degraded", 0, "cer_delta").unionByName(sorted_by("unchanged", 1, "cer_ocr"))


def loader_order(stem: Column) -> list[Column]:
    """Sort keys for stems: numbers by value first, then all other names."""
    number = F.when(stem.rlike("^[0-9]+$"), stem.cast("decimal(38,0)"))
    return [number.isNull(), number, stem]


def aligned_pick(rows: DataFrame, font: str, index: str, targets: dict[str, int], extra: DataFrame | None = None, share: float = 0.1, seed: int = SEED) -> DataFrame:
    """Indices that every font has, drawn by the difficulty of their mean error rate (``cer``), and the rows of all fonts for them; of ``extra`` rows
    (``sample_id``) a share of that many more."""
    fonts = rows.where(F.col(font).isNotNull()).select(font).distinct().count()
    common = rows.groupBy(index).agg(F.countDistinct(font).alias("_fonts"), F.avg("cer").alias("mean_cer")).where(F.col("_fonts") == fonts).drop("_fonts")
    picked = stratified(common.withColumn("difficulty", difficulty(F.col("mean_cer"))), "difficulty", targets, index, seed=seed)
    out = rows.join(picked.select(index, "difficulty", "mean_cer"), index)
    if extra is None:
        return out
    more = extra.orderBy(shuffled(F.col("sample_id"), seed), "sample_id").limit(int(share * fonts * sum(targets.values())))
    return out.unionByName(more, allowMissingColumns=True)


def example_stratum(cer: Column) -> Column:
    """One of four strata of the error rate, 0 to 3."""
    out = F.lit(len(EXAMPLE_STRATA))
    for k, most in reversed(list(enumerate(EXAMPLE_STRATA))):
        out = F.when(cer <= most, k).otherwise(out)
    return out


def few_shot_pick(rows: DataFrame, n: int, excluded: DataFrame | None = None, least: int = 10, most: int = 200, seed: int = SEED) -> DataFrame:
    """``n`` examples (``sample_id, gt_text, ocr_text, cer``) dealt evenly over the strata that have any, none of ``excluded``; correct texts are no examples."""
    pool = fit_for_examples(rows, least, most).where("cer > 0")
    if excluded is not None:
        pool = pool.join(excluded.select("sample_id").distinct(), "sample_id", "left_anti")
    ranked = pool.withColumn("stratum", example_stratum(F.col("cer")))
    turn = F.row_number().over(Window.partitionBy("stratum").orderBy(shuffled(F.col("sample_id"), seed), "sample_id"))
    return ranked.withColumn("turn", turn).where(F.col("turn") <= n).orderBy("turn", "stratum").limit(n)


def dev_pick(rows: DataFrame, bucket: str, total: int = 300, seed: int = SEED) -> DataFrame:
    """A pick for prompt development: each pool's target, in proportion to ``total``."""
    whole = sum(DEV_TARGETS.values())
    return stratified(rows, bucket, {k: round(n * total / whole) for k, n in DEV_TARGETS.items()}, "sample_id", seed=seed)
