"""Before and after a correction: outcomes, impact, reports, training buckets (AGG05, AGG13-AGG15, AGG19-AGG22, AGG27, AGG30-AGG33, AGG35, TOP02, TOP05, KB06)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairloom.functions.classify import CATEGORIES, TYPED, insight_kind, outcome, sample_category, training_class
from pairloom.functions.edit import char_error_counts, distance, error_rate
from pairloom.functions.text import normalise
from pairloom.operators.pairs import all_rates
from pairloom.operators.percentiles import at_ranks, counted, on
from pairloom.operators.prefix_sums import running_totals
from pairloom.plans.shared import kept


def _judged(corrections: DataFrame) -> DataFrame:
    """Corrections that succeeded (null: they did) and have a reference; a null corrected text is the OCR text."""
    rows = corrections.withColumn("corrected_text", F.coalesce("corrected_text", "ocr_text"))
    if "success" in rows.columns:
        rows = rows.where(F.coalesce("success", F.lit(True)))
    return rows.where(F.coalesce(F.col("gt_text"), F.lit("")) != "")


def compared(corrections: DataFrame) -> DataFrame:
    """Adds ``length_ratio`` (of the OCR text), ``cer_ocr``, ``cer_llm``, ``cer_delta``, ``outcome``, ``category`` to corrections; failed ones and empty references are left out.

    A null corrected text stands for the OCR text and a null success for true."""
    rows = _judged(corrections)
    # each text is normalised once, and a text that was left as it was is not compared again
    rows = rows.withColumn("_g", normalise(F.col("gt_text"))).withColumn("_o", normalise(F.col("ocr_text"))).withColumn("_c", normalise(F.col("corrected_text")))
    rows = rows.withColumn("length_ratio", F.length("_o") / F.greatest(F.length("_g"), F.lit(1)))
    rows = rows.withColumn("cer_ocr", error_rate(distance(F.col("_g"), F.col("_o")), F.length("_g")))
    rows = rows.withColumn("cer_llm", F.when(F.col("_c") == F.col("_o"), F.col("cer_ocr")).otherwise(error_rate(distance(F.col("_g"), F.col("_c")), F.length("_g")))).drop("_g", "_o", "_c")
    rows = rows.withColumn("cer_delta", F.col("cer_llm") - F.col("cer_ocr")).withColumn("outcome", outcome(F.col("cer_ocr"), F.col("cer_llm")))
    return rows.withColumn("category", sample_category(F.col("ocr_text"), F.col("corrected_text"), F.col("gt_text"), F.col("cer_ocr"), F.col("cer_llm")))


def category_counts(rows: DataFrame) -> DataFrame:
    """All nine categories in their order, zeros included."""
    order = rows.sparkSession.createDataFrame(list(enumerate(CATEGORIES)), "ord int, category string")
    return order.join(rows.groupBy("category").agg(F.count("*").alias("n")), "category", "left").select("ord", "category", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def outcome_summary(rows: DataFrame, by: list[str]) -> DataFrame:
    counts = [F.count_if(F.col("outcome") == x).alias(x) for x in ("improved", "regressed", "unchanged")]
    return rows.groupBy(*by).agg(F.count("*").alias("n"), *counts, F.avg("cer_ocr").alias("cer_ocr"), F.avg("cer_llm").alias("cer_llm"))


def rate_summary(corrections: DataFrame, by: list[str]) -> DataFrame:
    """Outcome counts of each group and the means of its four rates: characters and words, before and after, without diacritics and (``_raw``) with them."""
    rows = all_rates(_judged(corrections), by)
    names = [c for c in rows.columns if c not in by]
    rows = rows.withColumn("outcome", outcome(F.col("cer_ocr_raw"), F.col("cer_llm_raw")))
    counts = [F.count_if(F.col("outcome") == x).alias(x) for x in ("improved", "regressed", "unchanged")]
    return rows.groupBy(*by).agg(F.count("*").alias("n"), *counts, *[F.avg(c).alias(c) for c in names])


def extremes(rows: DataFrame, regressed: int = 40, improved: int = 20) -> DataFrame:
    """The samples that lost most and gained most, as the report shows them; ties by id. Rows are written once, as their texts cost far more to compare than they to read again."""
    rows = kept(rows, "extremes")
    worst = rows.where("outcome = 'regressed'").orderBy(F.desc("cer_delta"), "sample_id").limit(regressed)
    best = rows.where("outcome = 'improved'").orderBy("cer_delta", "sample_id").limit(improved)
    return worst.unionByName(best)


def training_buckets(rows: DataFrame) -> DataFrame:
    """Counts of each training class, of all datasets (null) and of each."""
    return rows.withColumn("bucket", training_class(F.col("cer_ocr"), F.col("cer_llm"))).rollup("dataset").agg(F.count("*").alias("n"), *[F.count_if(F.col("bucket") == x).alias(x) for x in ("perfect", "degraded", "unchanged", "improved")])


def training_metrics(corrections: DataFrame) -> DataFrame:
    """``dataset`` (null: all), ``diacritics, text, rate, n, mean, median, std, p95``: eight families of rates of OCR texts and corrections.

    A null correction stands for the OCR text. The percentile is the nearest rank at ``floor(0.95 n)``; the deviation of one sample is 0."""
    rows = all_rates(corrections, ["dataset"])
    found = [(marks, t, r, f"{r}_{t}{'_raw' * marks}") for marks in (False, True) for t in ("ocr", "llm") for r in ("cer", "wer")]
    each = F.array(*[F.struct(F.lit(d).alias("diacritics"), F.lit(t).alias("text"), F.lit(r).alias("rate"), F.col(c).alias("value")) for d, t, r, c in found])
    values = rows.select("dataset", F.explode(each).alias("x")).select("dataset", "x.*")
    family = ["dataset", "diacritics", "text", "rate"]
    values = kept(counted(values, family, "value"), "training-values")  # so that texts are compared once for both groupings
    values = values.unionByName(values.groupBy(*family[1:], "value").agg(F.sum("weight").alias("weight")).withColumn("dataset", F.lit(None).cast("string")))
    # the deviation from the sums of squares, as all groups are summed in one pass
    n, s, ss = F.sum("weight"), F.sum(F.col("weight") * F.col("value")), F.sum(F.col("weight") * F.col("value") * F.col("value"))
    sums = values.groupBy(*family).agg(n.alias("n"), (s / n).alias("mean"), F.when(n > 1, F.sqrt(F.greatest(F.lit(0.0), (ss - s * s / n) / (n - 1)))).otherwise(0.0).alias("std"))
    places = at_ranks(values, family)
    return sums.join(places, on(family, sums, places)).select(*[sums[c] for c in (*family, "n", "mean")], ((F.col("low") + F.col("high")) / 2).alias("median"), "std", "p95")


def _typed(corrections: DataFrame) -> DataFrame:
    """Adds ``before`` and ``after``, counts of errors by type (in the order of ``TYPED``) of the OCR text and its correction.

    A text equal to its reference is sent to Python as null and counts as free of errors, and one that the correction left as it was is aligned once."""
    rows = corrections.withColumn("_g", normalise(F.col("gt_text"))).withColumn("_o", normalise(F.col("ocr_text"))).withColumn("_c", normalise(F.coalesce("corrected_text", "ocr_text")))
    wrong, changed = F.col("_g") != F.col("_o"), (F.col("_g") != F.col("_c")) & (F.col("_o") != F.col("_c"))
    none = F.array_repeat(F.lit(0), len(TYPED))
    before = char_error_counts(F.when(wrong, F.col("_g")), F.when(wrong, F.col("_o")))
    after = char_error_counts(F.when(changed, F.col("_g")), F.when(changed, F.col("_c")))
    rows = rows.withColumn("before", F.coalesce(before, none)).withColumn("_a", after)
    return rows.withColumn("after", F.when(F.col("_o") == F.col("_c"), F.col("before")).otherwise(F.coalesce("_a", none))).drop("_g", "_o", "_c", "_a")


def _step(b: Column, r: Column) -> list[Column]:
    return [F.greatest(F.lit(0), b - r), F.greatest(F.lit(0), r - b)]


def _by_type(rows: DataFrame, keep: list[str]) -> DataFrame:
    each = [F.struct(F.lit(k).alias("error_type"), F.col("before")[n].alias("baseline"), F.col("after")[n].alias("residual")) for n, k in enumerate(TYPED)]
    return rows.select(*keep, F.explode(F.array(*each)).alias("x")).select(*keep, "x.*")


def sample_changes(corrections: DataFrame, key: list[str]) -> DataFrame:
    """``key, error_type, baseline, residual, fixed, introduced`` of every sample and type, zeros included."""
    fixed, introduced = _step(F.col("baseline"), F.col("residual"))
    return _by_type(_typed(corrections), key).withColumn("fixed", fixed).withColumn("introduced", introduced)


def error_changes(corrections: DataFrame, by: list[str], cumulative: bool = False) -> DataFrame:
    """``by, error_type, baseline, residual, fixed, introduced`` and their rates (null where nothing was wrong before).

    Fixed and introduced are sums over samples of what got less and what got more, summed without a row for each type. ``cumulative`` compares
    running totals after each sample (in order of ``ord``) instead, as older reports did."""
    rows = _typed(corrections)
    if cumulative:
        stacked = running_totals(_by_type(rows, [*by, "ord"]), [*by, "error_type"], ["ord"], {"cb": "baseline", "cr": "residual"})
        fixed, introduced = _step(F.col("cb"), F.col("cr"))
        out = stacked.groupBy(*by, "error_type").agg(F.sum("baseline").alias("baseline"), F.sum("residual").alias("residual"), F.sum(fixed).alias("fixed"), F.sum(introduced).alias("introduced"))
    else:
        sums = []
        for n, k in enumerate(TYPED):
            b, r = F.col("before")[n], F.col("after")[n]
            fixed, introduced = _step(b, r)
            sums.append(F.struct(F.lit(k).alias("error_type"), F.sum(b).alias("baseline"), F.sum(r).alias("residual"), F.sum(fixed).alias("fixed"), F.sum(introduced).alias("introduced")))
        out = rows.groupBy(*by).agg(F.array(*sums).alias("x")).select(*by, F.explode("x").alias("x")).select(*by, "x.*")
    return out.withColumn("fix_rate", F.try_divide("fixed", "baseline")).withColumn("introduction_rate", F.try_divide("introduced", "baseline"))


def change_summary(changes: DataFrame, by: list[str]) -> DataFrame:
    """``by, error_type, baseline, fixed, introduced, fix_rate, introduction_rate`` of ``error_changes``: a row for each type and one (null) for all of a
    group; rates have four places and are null where nothing was wrong before."""
    sums = [F.sum(c).alias(c) for c in ("baseline", "fixed", "introduced")]
    whole = changes.groupBy(*by).agg(*sums).withColumn("error_type", F.lit(None).cast("string"))
    rows = changes.select(*by, "error_type", "baseline", "fixed", "introduced").unionByName(whole)
    return rows.withColumn("fix_rate", F.round(F.try_divide("fixed", "baseline"), 4)).withColumn("introduction_rate", F.round(F.try_divide("introduced", "baseline"), 4))


def insights_text(changes: DataFrame, by: list[str], least: int = 10, strong: float = 0.6, weak: float = 0.4, harm: float = 0.05, weaknesses: int = 3, harms: int = 2) -> DataFrame:
    """``by, text`` for prompts: the types that are mended least and harmed most, a line each, worst first (ties by name), then those mended well.

    A type counts from ``least`` errors on; a group without any such type has an empty text."""
    enough = F.col("baseline") >= least
    lines = lambda keep, rank, form, n: F.transform(F.slice(F.array_sort(F.filter(F.collect_list(F.when(enough & keep, F.struct(rank.alias("k"), "error_type", form.alias("line")))), lambda x: x.isNotNull())), 1, n), lambda x: x["line"])
    percent = lambda c: F.round(F.col(c) * 100).cast("int")
    poor = lines(F.col("fix_rate") < weak, F.col("fix_rate"), F.format_string("- %s: %d%% mended", "error_type", percent("fix_rate")), weaknesses)
    worse = lines(F.col("introduction_rate") > harm, -F.col("introduction_rate"), F.format_string("- %s: %d%% new errors", "error_type", percent("introduction_rate")), harms)
    good = lines(F.col("fix_rate") > strong, -F.col("fix_rate"), F.format_string("- %s: %d%% mended", "error_type", percent("fix_rate")), len(TYPED))
    part = lambda label, c: F.when(F.size(c) > 0, F.concat(F.lit(f"{label}\n"), F.array_join(c, "\n")))
    texts = changes.groupBy(*by).agg(poor.alias("_poor"), worse.alias("_worse"), good.alias("_good"))
    return texts.select(*by, F.concat_ws("\n", part("Weak:", F.col("_poor")), part("Over-corrected:", F.col("_worse")), part("Strong:", F.col("_good"))).alias("text"))


def insights(changes: DataFrame, by: list[str]) -> DataFrame:
    """Each error type's kind: strength, weakness, over-correction or null."""
    return changes.select(*by, "error_type", "baseline", "fix_rate", "introduction_rate", insight_kind(F.col("fix_rate"), F.col("introduction_rate"), F.col("baseline")).alias("kind"))


def impact(rows: DataFrame, by: list[str], band: float = 0.01) -> DataFrame:
    """Improved, unchanged and worsened beyond a band, the best and worst sample, and the mean."""
    d = F.col("cer_delta")
    return rows.groupBy(*by).agg(
        F.count_if(d < -band).alias("improved"), F.count_if(F.abs(d) <= band).alias("unchanged"), F.count_if(d > band).alias("worsened"),
        F.min_by("sample_id", F.struct("cer_delta", "sample_id")).alias("best"), F.min_by("sample_id", F.struct(-d, "sample_id")).alias("worst"), F.avg("cer_delta").alias("mean_delta"),
    )


def severity(rows: DataFrame, band: float = 1e-6) -> DataFrame:
    """How far corrections moved: bands of 0.1, and ``same`` up to ``band`` either way."""
    d = F.col("cer_delta")
    band_ = F.when(F.abs(d) <= band, "same").when(d <= -0.1, "large gain").when(d < 0, "gain").when(d < 0.1, "loss").otherwise("large loss")
    return rows.groupBy(band_.alias("severity")).agg(F.count("*").alias("n"))


def prompt_evaluation(rows: DataFrame, by: list[str], band: float = 1e-6, large: float = 0.1) -> DataFrame:
    """What a prompt did to each group: mean rates before and after, their difference (positive: better) and its share, how many samples improved, regressed
    and stayed (within ``band``), these as percentages, and how many moved by ``large`` or more."""
    gain = -F.col("cer_delta")
    better, worse = gain > band, gain < -band
    counts = {"improved": better, "regressed": worse, "unchanged": ~better & ~worse, "large_improve": better & (gain >= large), "small_improve": better & (gain < large), "small_regress": worse & (-gain < large), "large_regress": worse & (-gain >= large)}
    out = rows.groupBy(*by).agg(F.count("*").alias("n"), F.avg("cer_ocr").alias("ocr_cer"), F.avg("cer_llm").alias("cer"), *[F.count_if(c).alias(k) for k, c in counts.items()])
    out = out.withColumn("cer_delta", F.col("ocr_cer") - F.col("cer")).withColumn("relative_pct", F.when(F.col("ocr_cer") > 0, F.col("cer_delta") / F.col("ocr_cer") * 100).otherwise(0.0))
    return out.withColumn("improvement_rate", F.col("improved") / F.col("n") * 100).withColumn("regression_rate", F.col("regressed") / F.col("n") * 100)


def run_averages(runs: DataFrame) -> DataFrame:
    """Mean of each run's dataset means."""
    return runs.groupBy("run", "dataset").agg(F.avg("cer").alias("cer")).groupBy("run").agg(F.avg("cer").alias("cer"), F.count("*").alias("datasets"))


def ablation(averages: DataFrame, full: str) -> DataFrame:
    """What each run loses against the full one."""
    whole = averages.where(F.col("run") == full).select(F.col("cer").alias("full_cer"))
    delta = F.col("cer") - F.col("full_cer")
    verdict = F.when(delta > 0.001, "component helps").when(delta < -0.001, "component hurts").otherwise("neutral")
    return averages.where(F.col("run") != full).join(F.broadcast(whole)).select("run", "cer", delta.alias("delta"), verdict.alias("verdict"))


def synergy(averages: DataFrame, baseline: str, parts: list[str], combined: str, band: float = 0.001) -> DataFrame:
    """Gain of a combination less the sum of its parts' gains."""
    of = lambda run: F.max(F.when(F.col("run") == run, F.col("cer")))
    gains = averages.agg((of(baseline) - of(combined)).alias("combined_gain"), reduce(lambda a, b: a + b, [of(baseline) - of(p) for p in parts]).alias("parts_gain"))
    s = F.col("combined_gain") - F.col("parts_gain")
    return gains.select("combined_gain", "parts_gain", s.alias("synergy"), F.when(s > band, "synergistic").when(s < -band, "antagonistic").otherwise("additive").alias("verdict"))


def best_run(averages: DataFrame) -> DataFrame:
    return averages.agg(F.min_by("run", F.struct("cer", "run")).alias("run"), F.min("cer").alias("cer"))


def in_every_run(runs: DataFrame) -> DataFrame:
    """Rows of the samples that every run has; of a sample's repeats in a run the last by ``ord``."""
    last = runs.groupBy("run", "sample_id").agg(F.max_by("cer", "ord").alias("cer"))
    n = last.select(F.countDistinct("run").alias("runs"))
    shared = last.groupBy("sample_id").agg(F.count("*").alias("k")).join(F.broadcast(n), F.col("k") == F.col("runs")).select("sample_id")
    return last.join(shared, "sample_id", "left_semi")
