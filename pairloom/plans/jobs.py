"""Whole analyses composed of operators: baseline, correction run, comparison of runs, and an experiment of all of them that goes on where it stopped (ORC01-ORC03, ORC05, entries A to D)."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairloom.functions.text import ARABIC
from pairloom.operators import correct, errors, outcomes, pairs, prompts, relational, selection, stats, validation
from pairloom.sources.readers import exists


BASELINE = ("metrics", "metrics_normal", "metrics_no_diacritics", "quality", "confusions", "taxonomy")


def baseline(samples: DataFrame, by: str = "dataset") -> dict[str, DataFrame]:
    """Metrics with and without runaways and diacritics, confusion matrix and taxonomy of ``samples``."""
    rows, plain = pairs.scored(samples), pairs.scored(samples, diacritics=False)
    found = errors.char_error_rows(samples)
    return {
        "metrics": pairs.metrics(rows, [by]), "metrics_normal": pairs.metrics(rows.where("NOT is_runaway"), [by]), "metrics_no_diacritics": pairs.metrics(plain, [by]),
        "quality": pairs.metrics_and_quality(rows, [by]), "confusions": errors.confusion_matrix(found, [by]), "taxonomy": errors.taxonomy(found, [by]),
    }


def correction_run(inputs: DataFrame, done: DataFrame | None = None, backend: str = "mock", **options) -> DataFrame:
    """Prompts and corrections of the inputs that are not done yet. Write the result before using it twice: models are costly and may vary."""
    rows = inputs if done is None else inputs.join(done.select("dataset", "sample_id").distinct(), ["dataset", "sample_id"], "left_anti")
    return correct.corrected(prompts.with_prompts(rows), backend, **options)


def analysed(corrections: DataFrame) -> dict[str, DataFrame]:
    rows = outcomes.compared(corrections)
    return {"outcomes": outcomes.outcome_summary(rows, ["dataset"]), "categories": outcomes.category_counts(rows), "extremes": outcomes.extremes(rows), "changes": outcomes.error_changes(corrections, ["dataset"])}


def run_comparison(runs: DataFrame, base: str) -> dict[str, DataFrame]:
    """Averages, the best run, and paired statistics over the samples that all runs share."""
    shared = outcomes.in_every_run(runs)
    averages = outcomes.run_averages(runs)
    return {"averages": averages, "best": outcomes.best_run(averages), "statistics": stats.compare_all(shared, base), "intervals": stats.bootstrap_interval(shared, base)}


def written_once(make: Callable[[], DataFrame], path: str, spark: SparkSession, force: bool = False) -> DataFrame:
    """The table at ``path``; it is made and written if it is not there whole, or with ``force``."""
    if force or not exists(spark, f"{path}/_SUCCESS"):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def experiment(samples: DataFrame, folder: str, kinds: tuple[str, ...] = ("zero_shot", "ocr_aware", "self_reflective"), backend: str = "mock", lexicon: DataFrame | None = None, letters: str = ARABIC, arabic_only: bool = True,
               force: bool = False, datasets: list[str] | None = None, ids: DataFrame | None = None, limit: int | None = None, **options) -> dict[str, DataFrame]:
    """Baseline, corrections by every kind of prompt, their analyses, corrections reverted by a lexicon, and the comparison of all, each a table under ``folder``.

    Tables that are there whole are read, so a run that failed goes on where it stopped; ``force`` makes all anew. ``samples`` (``dataset, sample_id, ord, ocr_text, gt_text``) are narrowed to ``datasets``, to
    the ``ids`` (``sample_id``) and to ``limit`` of each data set, in this order. Prompts of later kinds are told what earlier tables found: the pooled confusions of the baseline, and what the first kind's model got wrong."""
    spark, out = samples.sparkSession, {}
    if datasets:
        samples = samples.where(F.col("dataset").isin(datasets))
    if ids is not None:
        samples = samples.join(ids.select("sample_id").distinct(), "sample_id", "left_semi")
    if limit is not None:
        samples = relational.first_per_group(samples, ["dataset"], ["ord", "sample_id"], limit).drop("k")

    def table(name: str, make: Callable[[], DataFrame]) -> DataFrame:
        out[name] = written_once(make, f"{folder}/{name}", spark, force)
        return out[name]

    rows = table("samples", lambda: samples)
    first: dict[str, DataFrame] = {}

    def of_baseline(name: str) -> DataFrame:
        if not first:  # its summaries run jobs of their own, which a run that goes on does not need
            first.update(baseline(rows))
        return first[name]

    for name in BASELINE:
        table(f"baseline/{name}", lambda name=name: of_baseline(name))
    found = errors.char_error_rows(rows)
    matrix = table("baseline/pooled", lambda: errors.pooled(errors.confusion_matrix(found, ["dataset"], arabic_only=arabic_only)))
    scored = lambda df, run: outcomes.compared(df.join(rows.select("dataset", "sample_id", "ord", "gt_text"), ["dataset", "sample_id"])).select(F.lit(run).alias("run"), "dataset", "sample_id", "ord", "cer_ocr", "cer_llm")
    runs = []
    for kind in kinds:
        told = rows.withColumn("prompt_type", F.lit(kind))
        if kind in ("ocr_aware", "combined"):
            told = told.join(F.broadcast(errors.format_confusions(matrix).withColumnRenamed("text", "confusion_context")))  # one row
        if kind in ("self_reflective", "combined"):
            notes = outcomes.insights_text(out[f"{kinds[0]}/changes"], ["dataset"]).withColumnRenamed("text", "insights_context") if kind != kinds[0] else rows.select("dataset").distinct().withColumn("insights_context", F.lit(""))
            told = told.join(notes, "dataset", "left")
        corrected = table(f"{kind}/corrections", lambda told=told: correction_run(told, backend=backend, arabic_only=arabic_only, **options))
        whole = corrected.join(rows.select("dataset", "sample_id", "ord", "gt_text"), ["dataset", "sample_id"])
        for name, made in analysed(whole).items():
            table(f"{kind}/{name}", lambda made=made: made)
        runs.append(table(f"{kind}/scored", lambda c=corrected, k=kind: scored(c, k)))
    if lexicon is not None:
        answers = out[f"{kinds[0]}/corrections"]
        reverted = table("lexicon/reverted", lambda: validation.reverted(answers, lexicon, letters=letters))
        table("lexicon/statistics", lambda: validation.revert_statistics(reverted))
        final = answers.drop("corrected_text").join(reverted.select("sample_id", F.col("final_text").alias("corrected_text")), "sample_id")
        runs.append(table("lexicon/scored", lambda: scored(final, "lexicon")))
    base = runs[0].select(F.lit("baseline").alias("run"), "dataset", "sample_id", "ord", F.col("cer_ocr").alias("cer"))
    every = table("runs", lambda: reduce(DataFrame.unionByName, [base, *[r.withColumnRenamed("cer_llm", "cer").drop("cer_ocr") for r in runs]]))
    for name, made in run_comparison(every, "baseline").items():
        table(f"comparison/{name}", lambda made=made: made)
    table("hard", lambda: selection.degraded_then_hard(runs[0].withColumn("cer_delta", F.col("cer_llm") - F.col("cer_ocr")), 200))
    return out


def datasets_wanted(given: list[str] | None, listed: list[str] | None, configured: list[str]) -> list[str]:
    """The command line's data sets, else the sample list's, else the configured ones."""
    return given or listed or configured


def trial_matrix(spark, prompts_: list[str], retrieval: list[bool]) -> DataFrame:
    """One row per trial of prompts by retrieval, a few rows."""
    return spark.createDataFrame([(f"T{i}", p, r) for i, (p, r) in enumerate(((p, r) for p in prompts_ for r in retrieval), 1)], "trial string, prompt string, retrieval boolean")


def trial_summary(rows: DataFrame) -> DataFrame:
    return rows.groupBy("trial", "dataset").agg(F.count("*").alias("n"), F.avg("cer").alias("cer"))


def trial_table(summary: DataFrame, trials: list[str]) -> DataFrame:
    """A row for each data set with a column for each of ``trials`` (null where it was not run), and ``best``, the trial with the smallest rate (ties to the first)."""
    table = summary.groupBy("dataset").pivot("trial", trials).agg(F.first("cer"))
    least = F.array_min(F.array(*[F.col(f"`{t}`") for t in trials]))
    best = F.coalesce(*[F.when(F.col(f"`{t}`") == least, F.lit(t)) for t in trials])
    return table.withColumn("best", best)
