"""What prompts are told: stored confusions (KB01), choices of word pairs (KB08, KB10) and examples (KB09), the effect of injected pairs (JON14, WIN06),
index statistics (AGG25), texts cut to a token budget (FN21), and the score of an optimiser (UDF10)."""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pairloom.functions.classify import error_type
from pairloom.functions.edit import char_errors
from pairloom.operators.prefix_sums import positions
from pairloom.operators.sampling import SEED
from pairloom.sources.readers import exists

_TOP = "array<struct<gt: string, ocr: string, count: long, probability: double>>"
_NESTED = "map<string, map<string, struct<count: long, probability: double>>>"
COVERED = 200  # word pairs that a choice by coverage looks at, which is what the pair table keeps


def stored_confusions(spark: SparkSession, path: str) -> DataFrame:
    """``gt_char, ocr_char, count, probability`` of a stored matrix, most frequent first: its ``top_20`` if that holds any, else all its ``confusions``.

    A missing file is a FileNotFoundError, one that is no JSON object a ValueError."""
    if not exists(spark, path):
        raise FileNotFoundError(path)
    raw = spark.read.text(path, wholetext=True)
    if raw.where(F.coalesce(F.schema_of_variant(F.try_parse_json("value")).startswith("OBJECT"), F.lit(False))).limit(1).count() == 0:
        raise ValueError(f"{path} is no JSON object")
    top = F.from_json("value", f"struct<top_20: {_TOP}>")["top_20"]
    nested = F.from_json("value", f"struct<confusions: {_NESTED}>")["confusions"]
    best = raw.where(F.size(top) > 0).select(F.explode(top).alias("x")).select(F.col("x.gt").alias("gt_char"), F.col("x.ocr").alias("ocr_char"), "x.count", "x.probability")
    rest = raw.where(F.coalesce(F.size(top), F.lit(0)) <= 0).select(F.explode(nested).alias("gt_char", "m")).select("gt_char", F.explode("m").alias("ocr_char", "x")).select("gt_char", "ocr_char", "x.count", "x.probability")
    return best.unionByName(rest).orderBy(F.desc("count"), "gt_char", "ocr_char")


def ranked_pairs(pairs: DataFrame, kind: str) -> DataFrame:
    """``wrong, right, count, rank`` of the pairs of one ``kind`` (``kind, wrong, right``, as a file of word pairs gives them), most frequent first (ties by the words)."""
    counted = pairs.where(F.col("kind") == kind).groupBy("wrong", "right").agg(F.count("*").alias("count"))
    placed = positions(counted.withColumn("_less", -F.col("count")), [], ["_less", "wrong", "right"], "rank")
    return placed.select("wrong", "right", "count", (F.col("rank") + 1).alias("rank"))


def word_examples_text(pairs: DataFrame, n: int = 15) -> DataFrame:
    """One text with a line for each of the first ``n`` pairs (by ``rank``); pairs that are equal or lack a side are passed over; empty if none is left."""
    return _lines(pairs, n, F.format_string("- %s: %s", "wrong", "right"))


def overcorrection_text(pairs: DataFrame, n: int = 10) -> DataFrame:
    """One text that warns of the first ``n`` wrong words (by ``rank``) that a model made of right ones; empty if there are none."""
    times = F.when(F.col("count") > 1, F.format_string(" (%d times)", "count")).otherwise("")
    return _lines(pairs, n, F.concat(F.format_string("- do not write %s where the text has %s", "wrong", "right"), times))


def _lines(pairs: DataFrame, n: int, line: Column) -> DataFrame:
    fit = pairs.where((F.coalesce("wrong", F.lit("")) != "") & (F.coalesce("right", F.lit("")) != "") & (F.col("wrong") != F.col("right"))).orderBy("rank").limit(n)
    rows = fit.agg(F.array_sort(F.collect_list(F.struct("rank", line.alias("line")))).alias("rows"))
    return rows.select(F.array_join(F.transform("rows", lambda x: x["line"]), "\n").alias("text"))


def pairs_by_coverage(pairs: DataFrame, n: int) -> DataFrame:
    """``wrong, right, count``: of the ``COVERED`` most frequent pairs those that show most confusions not shown yet, one after another, then the most frequent of the rest."""
    top = pairs.orderBy(F.desc("count"), "wrong", "right").limit(COVERED)
    shown = F.transform(char_errors("right", "wrong"), lambda e: F.concat_ws("\u0001", F.coalesce(e["gt_char"], F.lit("")), F.coalesce(e["ocr_char"], F.lit(""))))
    rows = [(r.wrong, r["right"], r["count"], set(r.shown)) for r in top.select("wrong", "right", "count", F.array_distinct(shown).alias("shown")).collect()]
    rows.sort(key=lambda r: (-r[2], r[0], r[1]))
    chosen, covered = [], set()
    while rows and len(chosen) < n:
        best = max(rows, key=lambda r: len(r[3] - covered))  # of equal ones the most frequent
        if not best[3] - covered:
            break
        rows.remove(best)
        covered |= best[3]
        chosen.append(best)
    chosen += rows[: n - len(chosen)]
    return pairs.sparkSession.createDataFrame([(k, *r[:3]) for k, r in enumerate(chosen)], "rank int, wrong string, right string, count long")


def pick_pairs(pairs: DataFrame, n: int, strategy: str = "first", seed: int = SEED) -> DataFrame:
    """``n`` word pairs: the first by frequency, or drawn at random."""
    if strategy not in ("first", "random"):
        raise ValueError(f"no such strategy: {strategy}")
    draw = [F.md5(F.concat_ws(":", F.lit(str(seed)), "wrong", "right"))] if strategy == "random" else [F.desc("count")]
    return pairs.orderBy(*draw, "wrong", "right").limit(n)


def pick_examples(examples: DataFrame, n: int, max_chars: int = 200, seed: int = SEED) -> list[tuple[str, str]]:
    """``n`` pairs (OCR text, reference) of a small stored set (``sample_id, ocr_text, gt_text, cer``), from all strata of the error rate in turn."""
    from pairloom.operators.selection import few_shot_pick

    fit = examples.where((F.length("ocr_text") <= max_chars) & (F.length("gt_text") <= max_chars))
    return [(r.ocr_text, r.gt_text) for r in few_shot_pick(fit, n, least=1, most=max_chars, seed=seed).orderBy("turn", "stratum").collect()]


def format_examples(examples: list[tuple[str, str]]) -> str:
    return "\n\n".join(f"{k}.\n{wrong}\n→ {right}" for k, (wrong, right) in enumerate(examples, 1))


def seeded_examples(examples: list[tuple[str, str]], n: int, seed: int = SEED) -> list[tuple[str, str]]:
    """A random choice of a list that is in memory already."""
    return random.Random(seed).sample(examples, min(n, len(examples)))


def injected_impact(injected: DataFrame, baseline: DataFrame, run: DataFrame) -> DataFrame:
    """``rank, gt_char, ocr_char, count, error_type, baseline, after, change`` of confusions that a prompt named (``gt_char, ocr_char, count``; few): errors of their
    type (``error_type, n``) before and after, 0 where a run has none."""
    ranked = injected.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("count"), "gt_char", "ocr_char"))).withColumn("error_type", error_type(F.col("gt_char"), F.col("ocr_char")))
    both = ranked.join(baseline.select("error_type", F.col("n").alias("baseline")), "error_type", "left").join(run.select("error_type", F.col("n").alias("after")), "error_type", "left")
    both = both.withColumn("baseline", F.coalesce("baseline", F.lit(0)).cast("long")).withColumn("after", F.coalesce("after", F.lit(0)).cast("long"))
    return both.select("rank", "gt_char", "ocr_char", "count", "error_type", "baseline", "after", (F.col("after") - F.col("baseline")).alias("change"))


def index_histogram(index: DataFrame, types: str = "error_types") -> DataFrame:
    """``error_type, n``: entries of an index that have each type (several each); a null type counts entries without any."""
    return index.select(F.explode_outer(F.array_distinct(types)).alias("error_type")).groupBy("error_type").agg(F.count("*").alias("n"))


def trimmed(system: Column, user: Column, budget: int) -> tuple[Column, Column]:
    """System and user text within ``budget`` words: the end of the system text goes first, then the beginning of the user's."""
    words = lambda c: F.filter(F.split(F.coalesce(c, F.lit("")), "\\s+"), lambda w: w != "")
    n_system, n_user = F.size(words(system)), F.size(words(user))
    room = F.greatest(F.lit(budget) - n_user, F.lit(0))
    cut = F.when(n_system <= room, system).otherwise(F.concat_ws(" ", F.slice(words(system), F.lit(1), room)))
    late = F.when(n_user <= budget, user).otherwise(F.concat_ws(" ", F.slice(words(user), F.greatest(n_user - budget + 1, F.lit(1)), F.lit(budget))))
    return cut, late


def optimiser_score(cer: Column) -> Column:
    """1 for a right text, 0 for one with as many errors as characters."""
    return F.greatest(F.lit(0.0), 1 - F.least(cer, F.lit(1.0)))
