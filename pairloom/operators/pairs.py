"""Pairs of texts, scored (FLT01, FLT02, FLT05) and the summaries over them (AGG01-AGG08, FLT17)."""

from __future__ import annotations

from functools import partial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairloom.functions import batches
from pairloom.functions.edit import distance, distance_at_sight, error_rate, word_distance, word_distance_at_sight, words_joined
from pairloom.functions.text import DIACRITICS, normalise, tokens
from pairloom.operators.percentiles import at_ranks, counted, on, statistics
from pairloom.plans.shared import kept

RUNAWAY = 5.0


def spread_out(rows: DataFrame) -> DataFrame:
    """Rows dealt to all cores where the input has fewer partitions than there are cores, as edit distances cost much more than a shuffle of small
    files; larger inputs stay as they are read."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores) if rows.rdd.getNumPartitions() < cores else rows


def scored(pairs: DataFrame, hypothesis: str = "ocr_text", diacritics: bool = True, words: bool = True) -> DataFrame:
    """Adds to pairs (``gt_text`` and a column ``hypothesis``) lengths, distances, rates and whether the hypothesis is a runaway.

    One projection normalises each text once; everything stays in the JVM. A null hypothesis counts as empty; with an empty reference rates are 0."""
    out = pairs.withColumn("ref", normalise(F.col("gt_text"), diacritics)).withColumn("hyp", normalise(F.col(hypothesis), diacritics))
    out = out.withColumn("chars", F.length("ref")).withColumn("hyp_chars", F.length("hyp")).withColumn("char_distance", distance(F.col("ref"), F.col("hyp")))
    out = out.withColumn("cer", error_rate(F.col("char_distance"), F.col("chars"))).withColumn("length_ratio", F.col("hyp_chars") / F.greatest(F.col("chars"), F.lit(1)))
    out = out.withColumn("is_runaway", F.col("length_ratio") > RUNAWAY)
    if words:
        out = out.withColumn("ref_words", tokens(F.col("ref"))).withColumn("hyp_words", tokens(F.col("hyp"))).withColumn("words", F.size("ref_words"))
        out = out.withColumn("wer", error_rate(word_distance(F.col("ref_words"), F.col("hyp_words")), F.col("words")))
    return out


def all_rates(corrections: DataFrame, keep: list[str]) -> DataFrame:
    """``keep`` and eight rates of each row, as ``scored`` has them: ``cer`` and ``wer`` of ``_ocr`` and ``_llm`` texts without diacritics, and with them (``_raw``). A null correction stands for the OCR text.

    All distances come from one pass over Arrow batches, as each Python function of a projection queues whole rows, texts and all, in memory and on disk. A text is sent only if a distance can't be seen without
    a table, and neither texts without diacritics nor corrections that change nothing are compared twice."""
    texts = {"g": F.col("gt_text"), "o": F.col("ocr_text"), "c": F.coalesce("corrected_text", "ocr_text")}
    rows = corrections.select(*keep, *[x.alias(f"_{t}r") for t, x in texts.items()])
    rows = rows.select(*keep, *[f"_{t}r" for t in texts], *[normalise(F.col(f"_{t}r")).alias(f"_{t}1") for t in texts])
    rows = rows.select(*keep, *[f"_{t}1" for t in texts], *[F.when(F.col(f"_{t}1").rlike(DIACRITICS), normalise(F.col(f"_{t}r"), False)).otherwise(F.col(f"_{t}1")).alias(f"_{t}0") for t in texts])
    joined = lambda c: F.array_join(tokens(F.col(c)), " ")
    rows = rows.withColumns({f"_{t}w1": joined(f"_{t}1") for t in texts})
    rows = rows.withColumns({f"_{t}w0": F.when(F.col(f"_{t}0") == F.col(f"_{t}1"), F.col(f"_{t}w1")).otherwise(joined(f"_{t}0")) for t in texts})
    # -1: as with diacritics; -2: as the OCR text
    same = lambda t: F.col(f"_{t}0") == F.col(f"_{t}1")
    known, sent, lengths = {}, [], {}
    for raw in "10":
        for w, sight in (("", distance_at_sight), ("w", word_distance_at_sight)):
            of = lambda t: F.col(f"_{t}{w}{raw}")  # noqa: B023, E731
            lengths[f"_n{w}{raw}"] = words_joined(of("g")) if w else F.length(of("g"))
            for t in "oc":
                d = sight(of("g"), of(t))
                d = F.when(of("c") == of("o"), F.lit(-2)).otherwise(d) if t == "c" else d
                known[f"_d{t}{w}{raw}"] = F.when(same("g") & same(t), F.lit(-1)).otherwise(d) if raw == "0" else d
                sent.append((f"_g{w}{raw}", f"_{t}{w}{raw}", f"_d{t}{w}{raw}", w == "w"))
    rows = rows.withColumns(lengths | known)
    needed: dict[str, Column] = {}
    for a, b, d, _ in sent:
        for c in (a, b):
            needed[c] = needed.get(c, F.lit(False)) | F.col(d).isNull()
    rows = rows.select(*keep, *lengths, *known, *[F.when(x, F.col(c)).alias(c) for c, x in needed.items()])
    kinds = [f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in [*keep, *lengths, *known]]
    rows = rows.mapInArrow(partial(batches.several_distances, pairs=sent), ", ".join(kinds))
    for raw in "10":
        for t in "oc":
            d = lambda w: F.when(F.col(f"_d{t}{w}{raw}") == -1, F.col(f"_d{t}{w}1")).when(F.col(f"_d{t}{w}{raw}") == -2, F.col(f"_do{w}{raw}")).otherwise(F.col(f"_d{t}{w}{raw}"))  # noqa: B023, E731
            rows = rows.withColumns({f"_d{t}{w}{raw}": d(w) for w in ("", "w")})
    rate = lambda r, t, raw: error_rate(F.col(f"_d{t}{'w' * (r == 'wer')}{raw}"), F.col(f"_n{'w' * (r == 'wer')}{raw}"))
    return rows.select(*keep, *[rate(r, t, raw).alias(f"{r}_{'ocr' if t == 'o' else 'llm'}{'_raw' * (raw == '1')}") for raw in "01" for t in "oc" for r in ("cer", "wer")])


def spread(c: Column) -> Column:
    return F.coalesce(F.stddev_samp(c), F.lit(0.0))


def metrics(rows: DataFrame, by: list[str], words: bool = True, more: tuple[Column, ...] = ()) -> DataFrame:
    """Counts, sums and the mean, deviation, median and 95th percentile of the rates of each group, and the aggregates ``more``.

    What the summaries need of each row is written once, as texts cost far more to score than rows to read again."""
    rates = ["cer", "wer"] if words else ["cer"]
    summed = [F.count("*").alias("num_samples"), F.sum("chars").cast("long").alias("num_chars_ref")] + ([F.sum("words").cast("long").alias("num_words_ref")] if words else [])
    summed += [x for r in rates for x in (F.avg(r).alias(r), spread(F.col(r)).alias(f"{r}_std"))]
    rows = kept(rows.select(*[c for c in rows.columns if rows.schema[c].dataType.typeName() in ("integer", "long", "double", "boolean") or c in by]), "metrics-rows")
    out, places = rows.groupBy(*by).agg(*summed, *more), statistics(rows, by, rates)
    joined = out.join(places, on(by, out, places), "left").drop(*[places[c] for c in by])
    return joined.select(*by, *[c for c in joined.columns if c not in by])


def percentile(rows: DataFrame, by: list[str], rate: str, percent: int = 95) -> DataFrame:
    """``by, value``: the nearest-rank percentile, exact at any size."""
    return at_ranks(counted(rows, by, rate), by, {"value": lambda n: F.least(n - 1, F.floor(n * (percent / 100.0)))})


def metrics_and_quality(rows: DataFrame, by: list[str]) -> DataFrame:
    """All samples, the normal ones, and the share of runaways, in one pass."""
    normal = ~F.col("is_runaway")
    return rows.groupBy(*by).agg(
        F.count("*").alias("total_samples"), F.count_if(normal).alias("normal_samples"), F.count_if(F.col("is_runaway")).alias("runaway_samples"),
        (F.count_if(F.col("is_runaway")) * 100.0 / F.greatest(F.count("*"), F.lit(1))).alias("runaway_percentage"),
        F.avg("cer").alias("cer_all"), F.avg(F.when(normal, F.col("cer"))).alias("cer_normal"), spread(F.when(normal, F.col("cer"))).alias("cer_normal_std"),
    )


def metric_delta(baseline: DataFrame, improved: DataFrame, by: list[str], rate: str = "cer") -> DataFrame:
    """Baseline less improved, absolute and in percent of the baseline (0 if that is 0)."""
    b, i = baseline.select(*by, F.col(rate).alias("baseline")), improved.select(*by, F.col(rate).alias("improved"))
    delta = F.col("baseline") - F.col("improved")
    return b.join(i, by).select(*by, "baseline", "improved", delta.alias("delta"), F.when(F.col("baseline") > 0, delta / F.col("baseline") * 100).otherwise(0.0).alias("relative_pct"))


def family(key: Column) -> Column:
    """The group of a dataset key by its prefix."""
    return F.when(key.startswith("PATS-A01"), "PATS-A01").when(key.startswith("KHATT"), "KHATT").otherwise("other")


def macro_average(summary: DataFrame, group: str, rate: str = "cer") -> DataFrame:
    return summary.groupBy(group).agg(F.count("*").alias("datasets"), F.avg(rate).alias(rate))


def micro_average(summary: DataFrame, by: list[str]) -> DataFrame:
    """Rates of datasets weighted by their reference characters."""
    return summary.groupBy(*by).agg((F.sum(F.col("cer") * F.col("num_chars_ref")) / F.sum("num_chars_ref")).alias("cer"), F.sum("num_chars_ref").cast("long").alias("num_chars_ref"))
