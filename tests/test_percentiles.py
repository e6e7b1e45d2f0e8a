"""Order statistics of groups against sorting, the summaries that use them, and the corrected thresholds."""

import math
import random
import statistics as plain

import pytest
from pyspark.sql import functions as F

from pairloom.functions import edit
from pairloom.operators import outcomes, pairs, percentiles, selection
from test_text import distance


@pytest.mark.parametrize("limit", [4096, 3])
def test_ranks_equal_sorting(spark, limit):
    r = random.Random(limit)
    groups = {"a": [r.random() for _ in range(1500)], "b": [r.choice([0.0, 0.25, 1e-300, 5e17]) for _ in range(300)], None: [10 ** r.uniform(-12, 12) * r.choice([-1, 1]) for _ in range(700)], "one": [3.5], "same": [2.0] * 50}
    rows = spark.createDataFrame([(g, v) for g, vs in groups.items() for v in vs] + [("a", None), ("none", None)], "g string, v double").repartition(3)
    got = {x.g: (x.low, x.high, x.p95) for x in percentiles.at_ranks(percentiles.counted(rows, ["g"], "v"), ["g"], limit=limit).collect()}
    want = {}
    for g, vs in groups.items():
        s, n = sorted(vs), len(vs)
        want[g] = (s[(n - 1) // 2], s[n // 2], s[min(n - 1, int(0.95 * n))])
    assert got == want


def test_metrics_keep_groups_without_a_name(spark):
    rows = spark.createDataFrame([("d", "abcd", "abxd"), ("d", "abcd", "abcd"), (None, "ab", "b"), (None, "", "zzz")], "dataset string, gt_text string, ocr_text string")
    got = {x.dataset: x for x in pairs.metrics(pairs.scored(rows), ["dataset"]).collect()}
    assert set(got) == {"d", None}
    assert (got["d"].cer, got["d"].cer_median, got["d"].cer_p95, got["d"].num_chars_ref, got["d"].num_words_ref) == (0.125, 0.125, 0.25, 8, 2)
    assert got["d"].cer_std == pytest.approx(plain.stdev([0.25, 0])) and got[None].cer_p95 == 0.5
    assert {x.dataset: x.value for x in pairs.percentile(pairs.scored(rows, words=False), ["dataset"], "cer", 50).collect()} == {"d": 0.25, None: 0.5}


def test_training_rates(spark):
    rows = spark.createDataFrame([("d", "abcd", "abxd", "abcd"), ("d", "abcd", "axxd", None), ("e", "a b", "a c", "a b")], "dataset string, gt_text string, ocr_text string, corrected_text string")
    got = {(x.dataset, x.text, x.rate): x for x in outcomes.training_metrics(rows).where("diacritics").collect()}
    assert (got["d", "ocr", "cer"].n, got["d", "ocr", "cer"].median, got["d", "ocr", "cer"].p95) == (2, 0.375, 0.5)
    assert got["d", "llm", "cer"].mean == 0.25 and got["d", "llm", "cer"].std == pytest.approx(plain.stdev([0, 0.5]))
    assert got["e", "ocr", "wer"].std == 0 and got[None, "ocr", "wer"].n == 3 and got[None, "ocr", "cer"].median == pytest.approx(1 / 3)


def test_hard_means_over_five_percent(spark):
    rows = spark.createDataFrame([("a", 0.04, 0.04, 0.0), ("b", 0.06, 0.06, 0.0), ("c", 0.1, 0.3, 0.2), ("d", 0.05, 0.05, 0.0)], "sample_id string, cer_ocr double, cer_llm double, cer_delta double")
    assert [(r.sample_id, r.turn) for r in selection.degraded_then_hard(rows, 5).orderBy("turn", "rank").collect()] == [("c", 0), ("b", 1)]


def test_moves_within_the_band_are_none(spark):
    deltas = [1e-7, -1e-7, 0.0, 2e-6, -2e-6, 0.1, -0.1, 0.5, -0.05]
    rows = spark.createDataFrame([("d", 0.5, 0.5 + x, x) for x in deltas], "dataset string, cer_ocr double, cer_llm double, cer_delta double")
    assert {r.severity: r.n for r in outcomes.severity(rows).collect()} == {"same": 3, "gain": 2, "loss": 1, "large gain": 1, "large loss": 2}
    e = outcomes.prompt_evaluation(rows, ["dataset"]).first()
    assert (e.n, e.improved, e.regressed, e.unchanged, e.large_improve, e.small_improve, e.small_regress, e.large_regress) == (9, 3, 3, 3, 1, 2, 1, 2)
    assert e.improvement_rate == pytest.approx(100 / 3) and e.cer_delta == pytest.approx(-sum(deltas) / 9)


def test_four_rates_of_outcomes(spark):
    rows = spark.createDataFrame([("d", "كِتاب جديد", "كتاب جديد", "كِتاب قديم"), ("d", "a b c d", "a x c d", "a b c d")], "dataset string, gt_text string, ocr_text string, corrected_text string")
    r = outcomes.rate_summary(rows, ["dataset"]).first()
    assert (r.n, r.improved, r.regressed) == (2, 1, 1)
    assert r.wer_ocr == 0.125 and r.wer_ocr_raw == 0.375 and r.wer_llm == 0.25 and r.cer_ocr_raw == pytest.approx((1 / 10 + 1 / 7) / 2)


def test_distances_of_any_symbols(spark):
    r = random.Random(2)
    for n in (0, 1, 5, 63, 64, 65, 130, 400):
        a = [r.choice("abcde") for _ in range(n)]
        for b in ([r.choice("abcde") for _ in range(r.randint(0, n + 3))], a[: n // 2] + ["x"] + a[n // 2 + 1 :], a[::-1], []):
            assert edit.edit_distance(a, b) == edit.edit_distance("".join(b), "".join(a)) == distance(a, b)
    texts = [("".join(r.choice("abé ك😀") for _ in range(r.randint(0, 90))), "".join(r.choice("abé ك😀") for _ in range(r.randint(0, 90)))) for _ in range(60)] + [(None, "a"), ("a" * 40, None), ("", "")]
    rows = spark.createDataFrame(texts, "a string, b string").select(edit.distance(F.col("a"), F.col("b")), F.levenshtein("a", "b")).collect()
    assert all(x == y for x, y in rows) and not math.isnan(len(rows))
