"""Text functions, rates and alignments: known values, and properties against plain dynamic programmes."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pairloom.functions import classify, edit, text


def value(spark, make, *args):
    """The value of an expression over strings."""
    row = spark.createDataFrame([tuple(args)], ", ".join(f"c{i} string" for i in range(len(args))))
    return row.select(make(*[F.col(f"c{i}") for i in range(len(args))]).alias("v")).first().v


def test_runs_are_limited(spark):
    cases = [("كلمة" + "٠" * 10, 5, "كلمة" + "٠" * 5), ("أ" * 6, 5, "أ" * 5), ("ب" * 5, 5, "ب" * 5), ("أ" * 10 + "ب" * 10, 3, "أ" * 3 + "ب" * 3), ("a\n\n\n\n\n\n\nb", 5, "a\n\n\n\n\n\n\nb"), ("", 5, ""), ("aaaa", 0, "aaaa")]
    for given_, most, want in cases:
        assert value(spark, lambda c, m=most: text.limit_runs(c, m), given_) == want


def test_normalising(spark):
    assert value(spark, lambda c: text.normalise(c, False), "كَتَبَ") == "كتب"
    assert value(spark, text.normalise, "  مرحبا  ") == "مرحبا"
    assert value(spark, text.normalise, "أهلا  \n إلى آخره") == "اهلا الى اخره"
    assert value(spark, text.normalise, None) == ""
    assert value(spark, text.remove_diacritics, "كَتَبَ") == "كتب"


def test_tokens_and_counts(spark):
    assert value(spark, text.tokens, "الكتاب على الطاولة") == ["الكتاب", "على", "الطاولة"]
    assert value(spark, text.tokens, "a،b؛c؟d. e-f") == list("abcdef") and value(spark, text.tokens, "") == []
    assert [value(spark, text.is_arabic, x) for x in ("abc مرحبا", "123", "")] == [True, False, False]
    assert value(spark, text.count_arabic, "abc مرحبا 123") == 5
    assert value(spark, text.word_count, " a  b c ") == 3
    assert value(spark, text.truncate, "x" * 221) == "x" * 220 + " [...]" and value(spark, text.truncate, "x" * 220) == "x" * 220
    assert value(spark, text.collapse_tatweel, "اـ ـ ـ ـب") == "اـب"
    assert value(spark, text.from_first_arabic, 'Text: "مرحبا"') == "مرحبا"
    assert [value(spark, text.accepted_output, x, "نص") for x in ("English", "", " مرحبا ", None)] == ["نص", "نص", "مرحبا", "نص"]
    assert value(spark, text.token_estimate, "") == 1 and value(spark, text.token_estimate, "x" * 9) == 2
    assert value(spark, lambda c: text.char_ngrams(c, 2), "abc") == ["ab", "bc"] and value(spark, lambda c: text.char_ngrams(c, 2), "a") == []
    assert value(spark, text.trailing_number, "Akhbar_12") == 12 and value(spark, text.trailing_number, "x") is None
    assert tuple(value(spark, text.dataset_parts, "PATS-A01-Akhbar-Train")) == ("PATS-A01", "Akhbar", "train")
    assert tuple(value(spark, text.dataset_parts, "KHATT-Paragraph-val")) == ("KHATT-Paragraph", None, "val") and tuple(value(spark, text.dataset_parts, "Historical")) == ("Historical", None, None)


def test_rates(spark):
    assert value(spark, edit.cer, "مرحبا", "مرحيا") == pytest.approx(0.2)
    assert value(spark, edit.cer, "أهلا", "اهلا") == 0 and value(spark, edit.cer, "", "أي شيء") == 0 and value(spark, edit.cer, "مرحبا", "") == 1
    assert value(spark, edit.cer, "ا", "نص طويل") > 1
    assert value(spark, edit.wer, "الكتاب على الطاولة", "الكتب على الطاولة") == pytest.approx(1 / 3)
    assert value(spark, edit.wer, "a b c", "a b x c") == pytest.approx(1 / 3) and value(spark, edit.wer, "", "a") == 0 and value(spark, edit.wer, "a b", "") == 1


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = _next(row, i, x, b)
    return row[-1]


def _next(before, i, x, b):
    row = [i]
    for j, y in enumerate(b, 1):
        row.append(min(before[j] + 1, row[-1] + 1, before[j - 1] + (x != y)))
    return row


def table_path(ref, hyp):
    """The plain way: a whole table, then back: match, substitution, deletion, insertion."""
    t = [list(range(len(hyp) + 1))]
    for i, x in enumerate(ref, 1):
        t.append(_next(t[-1], i, x, hyp))
    i, j, out = len(ref), len(hyp), []
    while i or j:
        if i and j and ref[i - 1] == hyp[j - 1]:
            i, j = i - 1, j - 1
            out.append((ref[i], hyp[j]))
        elif i and j and t[i][j] == t[i - 1][j - 1] + 1:
            i, j = i - 1, j - 1
            out.append((ref[i], hyp[j]))
        elif i and t[i][j] == t[i - 1][j] + 1:
            i -= 1
            out.append((ref[i], None))
        else:
            j -= 1
            out.append((None, hyp[j]))
    return out[::-1]


@settings(max_examples=300, deadline=None)
@given(st.text("abc ", max_size=40), st.text("abc ", max_size=40))
def test_alignment_is_the_plain_one(a, b):
    path = edit.align(a, b)
    assert path == table_path(a, b)
    assert sum(r != h for r, h in path) == distance(a, b)


def test_long_alignment_in_bounded_memory():
    r = random.Random(1)
    a = "".join(r.choice("abcdefgh ") for _ in range(3000))
    b = "".join(c for c in a if r.random() > 0.05)
    path = edit.align(a, b)
    assert "".join(x for x, _ in path if x) == a and "".join(y for _, y in path if y) == b


def test_character_errors():
    assert edit.align("كب", "ك") == [("ك", "ك"), ("ب", None)] and edit.align("ك", "كب") == [("ك", "ك"), (None, "ب")]
    kinds = {("ة", "ه"): "taa_marbuta", ("أ", "ا"): "hamza", ("ب", "ت"): "dot_confusion", ("ى", "ي"): "alef_maksura", ("ب", ""): "deletion", ("", "ت"): "insertion", ("ع", "غ"): "similar_shape", ("ب", "ل"): "other_substitution"}
    assert {k: classify.error_type_of(*k) for k in kinds} == kinds
    assert classify.error_type_of("ع", "غ", shapes=False) == "other_substitution"
    text_ = "ab c def"
    assert [classify.position_of(i, text_) for i in (0, 1, 3, 5, 6, 7, 8)] == ["word_start", "word_end", "single_char", "word_start", "word_middle", "word_end", "word_middle"]
    one = edit.char_errors_of("مدرسة", "مدرسه")
    assert one == [{"gt_char": "ة", "ocr_char": "ه", "error_type": "taa_marbuta", "position": "word_end", "context": "سة"}]
    assert edit.word_errors_of(["ab", "cd", "longword"], ["abcd", "cd"])[0]["is_merged"] and edit.word_errors_of(["longword"], []) == [{"gt_word": "longword", "ocr_word": "", "is_merged": False, "is_split": True}]


def test_classes_of_columns_and_python_agree(spark):
    signs = ["", *"أاإآءةهىيبتثنجحدذرزسشفقوعغمنكلح"]
    rows = spark.createDataFrame([(a, b) for a in signs for b in signs if a != b], "a string, b string")
    for r in rows.select("a", "b", classify.error_type(F.col("a"), F.col("b")).alias("t")).collect():
        assert r.t == classify.error_type_of(r.a, r.b), (r.a, r.b)


def test_sample_classes(spark):
    rows = spark.createDataFrame([(0.1, 0.0), (0.1, 0.2), (0.1, 0.103), (0.2, 0.1)], "o double, l double")
    assert [r.v for r in rows.select(classify.training_class(F.col("o"), F.col("l")).alias("v")).collect()] == ["perfect", "degraded", "unchanged", "improved"]
    assert [r.v for r in rows.select(classify.outcome(F.col("o"), F.col("l")).alias("v")).collect()] == ["improved", "regressed", "regressed", "improved"]
    cases = [("a b", "a b", "x", 0.5, 0.5, "NO_CHANGE"), ("a b", "x", "x", 0.5, 0.0, "PERFECT"), ("a a a a a a", "a b", "a", 0.9, 0.1, "REPETITION_REMOVED"), ("a b c", "a b d", "a b e", 0.9, 0.1, "PARTIAL_FIX"), ("abc", "abd", "abe", 0.01, 0.1, "FALSE_POSITIVE"), ("كتب", "كَتب", "x", 0.5, 0.6, "DIACRITIC_ONLY"), ("abc", "abcdefgh", "x", 0.5, 0.9, "HALLUCINATION"), ("abcdefgh", "abc", "x", 0.5, 0.9, "TRUNCATION"), ("abc", "abd", "x", 0.5, 0.9, "WORD_SUBSTITUTION")]
    got = spark.createDataFrame([c[:5] for c in cases], "o string, c string, g string, x double, y double").select(classify.sample_category(*[F.col(k) for k in "ocgxy"]).alias("v")).collect()
    assert [r.v for r in got] == [c[5] for c in cases]
