"""Classification of character errors, samples and pairs (CLS01-CLS09)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pairloom.functions.text import remove_report_diacritics, strip, word_count

# Groups of Arabic letters that recognition confuses, and the names of error types and positions.
HAMZA, TAA, ALEF_MAKSURA = "أاإآءٱ", "ةه", "ىي"
DOTS = ["بتثن", "جحخ", "دذ", "رز", "سش", "صض", "طظ", "فق", "يى"]
SIMILAR = ["وأ", "عغ", "من", "كل", "لا", "هأ", "حم"]
ERROR_TYPES = ["dot_confusion", "hamza", "taa_marbuta", "alef_maksura", "similar_shape", "other_substitution", "insertion", "deletion", "merged_words", "split_word", "unknown"]
TYPED = [x for x in ERROR_TYPES if x != "unknown"]
POSITIONS = ["word_start", "word_middle", "word_end", "single_char"]


def error_type_of(gt: str, ocr: str, shapes: bool = True) -> str:
    if not gt or not ocr:
        return "insertion" if not gt else "deletion"
    for name, groups in (("hamza", [HAMZA]), ("taa_marbuta", [TAA]), ("alef_maksura", [ALEF_MAKSURA]), ("dot_confusion", DOTS)):
        if any(gt in g and ocr in g for g in groups):
            return name
    return "similar_shape" if shapes and any({gt, ocr} == set(g) for g in SIMILAR) else "other_substitution"


def error_type(gt: Column, ocr: Column, shapes: bool = True) -> Column:
    """The same for columns; both within a group."""
    both = lambda g: F.lit(g).contains(gt) & F.lit(g).contains(ocr)
    out = F.when(F.coalesce(gt, F.lit("")) == "", F.lit("insertion")).when(F.coalesce(ocr, F.lit("")) == "", F.lit("deletion"))
    for name, groups in (("hamza", [HAMZA]), ("taa_marbuta", [TAA]), ("alef_maksura", [ALEF_MAKSURA]), ("dot_confusion", DOTS)):
        for g in groups:
            out = out.when(both(g), F.lit(name))
    if shapes:
        for g in SIMILAR:
            out = out.when(both(g) & (gt != ocr), F.lit("similar_shape"))
    return out.otherwise(F.lit("other_substitution"))


# What prompts call the groups of letters, in the order in which they are listed.
GROUP_NAMES = {"taa_marbuta": "Taa marbuta and haa", "hamza": "Hamza forms", "alef_maksura": "Alef maksura and yaa", "dot_confusion": "Dots", "other_substitution": "Others"}


def confusion_type(gt: Column, ocr: Column) -> Column:
    """The group of a confused pair of letters: of the groups of letters only, neither similar shapes nor gaps are told apart."""
    whole = F.coalesce(gt, F.lit("")) != ""
    return F.when(whole & (F.coalesce(ocr, F.lit("")) != ""), error_type(gt, ocr, shapes=False)).otherwise(F.lit("other_substitution"))


def position_of(at: int, text: str) -> str:
    """Place of a character in the word around it, words being what lies between blanks, tabs and line breaks."""
    if at >= len(text):
        return "word_middle"
    start = max(text.rfind(x, 0, at) for x in " \n\t") + 1
    end = min((k for x in " \n\t" if (k := text.find(x, at + 1)) >= 0), default=len(text))
    if end - start == 1:
        return "single_char"
    return "word_start" if at == start else "word_end" if at == end - 1 else "word_middle"


# The thresholds of categories, training classes, difficulties and pools below.
def sample_category(ocr: Column, corrected: Column, gt: Column, cer_ocr: Column, cer_llm: Column) -> Column:
    o, c, g = strip(ocr), strip(corrected), strip(gt)
    better = cer_llm < cer_ocr - 1e-6
    return (
        F.when(c == o, "NO_CHANGE").when(c == g, "PERFECT")
        .when(better & (word_count(c) < word_count(o) * 0.65), "REPETITION_REMOVED").when(better, "PARTIAL_FIX")
        .when(cer_ocr < 0.05, "FALSE_POSITIVE").when(remove_report_diacritics(c) == remove_report_diacritics(o), "DIACRITIC_ONLY")
        .when(F.length(c) > F.length(o) * 1.4, "HALLUCINATION").when(F.length(c) < F.length(o) * 0.6, "TRUNCATION").otherwise("WORD_SUBSTITUTION")
    )


CATEGORIES = ["NO_CHANGE", "PERFECT", "REPETITION_REMOVED", "PARTIAL_FIX", "FALSE_POSITIVE", "DIACRITIC_ONLY", "HALLUCINATION", "TRUNCATION", "WORD_SUBSTITUTION"]


def outcome(cer_ocr: Column, cer_llm: Column, epsilon: float = 1e-6) -> Column:
    return F.when(cer_llm < cer_ocr - epsilon, "improved").when(cer_llm > cer_ocr + epsilon, "regressed").otherwise("unchanged")


def training_class(cer_ocr: Column, cer_llm: Column, threshold: float = 0.005) -> Column:
    delta = cer_llm - cer_ocr
    return F.when(cer_llm == 0, "perfect").when(delta > threshold, "degraded").when(F.abs(delta) <= threshold, "unchanged").otherwise("improved")


def difficulty(cer: Column) -> Column:
    return F.when(cer == 0, "correct").when(cer <= 0.05, "easy").when(cer <= 0.25, "medium").otherwise("hard")


def dev_bucket(ratio: Column, cer_ocr: Column, cer_llm: Column) -> Column:
    """One of seven pools for prompt development, or null."""
    delta = cer_llm - cer_ocr
    return (
        F.when(ratio > 5.0, "runaway").when((cer_ocr == 0) & (cer_llm == 0), "correct_ocr").when((cer_ocr < 0.02) & (delta > 0.005), "false_positive")
        .when((cer_ocr >= 0.02) & (delta > 0.01), "degraded_real").when((F.abs(delta) <= 0.005) & (cer_ocr > 0.05), "unfixed_hard")
        .when((cer_llm == 0) & (cer_ocr > 0), "perfect").when(delta < -0.005, "improved")
    )


def insight_kind(fix_rate: Column, introduction_rate: Column, baseline: Column, least: int = 10) -> Column:
    """Strength, weakness or over-correction of a type with enough samples; rates are null where nothing was wrong before."""
    return F.when(baseline < least, F.lit(None)).when(introduction_rate > 0.05, "overcorrection").when(fix_rate > 0.6, "strength").when(fix_rate < 0.4, "weakness")
