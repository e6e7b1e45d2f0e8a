"""Text functions as Column expressions: normalising, tokenising, counting (FN01-FN10, FN13, FN16-FN20)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Character classes and limits that results depend on.
ARABIC = "[\\u0600-\\u06FF\\u0750-\\u077F\\u08A0-\\u08FF\\uFB50-\\uFDFF\\uFE70-\\uFEFF]"
ARABIC_MAIN = "[\\u0600-\\u06FF]"
DIACRITICS = "[\\u064B-\\u065F\\u0670\\u0610-\\u061A]"
REPORT_DIACRITICS = "[\\u0610-\\u061A\\u064B-\\u065F\\u0670\\u06D6-\\u06DC\\u06DF-\\u06E4\\u06E7\\u06E8\\u06EA-\\u06ED]"
ALEF_VARIANTS = "آأإٱ"
ALEF = "ا"
SPLITTER = "(?U)[\\s\\u060C\\u061B\\u061F\\u0021-\\u002F\\u003A-\\u0040\\u005B-\\u0060\\u007B-\\u007E]+"
MAX_RUN, LINE_CAP, DOCUMENT_CAP = 5, 2000, 8000


def strip(c: Column) -> Column:
    """Without white space at both ends, by Unicode's notion of it (no-break spaces too)."""
    return F.regexp_replace(c, "(?U)^\\s+|\\s+$", "")


def rstrip(c: Column) -> Column:
    return F.regexp_replace(c, "(?U)\\s+$", "")


def limit_runs(c: Column, max_run: int = MAX_RUN) -> Column:
    """Runs of more than ``max_run`` equal characters, line breaks apart, cut to ``max_run``."""
    return c if max_run < 1 else F.regexp_replace(c, f"([^\\n])\\1{{{max_run},}}", "$1" * max_run)


def normalise(c: Column, diacritics: bool = True) -> Column:
    """Stripped, white space collapsed, alef variants unified, runs limited; without diacritics on request. Null is empty."""
    collapse = lambda x: F.regexp_replace(x, "[ \\t\\r\\n]+", " ")
    out = F.translate(collapse(strip(F.coalesce(c, F.lit("")))), ALEF_VARIANTS, ALEF * len(ALEF_VARIANTS))
    if not diacritics:
        out = strip(collapse(F.regexp_replace(out, DIACRITICS, "")))
    return limit_runs(out)


def tokens(c: Column) -> Column:
    """Words between white space and ASCII or Arabic punctuation."""
    return F.filter(F.split(F.coalesce(c, F.lit("")), SPLITTER), lambda x: x != "")


def is_arabic(c: Column) -> Column:
    return c.rlike(ARABIC)


def remove_diacritics(c: Column) -> Column:
    return F.regexp_replace(c, DIACRITICS, "")


def remove_report_diacritics(c: Column) -> Column:
    return F.regexp_replace(c, REPORT_DIACRITICS, "")


def count_arabic(c: Column) -> Column:
    return F.regexp_count(c, F.lit(ARABIC))


def word_count(c: Column) -> Column:
    """Number of runs between white space."""
    return F.size(F.filter(F.split(c, "(?U)\\s+"), lambda x: x != ""))


def flatten(c: Column) -> Column:
    return strip(F.regexp_replace(c, "(?U)\\s+", " "))


def truncate(c: Column, most: int = 220) -> Column:
    return F.when(F.length(c) > most, F.concat(F.substring(c, 1, most), F.lit(" [...]"))).otherwise(c)


def collapse_tatweel(c: Column) -> Column:
    """Three or more tatweels, white space between them or not, become one."""
    return strip(F.regexp_replace(c, "(?U)ـ\\s*ـ\\s*ـ[ـ\\s]*", "ـ"))


def from_first_arabic(c: Column) -> Column:
    """The text from its first Arabic character on, without quotes around it."""
    return F.regexp_replace(strip(F.regexp_extract(c, f"{ARABIC_MAIN}[\\s\\S]*", 0)), "^[\"'`]+|[\"'`]+$", "")


def read_ocr(raw: Column, cap: int = LINE_CAP) -> Column:
    """What the OCR reader keeps of a file: invalid bytes replaced, stripped, runs limited, at most ``cap`` characters."""
    return F.substring(limit_runs(strip(F.make_valid_utf8(raw.cast("string")))), 1, cap)


def accepted_output(answer: Column, ocr: Column) -> Column:
    """A model's answer, or the OCR text if the answer is blank or has no Arabic."""
    kept = strip(F.coalesce(answer, F.lit("")))
    return F.when(kept.rlike(ARABIC_MAIN), kept).otherwise(ocr)


def token_estimate(c: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(F.length(c) / 4)).cast("long")


def char_ngrams(c: Column, n: int) -> Column:
    """All n-grams of characters, in order, with repeats."""
    return F.when(F.length(c) >= n, F.transform(F.sequence(F.lit(1), F.length(c) - n + 1), lambda i: F.substring(c, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))


def dataset_parts(key: Column) -> Column:
    """``family, font, split`` of a dataset key, the most specific family first."""
    tail, none = F.lower(F.element_at(F.split(key, "-"), -1)), F.lit(None).cast("string")
    parts = lambda family, font, split: F.struct(F.lit(family).alias("family"), font.alias("font"), split.alias("split"))
    out = F.when(key.startswith("PATS-A01-"), parts("PATS-A01", F.regexp_extract(key, "^PATS-A01-(.+)-[^-]+$", 1), tail))
    for family in ("KHATT-Paragraph", "KHATT", "Yarmouk", "Muharaf"):
        out = out.when(key.startswith(f"{family}-"), parts(family, none, tail))
    out = out.when(key.startswith("Kitab-"), parts("Kitab", F.substring(key, 7, 1000), none))
    return out.when(key.startswith("Historical"), parts("Historical", F.nullif(F.substring(key, 12, 1000), F.lit("")), none))


def is_training(key: Column) -> Column:
    """Whether a data set key names a training split."""
    return F.lower(key).endswith("train")


def is_validation(key: Column) -> Column:
    """Whether a data set key names a validation split."""
    return F.lower(key).endswith("-val") | F.lower(key).endswith("validation")


def sample_number(c: Column) -> Column:
    """The number of an id ``dataset:Font_Number``; null without a colon, or where other than digits follow the first underscore after it."""
    return F.nullif(F.regexp_extract(c, ":[^:_]*_([0-9]+)$", 1), F.lit("")).cast("long")


def paragraph_id(stem: Column) -> Column:
    """The stem of a line's file without the line's number."""
    return F.regexp_replace(stem, "_[^_]*$", "")


def trailing_number(c: Column) -> Column:
    """The number after the last underscore of an id, else null."""
    return F.nullif(F.regexp_extract(c, "_([0-9]+)$", 1), F.lit("")).cast("long")
