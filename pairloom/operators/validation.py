"""Words against a lexicon table, and corrections reverted by it (AGG16-AGG18, JON07, JON08, UDF07-UDF09), runaway texts cut (FN13-FN15, AGG26)."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairloom.functions.text import ARABIC, collapse_tatweel, rstrip, tokens
from pairloom.operators.relational import zipped


def token_validity(pairs: DataFrame, lexicon: DataFrame, by: list[str], letters: str = ARABIC) -> DataFrame:
    """Tokens of reference and hypothesis by position: shares of known words, and of known words that are wrong, unknown words, and both unknown."""
    own = lambda c: F.filter(tokens(F.col(c)), lambda x: x.rlike(letters))
    zips = pairs.select(*by, F.explode(zipped(own("gt_text"), own("ocr_text"))).alias("z")).select(*by, F.col("z.a").alias("gt"), F.col("z.b").alias("ocr"))
    known = lexicon.select("word").distinct().withColumn("k", F.lit(True))
    counted = zips.groupBy(*by, "gt", "ocr").agg(F.count("*").alias("n"))  # each distinct pair is looked up once
    looked = counted.join(known.withColumnRenamed("word", "gt").withColumnRenamed("k", "gt_known"), "gt", "left").join(known.withColumnRenamed("word", "ocr").withColumnRenamed("k", "ocr_known"), "ocr", "left")
    g, o = F.coalesce("gt_known", F.lit(False)), F.coalesce("ocr_known", F.lit(False))
    n = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0)).cast("long")
    return looked.groupBy(*by).agg(
        F.sum("n").cast("long").alias("tokens"), n(g).alias("gt_valid"), n(o).alias("ocr_valid"), n(o & (F.col("gt") != F.col("ocr"))).alias("valid_but_wrong"), n(~o & g).alias("non_word"), n(~o & ~g).alias("both_invalid")
    )


def text_validity(texts: DataFrame, lexicon: DataFrame | None, key: str, text: str, letters: str = ARABIC) -> DataFrame:
    """``key, rate``: share of a text's words that the lexicon has; 1 for a text without words. Without a lexicon (an analyser that is switched off) every rate is 0."""
    if lexicon is None:
        return texts.select(key, F.lit(0.0).alias("rate"))
    words = texts.select(key, F.explode(F.filter(tokens(F.col(text)), lambda x: x.rlike(letters))).alias("word"))
    hit = words.join(lexicon.select("word").distinct().withColumn("k", F.lit(1)), "word", "left").groupBy(key).agg((F.count("k") / F.count("*")).alias("rate"))
    return texts.select(key).join(hit, key, "left").select(key, F.coalesce("rate", F.lit(1.0)).alias("rate"))


def reverted(corrections: DataFrame, lexicon: DataFrame, known_wrong: DataFrame | None = None, letters: str = ARABIC) -> DataFrame:
    """``sample_id, final_text, reverted, kept, unchanged, revert_rate``: a corrected word goes back to the OCR's where that pair is a known
    over-correction, or the new word is unknown and the old one known. Texts whose numbers of words differ stay as they are. Separators are kept."""
    rows = corrections.select("sample_id", F.coalesce("corrected_text", "ocr_text").alias("llm"), F.col("ocr_text").alias("ocr"))
    own = lambda c: F.filter(tokens(F.col(c)), lambda x: x.rlike(letters))
    rows = rows.withColumn("a", own("llm")).withColumn("b", own("ocr"))
    pairs = rows.where(F.size("a") == F.size("b")).select("sample_id", F.posexplode(F.arrays_zip("a", "b")).alias("at", "z")).select("sample_id", "at", F.col("z.a").alias("new"), F.col("z.b").alias("old"))
    known = lexicon.select("word").distinct().withColumn("k", F.lit(True))
    looked = pairs.join(known.toDF("new", "new_known"), "new", "left").join(known.toDF("old", "old_known"), "old", "left")
    listed = F.lit(False)
    if known_wrong is not None:
        looked = looked.join(known_wrong.select("new", "old").distinct().withColumn("listed", F.lit(True)), ["new", "old"], "left")
        listed = F.coalesce("listed", F.lit(False))
    back = (F.col("new") != F.col("old")) & (listed | (F.col("new_known").isNull() & F.col("old_known").isNotNull()))
    marks = looked.withColumn("back", back).groupBy("sample_id").agg(
        F.array_sort(F.collect_list(F.struct("at", "back", "old"))).alias("marks"), F.count_if("back").alias("reverted"), F.count_if((F.col("new") != F.col("old")) & ~F.col("back")).alias("kept"), F.count_if(F.col("new") == F.col("old")).alias("unchanged")
    )
    out = rows.join(marks, "sample_id", "left")
    text = F.when(F.coalesce(F.col("reverted"), F.lit(0)) > 0, put_back("llm", F.transform("marks", lambda m: F.when(m["back"], m["old"])), F.lit(letters))).otherwise(F.col("llm"))
    n = F.coalesce(F.col("reverted") + F.col("kept") + F.col("unchanged"), F.lit(0))
    return out.select("sample_id", text.alias("final_text"), F.coalesce("reverted", F.lit(0)).alias("reverted"), F.coalesce("kept", F.size("a").cast("long")).alias("kept"), F.coalesce("unchanged", F.lit(0)).alias("unchanged"), F.coalesce(F.try_divide("reverted", n), F.lit(0.0)).alias("revert_rate"))


def revert_statistics(rows: DataFrame) -> DataFrame:
    """One row over the results of ``reverted``; the rate is that of all words, 0 without words."""
    words = F.sum(F.col("reverted") + F.col("kept") + F.col("unchanged"))
    rate = F.coalesce(F.sum("reverted"), F.lit(0)) / F.greatest(F.coalesce(words, F.lit(0)), F.lit(1))
    sums = [F.coalesce(F.sum(c), F.lit(0)).alias(f"words_{c}") for c in ("reverted", "kept", "unchanged")]
    return rows.agg(F.count("*").alias("total_samples"), F.count_if(F.col("reverted") > 0).alias("samples_with_reverts"), F.coalesce(words, F.lit(0)).alias("total_words"), *sums, F.round(rate, 4).alias("avg_revert_rate"), F.round(rate * 100, 2).alias("revert_rate_pct"))


_TOKEN = re.compile(r"[^\s،؛؟!-/:-@[-`{-~]+")


@F.pandas_udf(T.StringType())
def put_back(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """A text with its n-th word replaced where the n-th mark is no null; only rows with something to put back get here."""
    for texts, marks, letters in batches:
        out = []
        for text, words, pattern in zip(texts, marks, letters):
            if words is None:
                out.append(text)
                continue
            turn, wanted = iter(list(words)), re.compile(pattern.encode().decode("unicode_escape"))
            out.append(_TOKEN.sub(lambda m: (next(turn, None) or m.group()) if wanted.search(m.group()) else m.group(), text))  # noqa: B023
        yield pd.Series(out)


# Shortest and longest phrase of a loop, the gap allowed between two copies (characters, share of the phrase), how far loops are looked for
# (times the reference, characters), and where a first copy must begin (times the reference).
PHRASE, GAP, ZONE, FIRST_COPY = (6, 80), (5, 0.3), (4, 300), 2


def second_copies(text: str, ref_len: int, letter: re.Pattern) -> int | None:
    """Where a text begins to repeat itself: the second copy of the shortest phrase with a letter that comes twice in a row, the first of equally short ones.

    One row of run lengths for each lag: characters from i on equal those ``lag`` further on for ``run[i]`` places, so a phrase of any length up
    to that is repeated there."""
    zone = text[: max(ZONE[0] * ref_len, ZONE[1])]
    points = np.frombuffer(zone.encode("utf-32-le", "surrogatepass"), np.uint32)
    n, sizes = len(points), np.arange(PHRASE[0], PHRASE[1] + 1)
    reach = sizes + np.maximum(GAP[0], (sizes * GAP[1]).astype(int))  # the greatest lag of each phrase length
    is_letter = np.fromiter((bool(letter.match(c)) for c in zone), bool, n)
    place = np.arange(n)
    next_letter = np.minimum.accumulate(np.where(is_letter, place, 2 * n + PHRASE[1])[::-1])[::-1] if n else place
    best: tuple[int, int, int] | None = None
    for lag in range(PHRASE[0], min(int(reach[-1]), n - PHRASE[0]) + 1):
        differs = np.flatnonzero(points[:-lag] != points[lag:])
        start = place[: n - lag]
        run = np.append(differs, n - lag)[np.searchsorted(differs, start)] - start
        size = np.maximum(max(PHRASE[0], int(sizes[np.searchsorted(reach, lag)])), next_letter[: n - lag] - start + 1)
        good = np.flatnonzero((size <= np.minimum(run, min(lag, PHRASE[1], n // 2))) & (start < np.minimum(n - 2 * size, FIRST_COPY * ref_len)))
        if len(good):
            k = good[np.lexsort((good, size[good]))[0]]
            best = min(best or (n, n, n), (int(size[k]), int(k), lag))
    return None if best is None else best[1] + best[2]


def without_runaways(records: DataFrame, ratio: float = 3.0, letters: str = "[؀-ۿ]") -> DataFrame:
    """Adds ``corrected_text_fixed``: of texts over ``ratio`` times the reference a flood of tatweels goes, a loop is cut where it repeats, else twice the reference stays.

    The cases are expressions; only the search for loops, in runaways that are no flood, is a Python function."""

    @F.pandas_udf(T.IntegerType())
    def repeats_at(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        letter = re.compile(letters)
        for texts, lengths in batches:
            yield pd.Series([second_copies(t, int(n), letter) for t, n in zip(texts, lengths)], dtype="Int32")

    size = lambda c: F.coalesce(F.length(c), F.lit(0))
    ref = F.when(size("gt_text") > 0, F.greatest(size("gt_text"), F.lit(10))).when(size("ocr_text") > 0, F.greatest(size("ocr_text"), F.lit(10))).otherwise(50)
    text, work = F.col("corrected_text"), F.col("_work")
    marked = records.withColumn("_ref", ref).withColumn("_long", size("corrected_text") > F.greatest(F.col("_ref") * ratio, F.lit(50.0)))
    marked = marked.withColumn("_work", F.when(F.col("_long"), collapse_tatweel(text))).withColumn("_flood", F.coalesce(F.length(work) < 0.15 * F.length(text), F.lit(False)))
    flooded = F.when(F.length(F.regexp_replace(work, f"(?!{letters})[\\s\\S]", "")) >= 3, work).otherwise(F.lit(""))
    plain = marked.where("NOT _long OR _flood").withColumn("corrected_text_fixed", F.when(F.col("_flood"), flooded).otherwise(text))
    # two branches, as Spark works a Python function out for every row of its projection
    looped = marked.where("_long AND NOT _flood").withColumn("_at", repeats_at(work, F.col("_ref")))
    head = rstrip(F.substring(work, F.lit(1), F.coalesce("_at", F.lit(0))))
    whole = (F.length(head) >= 3) & head.rlike(letters)
    cut = looped.withColumn("corrected_text_fixed", F.when(whole, head).otherwise(rstrip(F.substring(work, F.lit(1), 2 * F.col("_ref"))))).drop("_at")
    return plain.unionByName(cut).drop("_long", "_ref", "_work", "_flood")


def runaway_stats(fixed: DataFrame) -> DataFrame:
    same = F.col("corrected_text_fixed").eqNullSafe(F.col("corrected_text"))
    empty = F.col("corrected_text_fixed") == ""
    return fixed.agg(F.count("*").alias("total"), F.count_if(~same & ~empty).alias("fixed"), F.count_if(same).alias("unchanged"), F.count_if(~same & empty).alias("emptied"))
