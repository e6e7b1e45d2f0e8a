"""Error tables from alignments: exploded errors, confusion matrices, taxonomies, word pairs (ALN03-ALN05, AGG09-AGG12, AGG21, FLT13-FLT16, TOP01, TOP03, JON09, JON15, KB02-KB05)."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairloom.functions import batches
from pairloom.functions.classify import ERROR_TYPES, GROUP_NAMES, POSITIONS, confusion_type
from pairloom.functions.edit import char_errors
from pairloom.functions.text import is_arabic, normalise, tokens
from pairloom.plans.shared import kept


_CHAR = "at int, gt_char string, ocr_char string, error_type string, position string, context string"
_WORD = "at int, gt_word string, ocr_word string, is_merged boolean, is_split boolean"


def _aligned(pairs: DataFrame, hypothesis: str, keep: list[str], words: bool, task: Callable, made: str) -> DataFrame:
    """What ``task`` makes of the batches of pairs that differ. Equal texts are sent to Python as nulls, as a filter on normalised texts would normalise them twice."""
    rows = pairs.withColumn("ref", normalise(F.col("gt_text"))).withColumn("hyp", normalise(F.col(hypothesis)))
    text = lambda c: F.when(F.col("ref") != F.col("hyp"), tokens(F.col(c)) if words else F.col(c)).alias(c)
    sent = rows.select(*keep, text("ref"), text("hyp"))
    kinds = [f"`{c}` {sent.schema[c].dataType.simpleString()}" for c in keep]
    return sent.mapInArrow(task, ", ".join([*kinds, made]))


def char_error_rows(pairs: DataFrame, hypothesis: str = "ocr_text", first: int | None = None) -> DataFrame:
    """One row per character error of ``pairs`` (``dataset, sample_id, ord, gt_text`` and the hypothesis); ``first``: so many of each type of a pair, which is all that as many examples need."""
    return _aligned(pairs, hypothesis, ["dataset", "sample_id", "ord"], False, partial(batches.error_rows, first=first), _CHAR)


def char_error_tallies(pairs: DataFrame, by: list[str], hypothesis: str = "ocr_text") -> DataFrame:
    """``by, gt_char, ocr_char, error_type, position, count``: partial counts of character errors, of each batch; summaries of errors take them in place of rows."""
    return _aligned(pairs, hypothesis, by, False, batches.error_tallies, "gt_char string, ocr_char string, error_type string, position string, count long")


def word_error_rows(pairs: DataFrame, hypothesis: str = "ocr_text") -> DataFrame:
    return _aligned(pairs, hypothesis, ["dataset", "sample_id", "ord"], True, batches.word_rows, _WORD)


def word_error_tallies(pairs: DataFrame, hypothesis: str = "ocr_text") -> DataFrame:
    """``dataset, sample_id, gt_word, ocr_word, count``: how often each pair has each word error."""
    return _aligned(pairs, hypothesis, ["dataset", "sample_id"], True, batches.word_tallies, "gt_word string, ocr_word string, count long")


def _number(errors: DataFrame) -> Column:
    """How many errors rows or partial counts stand for."""
    return F.sum("count") if "count" in errors.columns else F.count("*")


def confusion_matrix(errors: DataFrame, by: list[str], min_count: int = 2, arabic_only: bool = True) -> DataFrame:
    """``by, gt_char, ocr_char, count, probability``: substitutions; the probability is of all of a character's, rare ones included."""
    subs = errors.where("gt_char <> '' AND ocr_char <> ''")
    if arabic_only:
        subs = subs.where(is_arabic(F.col("gt_char")) & is_arabic(F.col("ocr_char")))
    counted = subs.groupBy(*by, "gt_char", "ocr_char").agg(_number(subs).alias("count"))
    share = F.col("count") / F.sum("count").over(Window.partitionBy(*by, "gt_char"))
    return counted.withColumn("probability", share).where(F.col("count") >= min_count)


def pooled(matrix: DataFrame) -> DataFrame:
    """One matrix over all datasets, its probabilities worked out anew."""
    summed = matrix.groupBy("gt_char", "ocr_char").agg(F.sum("count").alias("count"))
    return summed.withColumn("probability", F.col("count") / F.sum("count").over(Window.partitionBy("gt_char")))


def top_confusions(matrix: DataFrame, n: int = 20) -> DataFrame:
    return matrix.orderBy(F.desc("count"), "gt_char", "ocr_char").limit(n)


def enough_data(errors: DataFrame, least: int = 200) -> DataFrame:
    n = F.count_if((F.col("gt_char") != "") & (F.col("ocr_char") != ""))
    return errors.groupBy("dataset").agg(n.alias("substitutions"), (n >= least).alias("enough"))


def matrix_or_pooled(wanted: DataFrame, own: DataFrame, whole: DataFrame, least: int = 200) -> DataFrame:
    """For each dataset of ``wanted`` its own matrix if that has enough counts, else the pooled one, else nothing; with the source."""
    sizes = own.groupBy("dataset").agg(F.sum("count").alias("total"))
    enough = wanted.join(sizes, "dataset", "left").withColumn("source", F.when(F.col("total") >= least, "dataset").otherwise("pooled"))
    mine = enough.where("source = 'dataset'").join(own, "dataset").select("dataset", "source", "gt_char", "ocr_char", "count", "probability")
    rest = enough.where("source = 'pooled'").withColumn("one", F.lit(1)).join(whole.withColumn("one", F.lit(1)), "one")
    return mine.unionByName(rest.select("dataset", "source", "gt_char", "ocr_char", "count", "probability"))


def taxonomy(errors: DataFrame, by: list[str]) -> DataFrame:
    """``by, level, value, count, pct``: errors by type and by position, zeros included."""
    errors = errors.groupBy(*by, "error_type", "position").agg(_number(errors).alias("count"))
    sets = errors.select(*by, "count", F.explode(F.array(F.struct(F.lit("type").alias("level"), F.col("error_type").alias("value")), F.struct(F.lit("position").alias("level"), F.col("position").alias("value")))).alias("x")).select(*by, "count", "x.*")
    counted = kept(sets.groupBy(*by, "level", "value").agg(F.sum("count").alias("count")), "taxonomy")
    names = errors.sparkSession.createDataFrame([("type", x) for x in ERROR_TYPES] + [("position", x) for x in POSITIONS], "level string, value string")
    frame = counted.select(*by).distinct().withColumn("one", F.lit(1)).join(names.withColumn("one", F.lit(1)), "one").drop("one")
    full = frame.join(counted, [*by, "level", "value"], "left").withColumn("count", F.coalesce("count", F.lit(0)).cast("long"))
    return full.withColumn("pct", F.try_divide(F.col("count") * 100.0, F.sum("count").over(Window.partitionBy(*by, "level"))))


def word_level(words: DataFrame, by: list[str]) -> DataFrame:
    """Merges, splits, substitutions, lost and added words; splits are among the lost."""
    gt, ocr = F.col("gt_word") != "", F.col("ocr_word") != ""
    return words.groupBy(*by).agg(F.count_if("is_merged").alias("merged"), F.count_if("is_split").alias("split"), F.count_if(gt & ocr & ~F.col("is_merged")).alias("substituted"), F.count_if(gt & ~ocr).alias("lost"), F.count_if(~gt & ocr).alias("added"))


def first_examples(errors: DataFrame, by: list[str], n: int = 5) -> DataFrame:
    """The first ``n`` examples of each type in input order. Each batch of errors passes on its own first ones, so that few are sorted."""
    order = ["ord", "sample_id", "at"]
    errors = errors.select(*by, "error_type", *order, "gt_char", "ocr_char", "context")

    def firsts(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            found = batch.take(pc.sort_indices(batch, [(c, "ascending") for c in order], null_placement="at_start"))
            place = found.select([*by, "error_type"]).to_pandas().groupby([*by, "error_type"], dropna=False, sort=False).cumcount()
            yield found.filter(pa.array(place < n))

    errors = errors.mapInArrow(firsts, errors.schema)
    ranked = errors.withColumn("k", F.row_number().over(Window.partitionBy(*by, "error_type").orderBy(*order))).where(F.col("k") <= n)
    return ranked.groupBy(*by, "error_type").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "gt_char", "ocr_char", "context"))), lambda x: F.struct(x["gt_char"].alias("gt"), x["ocr_char"].alias("ocr"), x["context"].alias("context"))).alias("examples"))


def word_pairs(words: DataFrame, arabic_only: bool = True) -> DataFrame:
    """``wrong, right, count, first``: how often a word stood for another."""
    both = words.where("gt_word <> '' AND ocr_word <> ''")
    if arabic_only:
        both = both.where(is_arabic(F.col("gt_word")) & is_arabic(F.col("ocr_word")))
    return both.groupBy(F.col("ocr_word").alias("wrong"), F.col("gt_word").alias("right")).agg(F.count("*").alias("count"), F.min(F.struct("ord", "at")).alias("first"))


def top_pairs(pairs: DataFrame, n: int = 200) -> DataFrame:
    """The most frequent pairs; of equal ones those met first."""
    return pairs.orderBy(F.desc("count"), "first", "wrong", "right").limit(n).select("wrong", "right", "count")


def unfixed_and_introduced(ocr_words: DataFrame, llm_words: DataFrame) -> DataFrame:
    """Errors left in corrections, each tagged by whether the OCR text had the same error in the same sample; both may be rows or tallies."""
    key = ["dataset", "sample_id", "gt_word", "ocr_word"]
    had = ocr_words.select(*key).distinct().withColumn("had", F.lit(True))
    return llm_words.join(had, key, "left").withColumn("kind", F.when(F.col("had"), "unfixed").otherwise("introduced")).drop("had")


def confusions_in_failures(matrix: DataFrame, pairs: DataFrame) -> DataFrame:
    """Confusions that occur in the alignment of some wrong word with the right one."""
    seen = pairs.select(F.explode(char_errors("right", "wrong")).alias("e")).select("e.gt_char", "e.ocr_char").distinct()
    return matrix.join(seen, ["gt_char", "ocr_char"], "left_semi")


def format_confusions(matrix: DataFrame, n: int = 20) -> DataFrame:
    """One text with a line per confusion, most frequent first; empty if there is none."""
    best = top_confusions(matrix, n)
    line = F.format_string("%s → %s (%d%%)", "gt_char", "ocr_char", F.bround(F.col("probability") * 100).cast("int"))
    rows = best.agg(F.array_sort(F.collect_list(F.struct((-F.col("count")).alias("k"), "gt_char", "ocr_char", line.alias("line")))).alias("rows"))
    return rows.select(F.array_join(F.transform("rows", lambda x: x["line"]), "\n").alias("text"))


def format_confusions_by_group(matrix: DataFrame, n: int = 20) -> DataFrame:
    """One text with a line for each group of letters (``GROUP_NAMES`` in order), which names the pairs of the ``n`` most frequent confusions that fall into it; empty if there is none."""
    best = top_confusions(matrix, n).withColumn("group", confusion_type(F.col("gt_char"), F.col("ocr_char")))
    order = F.array_position(F.lit(list(GROUP_NAMES)), F.col("group"))
    named = F.get(F.lit(list(GROUP_NAMES.values())), (order - 1).cast("int"))
    pair = F.struct((-F.col("count")).alias("k"), "gt_char", "ocr_char", F.format_string("%s ~ %s", "gt_char", "ocr_char").alias("pair"))
    lines = best.groupBy(order.alias("at"), named.alias("name")).agg(F.array_sort(F.collect_list(pair)).alias("pairs"))
    line = F.format_string("- %s: %s", "name", F.array_join(F.transform("pairs", lambda x: x["pair"]), ", "))
    rows = lines.agg(F.array_sort(F.collect_list(F.struct("at", line.alias("line")))).alias("rows"))
    return rows.select(F.array_join(F.transform("rows", lambda x: x["line"]), "\n").alias("text"))
