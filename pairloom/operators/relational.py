"""Joins, set operations, limits and windows of the data preparation steps (JON01-JON07, JON10-JON13, JON18-JON20, SET01-SET06, WIN02, WIN07, TOP07, SRC22)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairloom.operators.prefix_sums import running_totals


def by_stem(ocr: DataFrame, gt: DataFrame, on: str = "stem") -> DataFrame:
    """Pairs of both sides, and what either side lacks, told apart by ``side``."""
    both = ocr.withColumn("_o", F.lit(1)).join(gt.withColumn("_g", F.lit(1)), on, "full_outer")
    side = F.when(F.col("_g").isNull(), "ocr_only").when(F.col("_o").isNull(), "gt_only").otherwise("both")
    return both.withColumn("side", side).drop("_o", "_g")


def by_line_number(files: DataFrame, lines: DataFrame) -> DataFrame:
    """OCR files ``.._N`` with line N (from 1) of one ground truth file; files without a number or line find nothing."""
    numbered = files.withColumn("line_no", F.nullif(F.regexp_extract("file_id", "_([0-9]+)$", 1), F.lit("")).cast("long"))
    return numbered.join(lines, "line_no")


def pending(rows: DataFrame, done: DataFrame, on: list[str]) -> DataFrame:
    return rows.join(done.select(*on).distinct(), on, "left_anti")


def with_baseline(results: DataFrame, preferred: DataFrame, alternate: DataFrame, on: str, value: str) -> DataFrame:
    """Each result with the preferred baseline, or else the alternate one, and which it is."""
    p, a = preferred.select(on, F.col(value).alias("_p")), alternate.select(on, F.col(value).alias("_a"))
    out = results.join(p, on, "left").join(a, on, "left")
    source = F.when(F.col("_p").isNotNull(), "preferred").when(F.col("_a").isNotNull(), "alternate")
    return out.withColumn("baseline", F.coalesce("_p", "_a")).withColumn("baseline_source", source).drop("_p", "_a")


def zipped(a: Column, b: Column) -> Column:
    """Elements of two arrays by position, as far as the shorter one goes."""
    n = F.least(F.size(a), F.size(b))
    return F.arrays_zip(F.slice(a, F.lit(1), n).alias("a"), F.slice(b, F.lit(1), n).alias("b"))


def last_line_of_text(lines: DataFrame) -> DataFrame:
    """``text, line_no``: of equal lines the last."""
    return lines.groupBy("text").agg(F.max("line_no").alias("line_no"))


def common_to_all(rows: DataFrame, key: str, group: str) -> DataFrame:
    """Keys that every group has."""
    n = rows.select(F.count_distinct(group).alias("groups"))
    found = rows.groupBy(key).agg(F.count_distinct(group).alias("k"))
    return found.join(F.broadcast(n), F.col("k") == F.col("groups")).select(key)


def overlap(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Rows of a, marked by whether b has their key."""
    return a.join(b.select(key).distinct().withColumn("_b", F.lit(True)), key, "left").withColumn("in_both", F.coalesce("_b", F.lit(False))).drop("_b")


def merged_records(local: DataFrame, remote: DataFrame, on: str) -> DataFrame:
    """All records of both sides; where both have one, the remote one."""
    sides = local.withColumn("_p", F.lit(1)).unionByName(remote.withColumn("_p", F.lit(0)))
    ranked = sides.withColumn("_k", F.row_number().over(Window.partitionBy(on).orderBy("_p")))
    return ranked.where("_k = 1").withColumn("origin", F.when(F.col("_p") == 0, "remote").otherwise("local")).drop("_p", "_k")


def with_variants(documents: DataFrame, images: DataFrame) -> DataFrame:
    """Documents with images of their stem or of its halves ``_a`` and ``_b``, case apart; none is kept as null."""
    keys = documents.withColumn("_key", F.explode(F.array(F.lower("stem"), F.concat(F.lower("stem"), F.lit("_a")), F.concat(F.lower("stem"), F.lit("_b")))))
    found = keys.join(images.select(F.lower("image_stem").alias("_key"), "image_stem"), "_key").drop("_key")
    return documents.join(found.select("stem", "image_stem"), "stem", "left")


def train_key(key: Column) -> Column:
    """The training counterpart of a validation key."""
    return F.regexp_replace(key, "-(val|validation|test)$", "-train")


def disjoint(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    return a.select(key).intersect(b.select(key)).agg(F.count("*").alias("shared")).select("shared", (F.col("shared") == 0).alias("disjoint"))


def first_per_group(rows: DataFrame, by: list[str], order: list, n: int = 1) -> DataFrame:
    """The first ``n`` rows of each group."""
    return rows.withColumn("k", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("k") <= n)


def last_per_key(rows: DataFrame, by: list[str], order: str, value: str) -> DataFrame:
    return rows.groupBy(*by).agg(F.max_by(value, order).alias(value))


def running_counts(rows: DataFrame, by: list[str], order: list[str], value: str) -> DataFrame:
    """``rows`` with ``running``, the sum of ``value`` so far in its group, in two levels."""
    return running_totals(rows, by, order, {"running": value})


def joined_pages(pages: DataFrame, by: str, order: str, text: str = "text") -> DataFrame:
    """Texts of a group in order, joined by line breaks."""
    rows = F.array_sort(F.collect_list(F.struct(F.col(order).alias("k"), F.coalesce(text, F.lit("")).alias("t"))))
    return pages.groupBy(by).agg(F.array_join(F.transform(rows, lambda x: x["t"]), "\n").alias("text"), F.count("*").alias("pages"))
