"""Readers: paired files, split manifests, JSON lines, tagged pages, HTML, archives (SRC01-SRC19, SRC21, SRC22, SRC24, SRC27). Every reader takes paths that Spark can read."""

from __future__ import annotations

import html as html_lib
import io
import re
import warnings
import zipfile
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairloom.functions.text import LINE_CAP, read_ocr, strip

CORRECTIONS = (
    "sample_id string, dataset string, ocr_source string, ocr_text string, corrected_text string, gt_text string, model string, prompt_type string, prompt_version string, "
    "prompt_tokens long, output_tokens long, latency_s double, success boolean, error string"
)


def files(spark: SparkSession, path: str) -> DataFrame:
    """``stem, file_id, path, content`` of the text files below a path."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.txt").load(path)
    name = F.regexp_extract("path", "([^/]+)\\.[^./]+$", 1)
    return raw.select(name.alias("stem"), name.alias("file_id"), "path", "content")


def decoded(content: Column, encoding: str = "utf-8") -> Column:
    """Text of bytes; invalid UTF-8 is replaced."""
    return F.make_valid_utf8(content.cast("string")) if encoding.lower().replace("_", "-") == "utf-8" else decode_bytes(content, F.lit(encoding))


@F.pandas_udf(T.StringType())
def decode_bytes(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """Other encodings, such as cp1256, which Spark's own decode refuses."""
    for raw, encoding in batches:
        yield pd.Series([None if r is None else bytes(r).decode(e, "replace") for r, e in zip(raw, encoding)], dtype="object")


def paired_files(spark: SparkSession, ocr_path: str, gt_path: str, dataset: str, encoding: str = "utf-8", cap: int = LINE_CAP, ids: DataFrame | None = None) -> DataFrame:
    """``dataset, sample_id, ocr_text, gt_text, ocr_path, gt_path``: files of both folders with one stem; blank texts are left out."""
    ocr = files(spark, ocr_path).select("stem", read_ocr(F.col("content"), cap).alias("ocr_text"), F.col("path").alias("ocr_path"))
    gt = files(spark, gt_path).select("stem", strip(decoded(F.col("content"), encoding)).alias("gt_text"), F.col("path").alias("gt_path"))
    both = ocr.join(gt, "stem").where("ocr_text <> '' AND gt_text <> ''").withColumnRenamed("stem", "sample_id")
    if ids is not None:
        both = both.join(ids.select("sample_id").distinct(), "sample_id", "left_semi")
    return both.select(F.lit(dataset).alias("dataset"), "sample_id", "ocr_text", "gt_text", "ocr_path", "gt_path")


def font_file(root: str, font: str) -> str:
    """The ground truth file of a font; one font's has no prefix (names are fixed)."""
    return f"{root}/PATS_A01_Dataset/{'TraditionalText.txt' if font == 'Traditional' else f'A01-{font}Text.txt'}"


def font_lines(spark: SparkSession, ocr_path: str, gt_file: str, dataset: str, encoding: str = "cp1256", cap: int = LINE_CAP) -> DataFrame:
    """Files ``.._N`` paired with line N of one ground truth file; blank lines before the first text do not count."""
    gt = spark.read.format("binaryFile").load(gt_file).select(F.posexplode(F.split(strip(decoded(F.col("content"), encoding)), "\\r\\n|[\\n\\r\\x0b\\x0c\\x1c-\\x1e\\x85\\u2028\\u2029]")).alias("at", "gt_text")).select((F.col("at") + 1).cast("long").alias("line_no"), strip(F.col("gt_text")).alias("gt_text"))
    ocr = files(spark, ocr_path).select("file_id", read_ocr(F.col("content"), cap).alias("ocr_text")).withColumn("line_no", F.nullif(F.regexp_extract("file_id", "_([0-9]+)$", 1), F.lit("")).cast("long"))
    return ocr.join(gt, "line_no").where("ocr_text <> '' AND gt_text <> ''").select(F.lit(dataset).alias("dataset"), F.col("file_id").alias("sample_id"), F.col("line_no").alias("ord"), "ocr_text", "gt_text")


# The registered families with the encoding of their references, the cap of their OCR texts and how their files pair up.
FAMILIES = {
    "PATS-A01": ("cp1256", 2000, "lines"), "KHATT": ("utf-8", 2000, "stems"), "KHATT-Paragraph": ("cp1256", 8000, "stems"), "Kitab": ("utf-8", 8000, "category"), "Yarmouk": ("utf-8", 8000, "stems"),
    "Historical": ("utf-8", 8000, "books"), "Muharaf": ("utf-8", 8000, "stems"),
}


def family(key: str) -> tuple[str, int, str]:
    """What is registered for a data set key; the longest family name that it starts with counts."""
    known = [k for k in FAMILIES if key.startswith(k)]
    if not known:
        raise ValueError(f"no such data set: {key}")
    return FAMILIES[max(known, key=len)]


def load(spark: SparkSession, key: str, ocr: str, gt: str, ids: DataFrame | None = None, limit: int | None = None) -> DataFrame:
    """``dataset, sample_id, font, ocr_text, gt_text`` of one data set by its key, ids (``sample_id``, any case) before the limit.

    Sets of lines have one reference file per font, sets by category the id ``category_stem`` (the category is the key's last part, and the font), sets
    of books one folder per book, which is the font."""
    encoding, cap, how = family(key)
    last = key.rsplit("-", 1)[-1]
    if how == "lines":
        rows = font_lines(spark, ocr, gt, key, encoding, cap).withColumn("font", F.lit(last))
    else:
        rows = paired_files(spark, ocr, gt, key, encoding, cap).withColumn("font", F.lit(None).cast("string"))
        if how == "category":
            rows = rows.withColumn("font", F.lit(last)).withColumn("sample_id", F.concat_ws("_", F.lit(last), "sample_id"))
        elif how == "books":
            rows = rows.withColumn("font", F.regexp_extract("ocr_path", "([^/]+)/[^/]+$", 1))
    rows = rows.select("dataset", "sample_id", "font", "ocr_text", "gt_text")
    if ids is not None:
        wanted = ids.select(F.lower("sample_id").alias("_id")).distinct()
        rows = rows.join(wanted, F.lower("sample_id") == F.col("_id"), "left_semi")
    if limit is not None:
        number = F.nullif(F.regexp_extract("sample_id", "([0-9]+)$", 1), F.lit("")).cast("decimal(38,0)")
        rows = rows.orderBy(number.isNull(), number, "sample_id").limit(limit)
    return rows


def exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def load_all(spark: SparkSession, folders: dict[str, tuple[str, str]], limit: int | None = None) -> DataFrame:
    """The union of the data sets ``key: (OCR folder, ground truth)``; sets whose folders are missing are left out with a warning."""
    out = None
    for key, (ocr, gt) in folders.items():
        family(key)
        if not (exists(spark, ocr) and exists(spark, gt)):
            warnings.warn(f"{key}: {ocr} or {gt} is missing", stacklevel=2)
            continue
        part = load(spark, key, ocr, gt, limit=limit)
        out = part if out is None else out.unionByName(part)
    return out if out is not None else spark.createDataFrame([], "dataset string, sample_id string, font string, ocr_text string, gt_text string")


def corrections(spark: SparkSession, folder: str, name: str = "corrections.jsonl") -> DataFrame:
    """The records of a run: one combined file if there is one, else the files of all data sets below the folder; empty where there is neither."""
    if exists(spark, f"{folder}/{name}"):
        return json_lines(spark, f"{folder}/{name}")
    if exists(spark, folder):
        found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", name).load(folder).select("path")
        if paths := [r.path for r in found.orderBy("path").collect()]:  # one path per data set
            return json_lines(spark, paths)
    return spark.createDataFrame([], CORRECTIONS)


def first_corrections(spark: SparkSession, folders: list[str], name: str = "corrections.jsonl") -> DataFrame:
    """The records of the first folder that has any."""
    for folder in folders:
        if not (rows := corrections(spark, folder, name)).isEmpty():
            return rows
    raise FileNotFoundError(f"no {name} in {folders}")


def sniffed(content: Column, within: int = 500) -> Column:
    """Text of bytes in UTF-8, with or without a byte order mark, or cp1256: the first of them that is valid and shows an Arabic letter in its first ``within``
    characters, else UTF-8 with what is invalid replaced."""
    plain = F.regexp_replace(F.try_validate_utf8(content.cast("string")), "^\ufeff", "")
    arabic = lambda c: F.coalesce(F.substring(c, 1, within).rlike("[\u0600-\u06FF]"), F.lit(False))
    old = decode_bytes(content, F.lit("cp1256"))
    return F.when(arabic(plain), plain).when(arabic(old), old).otherwise(decoded(content))


def second_ocr(samples: DataFrame, other: DataFrame) -> DataFrame:
    """The same samples with another engine's texts (``dataset, sample_id, ocr_text``); samples that it lacks are left out."""
    texts = other.select("dataset", "sample_id", F.col("ocr_text").alias("_other"))
    return samples.join(texts, ["dataset", "sample_id"]).withColumn("ocr_text", F.col("_other")).drop("_other")


def json_lines(spark: SparkSession, paths: str | list[str], schema: str = CORRECTIONS) -> DataFrame:
    """Records of JSON lines; lines that are no such record are skipped."""
    lines = spark.read.text(paths)
    return parse_lines(lines.where(F.trim("value") != ""), schema)


def parse_lines(lines: DataFrame, schema: str, column: str = "value") -> DataFrame:
    """The same for a column of lines."""
    parsed = lines.select(F.from_json(column, f"{schema}, _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}).alias("r")).select("r.*")
    return parsed.where(F.col("_bad").isNull()).drop("_bad")


def split_manifest(manifest: DataFrame, column: str = "value") -> DataFrame:
    """``font, split, sample_id`` of manifests ``{"splits": {font: {split: [ids]}}}`` or ``{"splits": {split: [ids]}}``."""
    two = F.from_json(column, "struct<splits: map<string, map<string, array<string>>>>")["splits"]
    one = F.from_json(column, "struct<splits: map<string, array<string>>>")["splits"]
    nested = manifest.select(F.explode(two).alias("font", "s")).where("s IS NOT NULL").select("font", F.explode("s").alias("split", "ids")).select("font", "split", F.explode("ids").alias("sample_id"))
    flat = manifest.select(F.explode(one).alias("split", "ids")).where("ids IS NOT NULL").select(F.lit(None).cast("string").alias("font"), "split", F.explode("ids").alias("sample_id"))
    return nested.unionByName(flat)


def sample_list(lists: DataFrame, column: str = "value") -> DataFrame:
    return lists.select(F.explode(F.from_json(column, "struct<sample_ids: array<string>>")["sample_ids"]).alias("sample_id"))


def tagged_lines(pages: DataFrame, key: str, column: str = "value") -> DataFrame:
    """Text of tagged pages ``{"line_N": {"text": .., "tags": {"Crossed_out": 0}}}``: lines by number, crossed-out and blank ones left out."""
    entries = F.map_entries(F.from_json(column, "map<string, struct<text: string, tags: struct<Crossed_out: int>>>"))
    kept = F.filter(entries, lambda e: e["key"].startswith("line_") & (F.coalesce(e["value"]["tags"]["Crossed_out"], F.lit(0)) == 0) & (strip(F.coalesce(e["value"]["text"], F.lit(""))) != ""))
    lines = F.array_sort(F.transform(kept, lambda e: F.struct(F.substring(e["key"], 6, 20).cast("int").alias("n"), strip(e["value"]["text"]).alias("t"))))
    return pages.select(key, F.array_join(F.transform(lines, lambda x: x["t"]), "\n").alias("text"))


def html_text(raw: Column, unescape: bool = True) -> Column:
    """Text of HTML: scripts, styles and tags out, entities read, blanks and empty lines collapsed."""
    out = F.regexp_replace(F.coalesce(raw, F.lit("")), "(?is)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>", "")
    out = F.regexp_replace(out, "<[^>]+>", " ")
    out = unescaped(out) if unescape else out
    return strip(F.regexp_replace(F.regexp_replace(out, "[ \\t]+", " "), "\\n{3,}", "\n\n"))


@F.pandas_udf(T.StringType())
def unescaped(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for texts in batches:
        yield texts.map(html_lib.unescape)


def docx_text(content: Column) -> Column:
    """The text runs of a word processor document with a blank between any two; null for a file that is none."""
    return docx_runs(content)


@F.pandas_udf(T.StringType())
def docx_runs(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    def read(raw: bytes | None) -> str | None:
        try:
            with zipfile.ZipFile(io.BytesIO(raw or b"")) as z:
                xml = z.read("word/document.xml").decode("utf-8", "replace")
        except (zipfile.BadZipFile, KeyError, EOFError, zlib.error, NotImplementedError, RuntimeError):
            return None
        text = " ".join(html_lib.unescape(t) for t in re.findall(r"<w:t(?:\s[^>]*)?>([^<]+)</w:t>", xml))
        return re.sub(r"\n{3,}", "\n\n", re.sub(r"[ \t]+", " ", text)).strip()

    for batch in batches:
        yield pd.Series([read(x) for x in batch], dtype="object")


def word_pair_file(lines: DataFrame, order: str = "ord", column: str = "value") -> DataFrame:
    """``kind, wrong, right`` of a file of lines ``wrong > right`` under headers that name UNFIXED or INTRODUCED errors; lines are few."""
    from pyspark.sql import Window

    header = F.when(F.col(column).contains("UNFIXED"), "unfixed").when(F.col(column).contains("INTRODUCED"), "introduced")
    kind = F.last(header, ignorenulls=True).over(Window.orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    pair = F.split(column, " > ")
    return lines.withColumn("kind", kind).where(~F.col(column).startswith("#") & (F.size(pair) == 2)).select("kind", strip(pair[0]).alias("wrong"), strip(pair[1]).alias("right"))
