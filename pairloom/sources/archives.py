"""Inputs that are no plain tables: page archives (SRC20), benchmark folders by category (SRC23), inference input (SRC26), settings (SRC28), images by area (SRC29, TOP08)."""

from __future__ import annotations

import json
import re
import warnings
import zipfile
import zlib
from collections.abc import Iterator
from functools import reduce
from typing import BinaryIO

import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairloom.functions.text import strip
from pairloom.sources.readers import docx_text, exists, json_lines, paired_files

HEADER = r"^Book\s*\d+[_ ]+\s*\d+[_ ]*\s*[ABab]?\s*"  # fixed value: what a page's document starts with


def _opened(path: str):
    store, at = fs.FileSystem.from_uri(path)
    return store.open_input_file(at)


def archive_members(spark: SparkSession, path: str) -> DataFrame:
    """``archive, name, offset, packed, size, method, crc, error`` of the members of zip archives. Only the list at an archive's end is read; an archive without a valid one is a row with
    its ``error`` and no name."""

    def listed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for archive in frame["path"]:
                try:
                    with _opened(archive) as f, zipfile.ZipFile(f) as z:
                        rows = [(archive, x.filename, x.header_offset, x.compress_size, x.file_size, x.compress_type, x.CRC, "encrypted" if x.flag_bits & 1 else None) for x in z.infolist() if not x.is_dir()]
                except (zipfile.BadZipFile, OSError, ValueError, EOFError) as e:
                    rows = [(archive, None, None, None, None, None, None, f"{type(e).__name__}: {e}")]
                yield pd.DataFrame(rows, columns=_MEMBER.replace(" long", "").replace(" string", "").split(", ")).convert_dtypes()

    files = spark.read.format("binaryFile").load(path).select("path")
    return files.mapInPandas(listed, _MEMBER)


_MEMBER = "archive string, name string, offset long, packed long, size long, method long, crc long, error string"


def member_bytes(archive: BinaryIO, offset: int, packed: int, method: int, crc: int) -> bytes:
    """One member, inflated on its own; an error if it is not what the list says."""
    archive.seek(offset)
    head = archive.read(30)
    if head[:4] != b"PK\x03\x04" or len(head) < 30:
        raise zipfile.BadZipFile("no member there")
    archive.seek(offset + 30 + int.from_bytes(head[26:28], "little") + int.from_bytes(head[28:30], "little"))
    raw = archive.read(packed)
    if method not in (zipfile.ZIP_STORED, zipfile.ZIP_DEFLATED):
        raise zipfile.BadZipFile(f"method {method} is not known")
    out = raw if method == zipfile.ZIP_STORED else zlib.decompress(raw, -15)
    if len(raw) < packed or zlib.crc32(out) != crc:
        raise zipfile.BadZipFile("the contents are broken")
    return out


def archive_entries(spark: SparkSession, path: str, endings: tuple[str, ...] = (".png", ".docx"), broken: bool = False) -> DataFrame:
    """``archive, name, folder, stem, ending, content, error`` of the files in zip archives.

    Members are dealt out one by one, whatever archive they are in, and each task reads their byte ranges only. A broken archive or member fails no job: it is left out, or with ``broken`` a
    row with its ``error`` and no content."""
    members = archive_members(spark, path)
    wanted = F.col("name").isNull() | F.lower("name").rlike(f"({'|'.join(re.escape(e) for e in endings)})$")
    members = members.where(wanted)

    def contents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened: tuple[str, object] | None = None
        for batch in batches:
            for row in batch.to_pylist():
                content, error = None, row["error"]
                if error is None:
                    try:
                        if opened is None or opened[0] != row["archive"]:
                            opened = (row["archive"], _opened(row["archive"]))
                        content = member_bytes(opened[1], row["offset"], row["packed"], row["method"], row["crc"])
                    except (zipfile.BadZipFile, zlib.error, OSError, ValueError) as e:
                        error = f"{type(e).__name__}: {e}"
                yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in ((row["archive"], pa.string()), (row["name"], pa.string()), (content, pa.binary()), (error, pa.string()))], names=["archive", "name", "content", "error"])

    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = members.repartition(n, "archive", "offset").sortWithinPartitions("archive", "offset").mapInArrow(contents, "archive string, name string, content binary, error string")
    if not broken:
        rows = rows.where("error IS NULL")
    last = F.element_at(F.split("name", "/"), -1)
    stem, ending = F.regexp_replace(last, "\\.[^.]*$", ""), F.lower(F.regexp_extract(last, "(\\.[^.]*)$", 1))
    return rows.select("archive", "name", F.get(F.split("name", "/"), F.lit(1)).alias("folder"), stem.alias("stem"), ending.alias("ending"), "content", "error")


def without_header(text: Column) -> Column:
    """A document's text without the page's identifier; a text that is nothing else stays."""
    bare = strip(F.regexp_replace(text, HEADER, ""))
    return F.when(bare != "", bare).otherwise(text)


def archive_pages(entries: DataFrame) -> DataFrame:
    """``folder, sample_id, gt_text``: the document of a page image of the same name, or else that of both halves ``_A`` and ``_B`` of its page.

    Names are compared without case; a half keeps the name of its image. Documents without text or without an image are left out."""
    docs = entries.where("ending = '.docx'").select("folder", "stem", F.lower("stem").alias("_k"), without_header(strip(F.regexp_replace(docx_text(F.col("content")), "\\s+", " "))).alias("gt_text")).where("gt_text <> ''")
    images = entries.where("ending = '.png'").groupBy("folder", F.lower("stem").alias("_p")).agg(F.max("stem").alias("image"))
    whole = docs.join(images.withColumnRenamed("_p", "_k"), ["folder", "_k"], "left")
    one = whole.where("image IS NOT NULL").select("folder", F.col("stem").alias("sample_id"), "gt_text")
    halves = whole.where("image IS NULL").select("folder", "gt_text", F.explode(F.array(F.concat("_k", F.lit("_a")), F.concat("_k", F.lit("_b")))).alias("_p"))
    return one.unionByName(halves.join(images, ["folder", "_p"]).select("folder", F.col("image").alias("sample_id"), "gt_text"))


def by_category(spark: SparkSession, prefix: str, folders: dict[str, tuple[str, str]], limit: int | None = None, numeric: bool = False) -> DataFrame:
    """``dataset, sample_id, ocr_text, gt_text`` of a benchmark's categories: the files that both folders have, ids ``prefix-category_stem``.

    Categories whose folders are missing are left out with a warning. ``limit`` keeps the first of each category by stem (``numeric``: stems of digits by their number)."""
    out = spark.createDataFrame([], "dataset string, sample_id string, ocr_text string, gt_text string")
    for category, (ocr, gt) in folders.items():
        if not (exists(spark, ocr) and exists(spark, gt)):
            warnings.warn(f"{prefix}-{category}: {ocr} or {gt} is missing", stacklevel=2)
            continue
        key = f"{prefix}-{category}"
        rows = paired_files(spark, ocr, gt, key)
        if limit is not None:
            number = F.when(F.col("sample_id").rlike("^[0-9]+$"), F.col("sample_id").cast("decimal(38,0)")) if numeric else F.lit(None)
            rows = rows.orderBy(number.isNull(), number, "sample_id").limit(limit)
        out = out.unionByName(rows.select("dataset", F.concat_ws("_", F.lit(key), "sample_id").alias("sample_id"), "ocr_text", "gt_text"))
    return out


def inference_input(spark: SparkSession, path: str | list[str], datasets: list[str] | None = None, limit: int | None = None) -> DataFrame:
    """The records of an input file with text, of the wanted data sets (none: all), the first ``limit`` of each in the order of the file."""
    rows = json_lines(spark, path)
    rows = rows.withColumn("_at", F.monotonically_increasing_id()).where(strip(F.coalesce("ocr_text", F.lit(""))) != "")
    if datasets:
        rows = rows.where(F.coalesce("dataset", F.lit("")).isin(datasets))
    if limit is not None:
        rows = rows.withColumn("_k", F.row_number().over(Window.partitionBy("dataset").orderBy("_at"))).where(F.col("_k") <= limit).drop("_k")
    return rows.drop("_at")


def settings(path: str, defaults: dict | None = None) -> dict:
    """A file of settings (JSON, or YAML where a reader for it is installed) over ``defaults``, section by section."""
    with open(path, encoding="utf-8") as f:
        text = f.read()
    if path.endswith(".json"):
        given = json.loads(text)
    else:
        import yaml

        given = yaml.safe_load(text)
    if not isinstance(given or {}, dict):
        raise ValueError(f"{path} holds no sections")

    def over(low: dict, high: dict) -> dict:
        return low | {k: over(low[k], v) if isinstance(low.get(k), dict) and isinstance(v, dict) else v for k, v in high.items()}

    return over(defaults or {}, given or {})


def images_by_area(spark: SparkSession, path: str, done: DataFrame | None = None) -> DataFrame:
    """``path, width, height`` of PNG, GIF, BMP and JPEG images, smallest first (ties by path), without those in ``done``. Sizes come from the files' headers: of the first three in the JVM, of
    JPEG files, whose frame header may lie anywhere, in Arrow batches. Files that are no image are left out."""
    start = lambda at, n: F.substring("content", at, n)
    big = lambda at, n: F.conv(F.hex(start(at, n)), 16, 10).cast("long")
    small = lambda at, n: reduce(lambda x, y: x + y, [big(at + k, 1) * (256**k) for k in range(n)])
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).where(F.lower("path").rlike("[.](png|gif|bmp|jpe?g)$"))
    png, gif, bmp, jpeg = F.hex(start(13, 4)) == "49484452", F.hex(start(1, 4)) == "47494638", F.hex(start(1, 2)) == "424D", F.hex(start(1, 2)) == "FFD8"
    # a bitmap whose rows go down has a negative height
    low = small(23, 4)
    height = F.when(low >= 1 << 31, (1 << 32) - low).otherwise(low)
    frame = jpeg_size(F.when(jpeg, F.col("content")))
    width = F.when(png, big(17, 4)).when(gif, small(7, 2)).when(bmp, small(19, 4)).otherwise(frame["width"])
    rows = files.select("path", width.alias("width"), F.when(png, big(21, 4)).when(gif, small(9, 2)).when(bmp, height).otherwise(frame["height"]).alias("height")).where("width IS NOT NULL AND height IS NOT NULL")
    if done is not None:
        rows = rows.join(done.select("path").distinct(), "path", "left_anti")
    return rows.orderBy(F.col("width") * F.col("height"), "path")


@F.pandas_udf(T.StructType([T.StructField(c, T.LongType()) for c in ("width", "height")]))
def jpeg_size(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    """Width and height from the first frame header of a JPEG file; nulls where there is none."""

    def size(raw: bytes | None) -> tuple[int | None, int | None]:
        at = 2
        while raw is not None and at + 9 <= len(raw):
            if raw[at] != 0xFF:
                at += 1
            elif 0xC0 <= (kind := raw[at + 1]) <= 0xCF and kind not in (0xC4, 0xC8, 0xCC):
                return int.from_bytes(raw[at + 7 : at + 9], "big"), int.from_bytes(raw[at + 5 : at + 7], "big")
            else:
                at += 1 if kind == 0xFF else 2 if kind == 1 or 0xD0 <= kind <= 0xD8 else 2 + int.from_bytes(raw[at + 2 : at + 4], "big")
        return None, None

    for batch in batches:
        yield pd.DataFrame([size(x) for x in batch], columns=["width", "height"]).astype("Int64")
