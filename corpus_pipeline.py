"""The corpus pipeline: stages over ``documents``, each written as Parquet and read again as the next one's input.

1. language: texts without a letter go; a missing lang is filled in with the predicted one (it stays null where nothing could be learned).
2. near_duplicates: of documents that links of word-shingle similarity 0.75 or more join, the row with the smallest doc_id stays (rows without one come last,
   and of several texts of one doc_id each is a row of its own).
3. repeats: words of 35-word windows that start anywhere else go; texts that lose nothing stay as they are, and a text may become empty.
4. decontamination: documents with a window that is 0.75 or more similar to a benchmark item go.
5. pieces: SentencePiece ids of each text.

Null and empty texts have no letters and go in stage 1. Rows without doc_id are treated as any row. Repeated rows become one in stage 2. Columns beyond
those of ``documents`` are dropped at the start, whatever their names. Very long texts and ties are as in the operators; empty tables give an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairloom.llm.decontamination import without_contaminated
from pairloom.llm.language_id import UNKNOWN, learn_languages, predict_languages
from pairloom.llm.ngram_join import one_of_each
from pairloom.llm.pieces import encode_texts
from pairloom.llm.store import table, written
from pairloom.llm.substring_dedup import remove_repeats

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    docs = docs.select(*COLUMNS)
    predicted = predict_languages(docs, learn_languages(docs), COLUMNS)
    told = F.when(F.col("lang_pred") != UNKNOWN, F.col("lang_pred"))
    return predicted.where("NOT rejected").withColumn("lang", F.coalesce("lang", told)).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    stay = one_of_each(docs.select("doc_id", "text")).select(F.col("doc_id").alias("stays"), F.col("text_key").alias("stays_key"))
    kept = docs.join(stay, F.col("doc_id").eqNullSafe(F.col("stays")) & (F.xxhash64("text") == F.col("stays_key")), "left_semi")
    return kept.dropDuplicates(["doc_id", "text"]).select(*COLUMNS)


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    cut = remove_repeats(docs, keep=("text", "lang", "source", "n_chars"))
    text = F.when(F.col("n_removed") > 0, F.col("kept_text")).otherwise(F.col("text"))
    return cut.withColumn("text", text).withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return without_contaminated(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark").select("item_id", "text"))


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    encoded = encode_texts(docs, ["doc_id", "lang", "source", "n_chars"])
    return encoded.select("doc_id", "lang", "source", "n_chars", F.size("piece_ids").cast("long").alias("n_pieces"), "piece_ids", "pieces_sha256")


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("repeats", repeats), ("decontamination", decontamination), ("pieces", pieces)]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
