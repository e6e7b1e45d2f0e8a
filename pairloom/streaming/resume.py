"""The resumable correction loop as a stream: JSON lines arrive, repeats go, batches are corrected and appended (SNK02, ORC02, ORC04)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from pairloom.operators.correct import corrected
from pairloom.sources.readers import exists

INPUT = "sample_id string, dataset string, ocr_text string, gt_text string, prompt_version string"
KEYS = "sample_id string, dataset string"


def arriving(spark: SparkSession, path: str, files_per_batch: int = 100, within: str = "7 days") -> DataFrame:
    """New inference records of a folder with text, and when their file arrived. Of records of one (dataset, sample_id) that arrive ``within`` a time, one goes on: the stream remembers a
    key no longer than that, so its state does not grow with the folder. Older repeats are found in what is written already, by ``correct_stream``."""
    lines = spark.readStream.schema(INPUT).option("maxFilesPerTrigger", files_per_batch).json(path).withColumn("arrived", F.col("_metadata.file_modification_time"))
    return lines.where(F.coalesce(F.col("ocr_text"), F.lit("")) != "").withWatermark("arrived", within).dropDuplicatesWithinWatermark(["dataset", "sample_id"])


def written_before(spark: SparkSession, out: str, batch_id: int) -> DataFrame | None:
    """The keys that earlier batches wrote; a batch that is run again does not see itself."""
    if not exists(spark, out):
        return None
    rows = spark.read.schema(f"{KEYS}, batch long").parquet(out)
    return rows.where(F.col("batch") < batch_id).select("dataset", "sample_id")


def correct_stream(rows: DataFrame, out: str, checkpoint: str, backend: str = "mock", arabic_only: bool = True) -> StreamingQuery:
    """Corrects each batch once and writes it under its batch id, so that a batch run again after a failure replaces itself with the same rows. Records whose key an earlier
    batch wrote are dropped, however long ago that was, also when the stream starts with a new checkpoint (its batches then follow on those that are there)."""
    spark = rows.sparkSession
    first = 0
    if exists(spark, out) and not exists(spark, checkpoint):
        first = (spark.read.schema(f"{KEYS}, batch long").parquet(out).agg(F.max("batch")).head()[0] or 0) + 1

    def write(batch: DataFrame, batch_id: int) -> None:
        here = batch_id + offset
        before = written_before(spark, out, here)
        one = batch.dropDuplicates(["dataset", "sample_id"]).drop("arrived")
        if before is not None:
            same = one["dataset"].eqNullSafe(before["dataset"]) & one["sample_id"].eqNullSafe(before["sample_id"])
            one = one.join(before, same, "left_anti")
        corrected(one, backend, arabic_only=arabic_only).write.mode("overwrite").parquet(f"{out}/batch={here}")

    # where batches are numbered from is kept beside the output, so that a restart finds it again
    marker = f"{out}/_first"
    if exists(spark, checkpoint) and exists(spark, marker):
        offset = spark.read.parquet(marker).head()[0]
    else:
        offset = first
        spark.createDataFrame([(offset,)], "first long").coalesce(1).write.mode("overwrite").parquet(marker)
    return rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, every: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts of event types in tumbling windows, rows later than the watermark dropped."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", every), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("value"))
