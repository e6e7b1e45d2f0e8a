"""Tables that one job writes for its own later steps, in the folder that driver and executors share."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; a local master without one gets a folder of its own."""
    sc = spark.sparkContext
    at = sc.getConf().get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if at is None:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="pairloom-"))
        at = sc.getCheckpointDir()
    return at.rstrip("/")


@contextlib.contextmanager
def small_batches(spark: SparkSession, most: int = 4 << 20) -> Iterator[None]:
    """While it holds, Python tasks get about ``most`` bytes of rows at a time, not 64 MB: JVM and Python hold several copies of a batch, and of a batch in each task."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name, None)
    spark.conf.set(name, str(most))
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def kept(df: DataFrame, name: str, wide: bool = False) -> DataFrame:
    """``df`` written once and read again, so that several steps share it and its lineage ends.

    ``wide``: rows are up to megabytes, so row groups are closed at 8 MB instead of at 100 rows and 128 MB, as both writer and reader hold a group at a time, and Python tasks get ``small_batches``."""
    spark, path = df.sparkSession, f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    groups = {"parquet.block.size": 8 << 20, "parquet.block.size.row.check.min": 1, "parquet.block.size.row.check.max": 4, "parquet.page.size.row.check.min": 1} if wide else {}
    with small_batches(spark) if wide else contextlib.nullcontext():
        df.write.options(compression="zstd", **groups).parquet(path)
    return spark.read.schema(df.schema).parquet(path)
