"""Writers: partitioned JSON lines with resume, one-document JSON, pair files, reports (SNK01-SNK07, SNK09-SNK11)."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def append_new(rows: DataFrame, path: str, on: list[str], by: str = "dataset") -> DataFrame:
    """Appends the rows whose key is not there yet, as JSON lines by data set, and returns them."""
    spark = rows.sparkSession
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    there = at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)
    new = rows.join(spark.read.schema(rows.schema).json(path).select(*on).distinct(), on, "left_anti") if there else rows
    new.write.partitionBy(by).mode("append").json(path)
    return new


def split_by_dataset(rows: DataFrame, path: str, by: str = "dataset") -> None:
    """One folder of JSON lines for each data set; only those in ``rows`` are replaced."""
    rows.write.partitionBy(by).mode("overwrite").option("partitionOverwriteMode", "dynamic").json(path)


def filtered_copy(source: DataFrame, condition, path: str) -> None:
    source.where(condition).write.mode("errorifexists").json(path)


def provenance(rows: DataFrame, **facts: str) -> DataFrame:
    """Rows with constant columns that say where they are from, and the UTC time."""
    return rows.withColumns({k: F.lit(v) for k, v in facts.items()} | {"generated_at": F.lit(datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ"))})


def pair_lines(pairs: DataFrame, kind: str, n: int = 200) -> DataFrame:
    """Lines ``wrong > right`` of the ``n`` most frequent pairs, under their header."""
    spark = pairs.sparkSession
    body = pairs.orderBy(F.desc("count"), "wrong", "right").limit(n).select(F.concat("wrong", F.lit(" > "), "right").alias("value"))
    return spark.createDataFrame([(f"# === {kind} ===",)], "value string").unionByName(body)


def markdown(table: DataFrame, title: str, most: int = 1000) -> str:
    """A Markdown table of a summary; beyond ``most`` rows it ends with a line that says how many are left out."""
    rows = table.limit(most + 1).collect()
    left = table.count() - most if len(rows) > most else 0
    rows = rows[:most]
    cell = lambda v: f"{v:.4f}" if isinstance(v, float) else "" if v is None else str(v).replace("|", "\\|").replace("\n", " ")
    lines = [f"## {title}", "", "| " + " | ".join(table.columns) + " |", "|" + "---|" * len(table.columns)]
    return "\n".join(lines + ["| " + " | ".join(cell(v) for v in r) + " |" for r in rows] + (["", f"{left} more rows are not shown."] if left else [])) + "\n"


def as_json_document(summary: DataFrame, by: str) -> DataFrame:
    """One row: a JSON object from each key to its other columns."""
    rest = F.struct(*[c for c in summary.columns if c != by])
    return summary.agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col(by).alias("k"), rest.alias("v")))))).alias("json"))
