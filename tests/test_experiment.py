"""A whole experiment: its tables, where it goes on after a stop, and how samples are narrowed."""

import pytest
from pyspark.sql import functions as F

from pairloom.plans import jobs


def rows(spark, n=24):
    texts = [("كتاب جديد", "كتاب جديد"), ("كتاب جديد", "كناب جديد"), ("هذا قلم", "هذا فلم"), ("باب كبير", "باب كبيره")]
    return spark.createDataFrame([(f"d{i % 2}", f"s{i}", i, *texts[i % 4][::-1]) for i in range(n)], "dataset string, sample_id string, ord long, ocr_text string, gt_text string")


def test_tables_and_resume(spark, tmp_path):
    lexicon = spark.createDataFrame([("كتاب",), ("جديد",), ("قلم",)], "word string")
    folder = str(tmp_path / "run")
    out = jobs.experiment(rows(spark), folder, ("zero_shot", "self_reflective"), lexicon=lexicon)
    assert {"samples", "baseline/metrics", "baseline/pooled", "zero_shot/corrections", "self_reflective/outcomes", "lexicon/statistics", "comparison/statistics", "runs", "hard"} <= set(out)
    assert out["zero_shot/corrections"].count() == 24 and {r.run for r in out["runs"].select("run").distinct().collect()} == {"baseline", "zero_shot", "self_reflective", "lexicon"}
    assert all(df.count() >= 0 for df in out.values())
    mock = {r.run: r.cer for r in out["comparison/averages"].collect()}
    assert mock["zero_shot"] == pytest.approx(mock["baseline"]) and mock["baseline"] > 0  # the mock model changes nothing
    again = jobs.experiment(rows(spark, 4), folder, ("zero_shot",), lexicon=lexicon)
    assert again["samples"].count() == 24 and again["zero_shot/corrections"].count() == 24  # what is there is read
    (tmp_path / "run/zero_shot/corrections/_SUCCESS").unlink()
    path = f"{folder}/zero_shot/corrections"
    assert jobs.written_once(lambda: rows(spark, 3), path, spark).count() == 3 and jobs.written_once(lambda: rows(spark, 4), path, spark).count() == 3
    ids = spark.createDataFrame([(f"s{i}",) for i in range(10)], "sample_id string")
    anew = jobs.experiment(rows(spark), folder, ("zero_shot",), force=True, datasets=["d1", "d9"], ids=ids, limit=2)
    assert sorted(r.sample_id for r in anew["samples"].collect()) == ["s1", "s3"] and anew["runs"].count() == 4
    assert anew["baseline/metrics"].where(F.col("dataset") == "d1").first().num_samples == 2
