"""Summaries of corrections, statistics, archives, settings, endpoints and reports, with known results."""

import http.server
import io
import json
import math
import statistics
import struct
import threading
import zipfile
import zlib

import pytest
from pyspark.sql import functions as F

from pairloom.functions import edit, text
from pairloom.operators import correct, errors, outcomes, pairs, prompts, sampling, stats, validation
from pairloom.plans import jobs
from pairloom.sources import archives, reports

ROWS = "dataset string, sample_id string, ord long, gt_text string, ocr_text string, corrected_text string"


def samples(spark, triples):
    return spark.createDataFrame([("d" if i % 2 == 0 else "e", f"s{i}", i, *t) for i, t in enumerate(triples)], ROWS)


def test_sample_changes_and_their_sums(spark):
    rows = samples(spark, [("كتاب", "كتات", "كتاب"), ("abc", "abc", "axc"), ("abc", "abx", "abx"), ("", "q", None), (None, "q", "r"), ("same", "same", None), ("مدرسة", "مدرسه", "مدرسه")])
    got = {(r.sample_id, r.error_type): (r.baseline, r.residual, r.fixed, r.introduced) for r in outcomes.sample_changes(rows, ["sample_id"]).collect()}
    assert len(got) == 7 * 10 and got["s0", "dot_confusion"] == (1, 0, 1, 0) and got["s1", "other_substitution"] == (0, 1, 0, 1) and got["s2", "other_substitution"] == (1, 1, 0, 0)
    assert got["s6", "taa_marbuta"] == (1, 1, 0, 0) and got["s3", "insertion"] == (1, 1, 0, 0)
    for (sample, kind), (b, r, *_) in got.items():
        gt, ocr, llm = next((x.gt_text, x.ocr_text, x.corrected_text) for x in rows.collect() if x.sample_id == sample)
        if gt is not None:
            count = lambda t: sum(e["error_type"] == kind for e in edit.char_errors_of(gt, ocr if t is None else t))  # noqa: B023, E731
            assert (b, r) == (count(ocr), count(llm))
    changes = outcomes.error_changes(rows, [])
    one = {r.error_type: r for r in outcomes.change_summary(changes, []).collect()}
    assert (one[None].baseline, one[None].fixed, one[None].introduced) == (sum(v[0] for v in got.values()), sum(v[2] for v in got.values()), sum(v[3] for v in got.values()))
    assert one["hamza"].fix_rate is None and one["taa_marbuta"].fix_rate == 0 and one["dot_confusion"].fix_rate == 1 and one["other_substitution"].introduction_rate == 1
    assert outcomes.error_changes(rows.limit(0), ["dataset"]).count() == 0


def test_insights_text(spark):
    rows = [("a", k, b, f, i) for k, b, f, i in [("hamza", 100, 0.9, 0.0), ("insertion", 50, 0.1, 0.2), ("deletion", 50, 0.3, 0.5), ("dot_confusion", 9, 0.0, 0.9), ("taa_marbuta", 10, 0.2, 0.01)]] + [("b", "hamza", 3, 0.0, 1.0)]
    got = {r.g: r.text for r in outcomes.insights_text(spark.createDataFrame(rows, "g string, error_type string, baseline long, fix_rate double, introduction_rate double"), ["g"], weaknesses=2).collect()}
    assert got["a"].split("\n") == ["Weak:", "- insertion: 10% mended", "- taa_marbuta: 20% mended", "Over-corrected:", "- deletion: 50% new errors", "- insertion: 20% new errors", "Strong:", "- hamza: 90% mended"] and got["b"] == ""


def test_training_metrics(spark):
    rows = samples(spark, [("abcd efgh", "abcx efgh", "abcd efgh"), ("ab", "ax", None), ("abcdefghij", "abcdefghij", "x"), ("كِتاب", "كتاب", "كتاب"), ("q r s", "q r", "q r t")])
    got = {(r.dataset, r.diacritics, r.text, r.rate): r for r in outcomes.training_metrics(rows).collect()}
    assert len(got) == 3 * 8
    for (dataset, kept, name, rate), r in got.items():
        mine = rows if dataset is None else rows.where(F.col("dataset") == dataset)
        mine = mine.withColumn("t", F.coalesce("corrected_text", "ocr_text") if name == "llm" else F.col("ocr_text"))
        want = sorted(x[rate] for x in pairs.scored(mine, "t", diacritics=kept).select(rate).collect())
        n = len(want)
        assert r.n == n and r["mean"] == pytest.approx(statistics.mean(want)) and r["median"] == pytest.approx(statistics.median(want))
        assert r["std"] == pytest.approx(statistics.stdev(want) if n > 1 else 0) and r.p95 == want[min(int(n * 0.95), n - 1)]


def test_revert_statistics(spark):
    rows = spark.createDataFrame([(2, 3, 5), (0, 0, 4), (1, 0, 0)], "reverted long, kept long, unchanged long")
    assert validation.revert_statistics(rows).first().asDict() == {"total_samples": 3, "samples_with_reverts": 2, "total_words": 15, "words_reverted": 3, "words_kept": 3, "words_unchanged": 9, "avg_revert_rate": 0.2, "revert_rate_pct": 20.0}
    assert validation.revert_statistics(rows.limit(0)).first().avg_revert_rate == 0.0


def test_exact_p_and_bootstrap_weights(spark):
    d = [0.1, 0.3, 0.2, 0.4]
    runs = spark.createDataFrame([("base", str(i), i, 1.0) for i in range(4)] + [("x", str(i), i, 1.0 - v) for i, v in enumerate(d)], "run string, sample_id string, ord long, cer double")
    r = stats.compare_all(runs, "base", exact=True).first()
    t = statistics.mean(d) / (statistics.stdev(d) / 2)
    assert r.t_stat == pytest.approx(t) and r.p_value == pytest.approx(stats.student_p(t, 3)) and r.p_value == pytest.approx(0.0304662, abs=1e-6)
    table = stats.poisson_table()
    assert len(table) == 65536 and abs(table.mean() - 1) < 1e-4 and abs((table == 0).mean() - math.exp(-1)) < 1e-4
    whole = runs.unionByName(runs.selectExpr("run", "concat(sample_id, 'b') AS sample_id", "ord", "cer"))
    one, many = ({x.run: (x.low, x.high) for x in stats.bootstrap_interval(whole.repartition(k), "base", repeats=200).collect()} for k in (1, 5))
    assert one["x"] == pytest.approx(many["x"]) and one["x"][0] < 0.25 < one["x"][1]
    assert stats.bootstrap_interval(runs.limit(0), "base").count() == 0


def test_keys_and_ids(spark):
    rows = spark.createDataFrame([("A-Train",), ("untrain",), ("A-val",), ("Aval",), ("x-Validation",), ("p:Font_12",), ("Font_12",), ("p:Font_1_2",), ("a:b:F_7",), (None,)], "k string")
    got = {r.k: (r.t, r.v, r.n, r.p) for r in rows.select("k", text.is_training(F.col("k")).alias("t"), text.is_validation(F.col("k")).alias("v"), text.sample_number(F.col("k")).alias("n"), text.paragraph_id(F.col("k")).alias("p")).collect()}
    assert [got[k][0] for k in ("A-Train", "untrain", "A-val")] == [True, True, False] and [got[k][1] for k in ("A-val", "Aval", "x-Validation", "A-Train")] == [True, False, True, False]
    assert [got[k][2] for k in ("p:Font_12", "Font_12", "p:Font_1_2", "a:b:F_7")] == [12, None, None, 7] and got["p:Font_1_2"][3] == "p:Font_1" and got[None] == (None, None, None, None)


def test_prompt_versions_and_tasks(spark):
    rows = spark.createDataFrame([("v1", "a", " "), ("v9", "b", "own"), (None, "c", None)], "v string, t string, c string")
    got = rows.select(prompts.zero_shot(F.col("t"), F.col("v"), examples=F.lit("I: O")).alias("z"), prompts.crafted(F.col("t"), F.col("c")).alias("c"), prompts.task_message(F.col("t")).alias("m")).collect()
    assert got[0].z[0].content.startswith(prompts.SHORT) and "I: O" in got[0].z[0].content and got[1].z[0].content == got[2].z[0].content and got[1].z[0].content.count("I: O") == 1
    assert [g.c[0].content for g in got] == [prompts.STRICT, "own", prompts.STRICT] and [(m.role, m.content) for m in got[0].m] == [("user", "a")]
    picked = spark.createDataFrame([("hard", 0.5, None, "o1", "g1", 2), ("easy", 0.01, "F", "o2", "g2", 1), ("hard", 0.6, None, "o3", "g3", 3)], "difficulty string, cer double, font string, ocr_text string, gt_text string, ord int")
    said = prompts.design_task(picked)
    assert said.index("### easy") < said.index("### hard") < said.index("OCR: o1") < said.index("OCR: o3") and "font F" in said and "### medium" not in said
    failed = spark.createDataFrame([(f"s{i:02}", 0.1, 0.1 + i / 100, f"o{i}", f"c{i}", "g") for i in range(20)], "sample_id string, cer_ocr double, cer_llm double, ocr_text string, corrected_text string, gt_text string")
    asked = prompts.refine_task("P", failed)
    assert "19 texts got worse, the worst 15" in asked and asked.index("OCR: o19") < asked.index("OCR: o18") and "OCR: o4\n" not in asked


def test_chat_endpoint(spark):
    class Answer(http.server.BaseHTTPRequestHandler):
        def do_POST(self):
            asked = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            said = asked["messages"][1]["content"]
            self.send_response(500 if said == "bad" else 200)
            self.end_headers()
            self.wfile.write(json.dumps({"choices": [{"message": {"content": said.upper() + str(asked["temperature"])}}]}).encode())

        def log_message(self, *_):
            pass

    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Answer)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    rows = spark.createDataFrame([("a", "d", "one"), ("b", "d", "bad"), ("c", "d", " ")], "sample_id string, dataset string, ocr_text string")
    got = {r.sample_id: (r.corrected_text, r.success) for r in correct.corrected(rows, "api", arabic_only=False, url=f"http://127.0.0.1:{server.server_port}/v1", model="m", temperature=0).collect()}
    server.shutdown()
    assert got == {"a": ("ONE0", True), "b": ("bad", False), "c": (" ", True)}
    with pytest.raises(ValueError):
        correct.BACKENDS["api"]()


def docx(*paragraphs):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", "".join(f"<w:p><w:r><w:t>{p}</w:t></w:r></w:p>" for p in paragraphs))
    return out.getvalue()


def png(width, height):
    return b"\x89PNG\r\n\x1a\n" + struct.pack(">I", 13) + b"IHDR" + struct.pack(">II", width, height) + b"\x08\0\0\0\0" + struct.pack(">I", zlib.crc32(b""))


def test_page_archive(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "pages.zip", "w") as z:
        for name, content in (("r/Book1/book1_01_a.png", png(1, 1)), ("r/Book1/Book1_01_B.PNG", png(1, 1)), ("r/Book1/Book1_01.docx", docx("Book1_ 00000001 _ first", "line")), ("r/Book2/p7.png", png(1, 1)), ("r/Book2/P7.docx", docx("own")),
                              ("r/Book2/none.docx", docx("no image")), ("r/Book2/p8.png", png(1, 1)), ("r/Book2/P8.docx", docx(" ")), ("r/readme.txt", b"x")):
            z.writestr(name, content)
    entries = archives.archive_entries(spark, str(tmp_path / "*.zip"))
    assert entries.count() == 8
    got = {(r.folder, r.sample_id): r.gt_text for r in archives.archive_pages(entries).collect()}
    assert got == {("Book1", "book1_01_a"): "first line", ("Book1", "Book1_01_B"): "first line", ("Book2", "P7"): "own"}


def test_categories_and_images(spark, tmp_path):
    for c, names in (("x", ["1", "10", "2"]), ("y", ["a"])):
        for kind in ("ocr", "gt"):
            (tmp_path / kind / c).mkdir(parents=True)
            for n in names:
                (tmp_path / kind / c / f"{n}.txt").write_text(f"{kind}{n}")
    folders = {c: (str(tmp_path / "ocr" / c), str(tmp_path / "gt" / c)) for c in ("x", "y", "z")}
    with pytest.warns(UserWarning, match="BM-z"):
        assert sorted(r.sample_id for r in archives.by_category(spark, "BM", folders, limit=2).collect()) == ["BM-x_1", "BM-x_10", "BM-y_a"]
    del folders["z"]
    rows = archives.by_category(spark, "kitab", folders, limit=2, numeric=True).collect()
    assert sorted((r.dataset, r.sample_id, r.ocr_text, r.gt_text) for r in rows) == [("kitab-x", "kitab-x_1", "ocr1", "gt1"), ("kitab-x", "kitab-x_2", "ocr2", "gt2"), ("kitab-y", "kitab-y_a", "ocra", "gta")]
    for name, size in (("big", (300, 200)), ("small", (70000, 1)), ("tiny", (2, 3))):
        (tmp_path / f"{name}.png").write_bytes(png(*size))
    (tmp_path / "broken.png").write_bytes(b"x")
    images = archives.images_by_area(spark, str(tmp_path))
    assert [(r.path.rsplit("/", 1)[-1], r.width, r.height) for r in images.collect()] == [("tiny.png", 2, 3), ("big.png", 300, 200), ("small.png", 70000, 1)]
    assert archives.images_by_area(spark, str(tmp_path), images.where("width = 2")).count() == 2


def test_inference_input_and_settings(spark, tmp_path):
    lines = [{"sample_id": str(i), "dataset": "a" if i % 2 else "b", "ocr_text": "" if i == 1 else f"t{i}"} for i in range(8)]
    (tmp_path / "in.jsonl").write_text("\n".join(json.dumps(x) for x in lines) + "\nno json\n\n")
    ids = lambda **k: sorted(r.sample_id for r in archives.inference_input(spark, str(tmp_path / "in.jsonl"), **k).collect())
    assert ids() == ["0", "2", "3", "4", "5", "6", "7"] and ids(limit=2) == ["0", "2", "3", "5"] and ids(datasets=["a"], limit=1) == ["3"]
    (tmp_path / "c.json").write_text('{"a": {"x": 2}, "b": 1}')
    assert archives.settings(str(tmp_path / "c.json"), {"a": {"x": 1, "y": 3}}) == {"a": {"x": 2, "y": 3}, "b": 1}
    (tmp_path / "d.json").write_text("[1]")
    with pytest.raises(ValueError):
        archives.settings(str(tmp_path / "d.json"))


def test_picks_and_tables(spark):
    rows = spark.range(60).selectExpr("id AS k")
    split = {r.k: r.split for r in sampling.train_and_dev(rows, "k").collect()}
    assert len(split) == 60 and sum(v == "train" for v in split.values()) == 50
    trials = spark.createDataFrame([("T1", "d", 0.5), ("T1", "d", 0.3), ("T2", "d", 0.4), ("T2", "e", 0.1)], "trial string, dataset string, cer double")
    got = {r.dataset: (r.T1, r.T2, r.best) for r in jobs.trial_table(jobs.trial_summary(trials), ["T1", "T2"]).collect()}
    assert got == {"d": (0.4, 0.4, "T1"), "e": (None, 0.1, "T2")}


def test_reports(spark):
    rows = samples(spark, [("abcdef", "abcxef", "abcdef"), ("abcdef", "abcdef", "abxyef"), ("ab", "ab" * 20, "ab" * 20), ("line one", "line one", None)])
    said = reports.sample_report(rows, "Run")
    assert "Samples: 4, runaways: 1\n" in said and "Improved: 1, regressed: 1, unchanged: 2" in said and said.index("[1] s1 (e)") < said.index("Improved, best first") < said.index("[1] s0 (d) PERFECT")
    assert "runaways: 1 (left out)" in (less := reports.sample_report(rows, "Run", without_runaways=True)) and "unchanged: 1" in less and "No valid samples" in reports.sample_report(rows.limit(0), "Run")
    base = reports.baseline_report(jobs.baseline(rows))
    assert all(f"## {x}" in base for x in ("All samples", "Without runaways", "Confusions", "Error types")) and "| d | x | 1 |" not in base
    assert "## Outcomes" in reports.correction_report(jobs.analysed(rows))
    runs = spark.createDataFrame([(k, "d", str(i), i, v + i / 10) for k, v in (("base", 0.5), ("x", 0.3)) for i in range(3)], "run string, dataset string, sample_id string, ord long, cer double")
    assert "## Against the baseline" in reports.comparison_report(jobs.run_comparison(runs, "base"))
    found = errors.unfixed_and_introduced(errors.word_error_rows(rows), errors.word_error_rows(rows, "corrected_text"))
    of = lambda kind: errors.top_pairs(errors.word_pairs(found.where(F.col("kind") == kind), False))
    assert "## Made wrong" in reports.training_report(outcomes.compared(rows), outcomes.training_metrics(rows), of("unfixed"), of("introduced"))
    table = reports.paper_table(spark.createDataFrame([("a_b", 0.1, None), ("c", 0.2, 0.5)], "run string, x double, y double"), "run", ["x", "y"], "T")
    assert "a\\_b & \\textbf{10.00} & -- \\\\" in table and "c & 20.00 & \\textbf{50.00} \\\\" in table
    lines = []
    reports.console(spark.createDataFrame([("b", 1, 0.5), ("a", 2, 0.25)], "k string, n int, v double"), "k", lines.append)
    assert lines == ["a: n 2, v 0.2500", "b: n 1, v 0.5000"]
