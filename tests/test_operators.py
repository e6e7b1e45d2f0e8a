"""Operators on small tables with known results."""

import json
import math
import random

import pytest
from pyspark.sql import functions as F

from pairloom.operators.gram_index import gram_index
from pairloom.operators.signatures import signature_matches
from pairloom.operators import correct, errors, outcomes, pairs, prompts, relational, retrieval, sampling, stats, validation
from pairloom.plans import jobs
from pairloom.sources import readers, sinks


def samples(spark, rows):
    return spark.createDataFrame([("d", str(i), i, *r) for i, r in enumerate(rows)], "dataset string, sample_id string, ord long, gt_text string, ocr_text string, corrected_text string")


def test_metrics(spark):
    two = pairs.metrics(pairs.scored(samples(spark, [("مرحبا", "مرحيا", ""), ("أهلا", "اهلا", "")])), ["dataset"]).first()
    assert (two.num_samples, two.num_chars_ref, two.num_words_ref) == (2, 9, 2) and two.cer == pytest.approx(0.1) and two.cer_std == pytest.approx(0.2 / math.sqrt(2))
    one = pairs.metrics(pairs.scored(samples(spark, [("ab", "ab", "")])), ["dataset"]).first()
    assert (one.cer_std, one.cer_p95, one.wer) == (0, 0, 0)
    for n in (1, 2, 19, 20, 21, 100):
        r = random.Random(n)
        values = [r.choice([0.0, 0.5, r.random()]) for _ in range(n)]
        rows = spark.createDataFrame([("g", v) for v in values], "g string, v double")
        assert pairs.percentile(rows, ["g"], "v").first().value == sorted(values)[min(n - 1, int(0.95 * n))]


def test_runaways_and_quality(spark):
    rows = pairs.scored(samples(spark, [("abc", "abc", ""), ("abc", "xyz " * 10, ""), ("", "a" * 4, "")]), words=False)
    q = pairs.metrics_and_quality(rows, ["dataset"]).first()
    assert (q.total_samples, q.normal_samples, q.runaway_samples) == (3, 2, 1) and q.cer_normal == 0


def test_confusions_and_taxonomy(spark):
    found = errors.char_error_rows(samples(spark, [("مدرسة", "مدرسه", None)] * 3 + [("كب", "ك", None), ("ك", "كب", None)]))
    cells = errors.confusion_matrix(found, ["dataset"]).collect()
    assert [(c.gt_char, c.ocr_char, c["count"], c.probability) for c in cells] == [("ة", "ه", 3, 1.0)] and errors.confusion_matrix(found, ["dataset"], 5).count() == 0
    types = {r.value: r["count"] for r in errors.taxonomy(found, ["dataset"]).where("level = 'type'").collect()}
    assert len(types) == 11 and sum(types.values()) == found.count() == 5 and types["deletion"] == types["insertion"] == 1
    text = errors.format_confusions(errors.pooled(errors.confusion_matrix(found, ["dataset"]))).first().text
    assert text == "ة → ه (100%)" and errors.format_confusions(cells and errors.confusion_matrix(found, ["dataset"], 99)).first().text == ""
    assert errors.enough_data(found, 3).first().enough and not errors.enough_data(found, 4).first().enough
    assert [len(r.examples) for r in errors.first_examples(found, ["dataset"], 2).orderBy("error_type").collect()] == [1, 1, 2]


def test_pooled_counts_and_choice(spark):
    own = spark.createDataFrame([("a", "ب", "ت", 100, 0.5), ("b", "ب", "ت", 200, 0.5), ("b", "ب", "ث", 200, 0.5)], "dataset string, gt_char string, ocr_char string, count long, probability double")
    whole = errors.pooled(own)
    assert {(r.ocr_char, r["count"], r.probability) for r in whole.collect()} == {("ت", 300, 0.6), ("ث", 200, 0.4)}
    chosen = errors.matrix_or_pooled(spark.createDataFrame([("a",), ("b",), ("c",)], "dataset string"), own, whole)
    assert {(r.dataset, r.source, r.ocr_char, r["count"]) for r in chosen.collect()} == {("a", "pooled", "ت", 300), ("a", "pooled", "ث", 200), ("b", "dataset", "ت", 200), ("b", "dataset", "ث", 200), ("c", "pooled", "ت", 300), ("c", "pooled", "ث", 200)}


def test_error_changes(spark):
    rows = samples(spark, [("abc", "abx", "abc"), ("abc", "abc", "axc"), ("abc", "abx", "abx")])
    plain = {r.error_type: r for r in outcomes.error_changes(rows, ["dataset"]).collect()}["other_substitution"]
    assert (plain.baseline, plain.residual, plain.fixed, plain.introduced, plain.fix_rate) == (2, 2, 1, 1, 0.5)
    running = {r.error_type: r for r in outcomes.error_changes(rows, ["dataset"], cumulative=True).collect()}["other_substitution"]
    assert (running.fixed, running.introduced) == (1, 0)
    assert {r.error_type: r.fix_rate for r in outcomes.error_changes(rows, ["dataset"]).collect()}["hamza"] is None


def test_word_pairs(spark):
    rows = samples(spark, [("a b", "a x", "a x"), ("a b", "a b", "a y"), ("a b", "a x", "a b")])
    ocr, llm = errors.word_error_rows(rows), errors.word_error_rows(rows, "corrected_text")
    assert [(r.wrong, r.right, r["count"]) for r in errors.top_pairs(errors.word_pairs(ocr, False)).collect()] == [("x", "b", 2)]
    assert {(r.ocr_word, r.kind) for r in errors.unfixed_and_introduced(ocr, llm).collect()} == {("x", "unfixed"), ("y", "introduced")}
    lines = sinks.pair_lines(errors.word_pairs(ocr, False), "UNFIXED").collect()
    back = readers.word_pair_file(spark.createDataFrame([(i, r.value) for i, r in enumerate(lines)], "ord int, value string"))
    assert [tuple(r) for r in back.collect()] == [("unfixed", "x", "b")]


def test_reverted_words(spark):
    lexicon = spark.createDataFrame([("كتاب",), ("بيت",)], "word string")
    rows = spark.createDataFrame([("1", "كتاب", "ككككك"), ("2", "كتاب", "بيت"), ("3", "ددد", "ررر"), ("4", "كتاب بيت", "كتاب"), ("5", "قال: كتاب!", "قال: ككك!")], "sample_id string, ocr_text string, corrected_text string")
    got = {r.sample_id: r for r in validation.reverted(rows, lexicon).collect()}
    assert (got["1"].final_text, got["1"].reverted, got["1"].revert_rate) == ("كتاب", 1, 1.0)
    assert (got["2"].final_text, got["2"].kept) == ("بيت", 1) and (got["3"].final_text, got["3"].kept) == ("ررر", 1) and got["4"].final_text == "كتاب"
    assert got["5"].final_text == "قال: كتاب!" and (got["5"].reverted, got["5"].unchanged) == (1, 1)
    listed = spark.createDataFrame([("بيت", "كتاب")], "new string, old string")
    assert {r.sample_id: r.final_text for r in validation.reverted(rows, lexicon, listed).collect()}["2"] == "كتاب"
    rate = {r.sample_id: r.rate for r in validation.text_validity(spark.createDataFrame([("1", "كتاب ددد"), ("2", "abc")], "sample_id string, t string"), lexicon, "sample_id", "t").collect()}
    assert rate == {"1": 0.5, "2": 1.0}


def test_runaway_texts(spark):
    loop = "بداية النص " + "جملة مكررة هنا " * 20
    cases = [("نص", "نص"), (None, "نص"), ("ـ" * 500, "نص"), ("مرحبا" + "ـ " * 400, "نص"), (loop, "بداية النص جملة"), ("abc def " * 40, "x" * 20), ("ـ" * 30_000 + " x", "نص")]
    rows = spark.createDataFrame([(i, g, None, t) for i, (t, g) in enumerate(cases)], "i int, gt_text string, ocr_text string, corrected_text string")
    cut = [r.corrected_text_fixed for r in validation.without_runaways(rows).orderBy("i").collect()]
    assert cut[:4] == ["نص", None, "", "مرحباـ"] and cut[4].startswith("بداية النص") and len(cut[4]) < 40
    assert cut[5] == ("abc def " * 40)[:40].rstrip() and cut[6] == ""


def test_second_copies_match_their_definition():
    import re

    r, letter = random.Random(4), re.compile("[a-f]")
    for _ in range(300):
        n = r.choice([10, 20])
        unit = "".join(r.choice("abc .") for _ in range(r.randint(2, 40)))
        text = "".join(r.choice("abcdef 12") for _ in range(r.randint(0, 30))) + "".join(unit + "x" * r.choice([0, 0, 1, 6]) for _ in range(r.randint(1, 5)))
        zone, want = text[: max(4 * n, 300)], None
        for size in range(6, min(80, len(zone) // 2) + 1):
            for i in range(max(0, min(len(zone) - 2 * size, 2 * n))):
                lags = [d for d in range(size, size + max(5, int(0.3 * size)) + 1) if len(zone) >= i + d + size and zone[i : i + size] == zone[i + d : i + d + size]]
                if want is None and lags and letter.search(zone[i : i + size]):
                    want = i + lags[0]
        assert validation.second_copies(text, n, letter) == want


def test_runaway_numbers(spark):
    rows = spark.createDataFrame([("x" * 20, "o", "abc def " * 40), ("g", "o", "fine"), ("g", "o", None), ("نص", "o", "ـ" * 500)], "gt_text string, ocr_text string, corrected_text string")
    s = validation.runaway_stats(validation.without_runaways(rows)).first()
    assert (s.total, s.fixed, s.unchanged, s.emptied) == (4, 1, 2, 1)


def test_statistics(spark):
    p = {r.z: r.p for r in spark.createDataFrame([(0.0,), (-5.0,), (1.96,)], "z double").select("z", stats.normal_p(F.col("z")).alias("p")).collect()}
    assert p[0.0] == p[-5.0] == 1.0 and 0.04 < p[1.96] < 0.06
    assert stats.student_p(2.0, 10) == pytest.approx(0.07338803, abs=1e-7) and stats.student_p(0.0, 5) == 1.0 and stats.student_p(12.706, 1) == pytest.approx(0.05, abs=1e-4)
    r = random.Random(1)
    base = [r.random() for _ in range(60)]
    rows = [("base", str(i), i, v) for i, v in enumerate(base)] + [("good", str(i), i, v - 0.1 + r.random() / 50) for i, v in enumerate(base)] + [("same", str(i), i, v) for i, v in enumerate(base)]
    runs = spark.createDataFrame(rows, "run string, sample_id string, ord long, cer double")
    got = {x.run: x for x in stats.compare_all(runs, "base").collect()}
    assert got["good"].significant and got["good"].n == 60 and got["good"].cohens_d > 2 and not got["same"].significant and (got["same"].t_stat, got["same"].p_value, got["same"].p_corrected) == (0, 1, 2)
    ci = {x.run: (x.low, x.high) for x in stats.bootstrap_interval(runs, "base").collect()}
    exact = {x.run: (x.low, x.high) for x in stats.exact_bootstrap(runs, "base").collect()}
    assert ci["same"] == exact["same"] == (0, 0) and ci["good"] == pytest.approx(exact["good"], abs=0.003)


def test_run_comparisons(spark):
    runs = spark.createDataFrame([(k, d, s, i, c) for i, (k, d, s, c) in enumerate([("a", "x", "1", 0.5), ("a", "y", "2", 0.3), ("b", "x", "1", 0.2), ("b", "x", "1", 0.1), ("c", "x", "1", 0.0), ("c", "y", "2", 0.0)])], "run string, dataset string, sample_id string, ord long, cer double")
    shared = {(r.run, r.sample_id): r.cer for r in outcomes.in_every_run(runs).collect()}
    assert shared == {("a", "1"): 0.5, ("b", "1"): 0.1, ("c", "1"): 0.0}
    averages = outcomes.run_averages(runs)
    assert outcomes.best_run(averages).first().run == "c" and {r.run: r.verdict for r in outcomes.ablation(averages, "c").collect()} == {"a": "component helps", "b": "component helps"}
    assert outcomes.synergy(averages, "a", ["b"], "c").first().verdict == "synergistic"
    assert set(jobs.run_comparison(runs, "a")) == {"averages", "best", "statistics", "intervals"}


def test_samples_and_splits(spark):
    rows = spark.createDataFrame([(i, "abc"[i % 3], f"f{i % 7}") for i in range(210)], "id long, s string, f string")
    got = sampling.stratified(rows, "s", {"a": 7, "b": 20}, "id", "f").collect()
    assert len(got) == 27 and len({r.f for r in got if r.s == "a"}) == 7
    again = sampling.stratified(rows.repartition(5), "s", {"a": 7, "b": 20}, "id", "f").collect()
    assert {r.id for r in got} == {r.id for r in again}
    pinned = spark.createDataFrame([(0,), (3,)], "id long")
    split = sampling.split_by_ratio(rows, "id", ["s"], 0.1, pinned).collect()
    assert sum(r.split == "val" for r in split) == 21 and {r.id: r.split for r in split}[0] == "val" and len(split) == 210
    assert sampling.compat_shuffle(["a", "b", "c"]) == sampling.compat_shuffle(["a", "b", "c"])


def test_joins(spark):
    d = spark.createDataFrame([("A",), ("B",), ("C",)], "stem string")
    images = spark.createDataFrame([("a",), ("b_a",), ("B_b",)], "image_stem string")
    assert sorted((r.stem, r.image_stem or "") for r in relational.with_variants(d, images).collect()) == [("A", "a"), ("B", "B_b"), ("B", "b_a"), ("C", "")]
    z = spark.createDataFrame([([1, 2, 3], [4, 5])], "a array<int>, b array<int>").select(relational.zipped(F.col("a"), F.col("b")).alias("z")).first().z
    assert [tuple(x) for x in z] == [(1, 4), (2, 5)]


def test_retrieval(spark):
    docs = spark.createDataFrame([(1, "the quick fox"), (2, "lazy dogs sleep"), (3, "quick quick fox")], "doc_id long, text string")
    found = retrieval.bm25(spark.createDataFrame([(9, "quick fox"), (8, "zzz")], "item_id long, text string"), gram_index(docs), 2).collect()
    assert {r.doc_id for r in found} == {1, 3} and {r.item_id for r in found} == {9}
    vectors = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.9, 0.1]), (3, [0.0, 1.0])], "vec_id long, embedding array<float>")
    near = retrieval.dense(vectors.where("vec_id = 1").withColumnRenamed("vec_id", "query_id"), vectors, 1)
    assert near.first().vec_id == 2
    lexical = spark.createDataFrame([(1, 2, 4.0), (1, 3, 8.0)], "query_id long, vec_id long, score double")
    both = {r.vec_id: r.score for r in retrieval.hybrid(lexical, near, "query_id", "vec_id", 5).collect()}
    assert both[3] == pytest.approx(0.6) and both[2] > 0.6
    sig = spark.createDataFrame([(1, ["a", "b"], ["x"], 2, 0), (2, ["a"], ["x"], 2, 0), (3, ["q"], ["y"], 9, 9)], "query_id long, chars array<string>, types array<string>, difficulty int, invalid int")
    hits = signature_matches(sig.where("query_id = 1"), sig.where("query_id > 1").withColumnRenamed("query_id", "entry_id")).collect()
    assert [(r.entry_id, round(r.score, 6)) for r in hits] == [(2, 0.8)]


def test_prompts(spark):
    base = "rules\n<examples>\nold\n</examples>\n<output_format>"
    inject = lambda b, t, f=prompts.inject: spark.range(1).select(f(F.lit(b), F.lit(t)).alias("v")).first().v
    assert inject(base, "NEW") == "rules\nNEW\n\n<examples>\nold\n</examples>\n<output_format>"
    assert inject("rules\n<output_format>", "NEW") == "rules\nNEW\n\n<output_format>" and inject("rules \n", "NEW") == "rules\n\nNEW" and inject(base, "  ") == base
    assert inject(base, "EX", prompts.inject_examples) == "rules\n<examples>\nold\n\nEX\n</examples>\n<output_format>" and "<examples>\nEX\n</examples>" in inject("r", "EX", prompts.inject_examples)
    rows = spark.createDataFrame([("a", "ocr_aware", "c"), ("b", "ocr_aware", "  "), ("c", "odd", "c"), ("d", "combined", "c")], "ocr_text string, prompt_type string, confusion_context string")
    got = {r.ocr_text: r for r in prompts.with_prompts(rows).collect()}
    assert [got[k].prompt_used for k in "abcd"] == ["ocr_aware", "zero_shot", "zero_shot", "combined"] and got["b"].messages[0].content == prompts.BASE and got["a"].messages[1].content == "a"


def test_correctors(spark):
    @correct.backend("failing")
    def failing():
        def run(texts):
            raise RuntimeError("no model")

        return run

    rows = spark.createDataFrame([("1", "d", "نص"), ("2", "d", None)], "sample_id string, dataset string, ocr_text string")
    assert {(r.sample_id, r.corrected_text, r.success) for r in correct.corrected(rows).collect()} == {("1", "نص", True), ("2", None, False)}
    try:
        bad = correct.corrected(rows.limit(1), "failing").first()
        assert (bad.corrected_text, bad.success, bad.error) == ("نص", False, "no model")
    finally:
        del correct.BACKENDS["failing"]
    assert correct.identity(rows).where("success").count() == 2
    with pytest.raises(KeyError):
        correct.corrected(rows, "none such")


def test_readers(spark, tmp_path):
    ocr, gt = tmp_path / "ocr", tmp_path / "gt"
    ocr.mkdir(), gt.mkdir()
    for stem, o, g in (("a_1", "نص واحد", "نص واحد"), ("a_2", "", "x"), ("a_3", "ثلاثة" + "ه" * 20, "ثلاثة"), ("only", "o", None)):
        (ocr / f"{stem}.txt").write_text(o, "utf-8")
        if g is not None:
            (gt / f"{stem}.txt").write_bytes(g.encode("cp1256"))
    got = {r.sample_id: r for r in readers.paired_files(spark, str(ocr), str(gt), "K", "cp1256").collect()}
    assert set(got) == {"a_1", "a_3"} and got["a_1"].gt_text == "نص واحد" and got["a_3"].ocr_text == "ثلاثة" + "ه" * 5
    (tmp_path / "lines.txt").write_bytes("واحد\nاثنان\nثلاثة".encode("cp1256"))
    by_line = {r.sample_id: r.gt_text for r in readers.font_lines(spark, str(ocr), str(tmp_path / "lines.txt"), "P").collect()}
    assert by_line == {"a_1": "واحد", "a_3": "ثلاثة"}
    (tmp_path / "c.jsonl").write_text('{"sample_id": "1", "latency_s": 2}\nbroken\n{"sample_id": "2", "success": false}\n')
    assert [(r.sample_id, r.success) for r in readers.json_lines(spark, str(tmp_path / "c.jsonl")).orderBy("sample_id").collect()] == [("1", None), ("2", False)]
    manifests = spark.createDataFrame([('{"splits": {"F": {"train": ["1", "2"], "val": ["3"]}}}',), ('{"splits": {"test": ["9"]}}',)], "value string")
    assert {tuple(r) for r in readers.split_manifest(manifests).collect()} == {("F", "train", "1"), ("F", "train", "2"), ("F", "val", "3"), (None, "test", "9")}
    tagged = json.dumps({"line_10": {"text": "ten"}, "line_2": {"text": " two ", "tags": {"Crossed_out": 0}}, "line_3": {"text": "gone", "tags": {"Crossed_out": 1}}, "other": {"text": "no"}})
    assert readers.tagged_lines(spark.createDataFrame([(1, tagged)], "k int, value string"), "k").first().text == "two\nten"
    html = spark.createDataFrame([("<p>a &amp; b</p><script>x()</script><STYLE>y</STYLE>\n\n\n\nc",)], "h string")
    assert html.select(readers.html_text(F.col("h")).alias("t")).first().t == "a & b \n\nc"


def test_sinks_and_stream(spark, tmp_path):
    rows = spark.createDataFrame([("d", "1", "x"), ("e", "2", "y")], "dataset string, sample_id string, v string")
    assert sinks.append_new(rows, str(tmp_path / "out"), ["dataset", "sample_id"]).count() == 2
    sinks.append_new(rows.unionByName(spark.createDataFrame([("d", "3", "z")], rows.schema)), str(tmp_path / "out"), ["dataset", "sample_id"])
    assert spark.read.json(str(tmp_path / "out")).count() == 3
    assert "| d | 1 | x |" in sinks.markdown(rows, "t") and json.loads(sinks.as_json_document(rows, "dataset").first().json)["e"]["v"] == "y"
    from pairloom.streaming.resume import arriving, correct_stream

    inbox = tmp_path / "in"
    inbox.mkdir()
    (inbox / "a.json").write_text('{"sample_id": "1", "dataset": "d", "ocr_text": "نص"}\n{"sample_id": "1", "dataset": "d", "ocr_text": "نص"}\n')
    for _ in range(2):
        correct_stream(arriving(spark, str(inbox)), str(tmp_path / "done"), str(tmp_path / "check")).awaitTermination()
        (inbox / "b.json").write_text('{"sample_id": "2", "dataset": "d", "ocr_text": "نص"}\n{"sample_id": "1", "dataset": "d", "ocr_text": "نص"}\n')
    assert sorted(r.sample_id for r in spark.read.parquet(str(tmp_path / "done")).collect()) == ["1", "2"]


def test_jobs(spark):
    rows = samples(spark, [("abc", "abx", "abc"), ("abc", "abc", "axc")])
    assert all(df.count() >= 0 for df in [*jobs.baseline(rows).values(), *jobs.analysed(rows).values()])
    assert jobs.correction_run(rows.withColumn("prompt_type", F.lit("zero_shot")), rows.where("sample_id = '0'")).count() == 1
    assert jobs.trial_matrix(spark, ["a", "b"], [False, True]).count() == 4 and jobs.datasets_wanted(None, [], ["x"]) == ["x"]
