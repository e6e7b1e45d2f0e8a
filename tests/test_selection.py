"""Picks, knowledge, loaders over a file tree, and long inputs, with known results."""

import json

import pytest
from pyspark.sql import functions as F

from pairloom.functions import edit
from pairloom.operators import correct, knowledge, prompts, retrieval, selection
from pairloom.sources import readers, sinks
from test_text import table_path


def write(path, data):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(data if isinstance(data, bytes) else data.encode())


def test_loaders_over_a_file_tree(spark, tmp_path):
    for n, t in ((1, "one"), (2, "two"), (10, "ten"), (3, " ")):
        write(tmp_path / "ocr/pats/A" / f"A_{n}.txt", t)
    write(tmp_path / "gt/A.txt", "\n".join(["كتاب", "قلم", "باب", *"defghij"]).encode("cp1256"))
    write(tmp_path / "ocr/kitab/x.txt", "kx")
    write(tmp_path / "gt/kitab/x.txt", "gx")
    for book in ("b1", "b2"):
        write(tmp_path / f"ocr/hist/{book}/{book}p.txt", book)
        write(tmp_path / f"gt/hist/{book}/{book}p.txt", "ref")
    at = lambda x: str(tmp_path / x)
    folders = {"PATS-A01-Akhbar": (at("ocr/pats/A"), at("gt/A.txt")), "Kitab-charts": (at("ocr/kitab"), at("gt/kitab")), "Historical": (at("ocr/hist"), at("gt/hist")), "KHATT": (at("nowhere"), at("gt"))}
    with pytest.warns(UserWarning, match="KHATT"):
        rows = {(r.dataset, r.sample_id): (r.font, r.gt_text) for r in readers.load_all(spark, folders).collect()}
    assert rows["PATS-A01-Akhbar", "A_1"] == ("Akhbar", "كتاب") and rows["PATS-A01-Akhbar", "A_10"] == ("Akhbar", "j") and ("PATS-A01-Akhbar", "A_3") not in rows
    assert rows["Kitab-charts", "charts_x"] == ("charts", "gx") and rows["Historical", "b1p"][0] == "b1" and len(rows) == 6
    ids = spark.createDataFrame([("a_2",), ("a_10",)], "sample_id string")
    one = readers.load(spark, "PATS-A01-Akhbar", *folders["PATS-A01-Akhbar"], ids=ids, limit=1).collect()
    assert [r.sample_id for r in one] == ["A_2"]
    with pytest.raises(ValueError):
        readers.family("nothing")


def test_corrections_are_found(spark, tmp_path):
    line = lambda i: json.dumps({"sample_id": i, "dataset": "d"}) + "\n"
    write(tmp_path / "one/corrections.jsonl", line("all"))
    write(tmp_path / "one/d/corrections.jsonl", line("part"))
    write(tmp_path / "two/d/corrections.jsonl", line("d"))
    write(tmp_path / "two/e/corrections.jsonl", line("e"))
    ids = lambda f: sorted(r.sample_id for r in readers.corrections(spark, str(tmp_path / f)).collect())
    assert ids("one") == ["all"] and ids("two") == ["d", "e"] and ids("none") == []
    assert readers.first_corrections(spark, [str(tmp_path / "none"), str(tmp_path / "two")]).count() == 2
    with pytest.raises(FileNotFoundError):
        readers.first_corrections(spark, [str(tmp_path / "none")])


def test_encodings_are_sniffed(spark):
    rows = [(0, "نص".encode()), (1, b"\xef\xbb\xbf" + "نص".encode()), (2, "نص".encode("cp1256")), (3, b"plain"), (4, b"bad \xff")]
    got = {r.i: r.t for r in spark.createDataFrame(rows, "i int, c binary").select("i", readers.sniffed(F.col("c")).alias("t")).collect()}
    assert got[0] == got[1] == got[2] == "نص" and got[3] == "plain" and got[4].startswith("bad ")


def test_second_engine(spark):
    rows = spark.createDataFrame([("d", "1", "a", "g"), ("d", "2", "b", "g")], "dataset string, sample_id string, ocr_text string, gt_text string")
    got = readers.second_ocr(rows, rows.where("sample_id = '2'").withColumn("ocr_text", F.lit("z"))).collect()
    assert [(r.sample_id, r.ocr_text, r.gt_text) for r in got] == [("2", "z", "g")]


def test_stored_confusions(spark, tmp_path):
    top = {"top_20": [{"gt": "a", "ocr": "b", "count": 5, "probability": 0.5}], "confusions": {"x": {"y": {"count": 9, "probability": 0.1}}}}
    write(tmp_path / "top.json", json.dumps(top))
    write(tmp_path / "flat.json", json.dumps({"top_20": [], "confusions": {"x": {"y": {"count": 2, "probability": 0.1}, "z": {"count": 7, "probability": 0.2}}}}))
    write(tmp_path / "bad.json", "{nope")
    read = lambda f: [(r.gt_char, r.ocr_char, r["count"]) for r in knowledge.stored_confusions(spark, str(tmp_path / f)).collect()]
    assert read("top.json") == [("a", "b", 5)] and read("flat.json") == [("x", "z", 7), ("x", "y", 2)]
    with pytest.raises(FileNotFoundError):
        read("missing.json")
    with pytest.raises(ValueError):
        read("bad.json")


def test_word_pairs_and_examples(spark):
    pairs = spark.createDataFrame([("cat", "cut", 9), ("hat", "hut", 8), ("dot", "dit", 3), ("pen", "pan", 2)], "wrong string, right string, count long")
    assert [r.wrong for r in knowledge.pairs_by_coverage(pairs, 3).orderBy("rank").collect()] == ["cat", "dot", "pen"]
    assert [r.wrong for r in knowledge.pairs_by_coverage(pairs, 4).orderBy("rank").collect()] == ["cat", "dot", "pen", "hat"]
    assert [r.wrong for r in knowledge.pick_pairs(pairs, 2).collect()] == ["cat", "hat"] and knowledge.pick_pairs(pairs, 2, "random").count() == 2
    rows = spark.createDataFrame([(str(i), "x" * 20, "y" * 20, c) for i, c in enumerate([0.0, 0.01, 0.02, 0.1, 0.3, 0.9, 0.01])], "sample_id string, ocr_text string, gt_text string, cer double")
    got = selection.few_shot_pick(rows, 4, rows.where("sample_id = '1'")).collect()
    assert sorted(r.stratum for r in got) == [0, 1, 2, 3] and not {"0", "1"} & {r.sample_id for r in got}
    assert len(knowledge.pick_examples(rows, 3)) == 3 and knowledge.pick_examples(rows, 3, max_chars=5) == []
    assert knowledge.format_examples([("a", "b")]) == "1.\na\n→ b"


def test_injected_pairs_and_index(spark):
    injected = spark.createDataFrame([("ب", "ت", 5), ("ا", "أ", 9)], "gt_char string, ocr_char string, count long")
    counts = lambda **n: spark.createDataFrame(list(n.items()), "error_type string, n long")
    got = [(r.rank, r.error_type, r.baseline, r.after, r.change) for r in knowledge.injected_impact(injected, counts(hamza=10, insertion=1), counts(hamza=4, dot_confusion=2)).orderBy("rank").collect()]
    assert got == [(1, "hamza", 10, 4, -6), (2, "dot_confusion", 0, 2, 2)]
    index = spark.createDataFrame([(["a", "b", "a"],), (["a"],), ([],)], "error_types array<string>")
    assert {r.error_type: r.n for r in knowledge.index_histogram(index).collect()} == {"a": 2, "b": 1, None: 1}


def test_orders_and_filters(spark):
    rows = spark.createDataFrame([("10",), ("9",), ("b",), ("a",)], "stem string")
    assert [r.stem for r in rows.orderBy(*selection.loader_order(F.col("stem"))).collect()] == ["9", "10", "a", "b"]
    assert selection.single_page(spark.createDataFrame([([1],), ([1, 2],)], "pages array<int>")).count() == 1
    rates = spark.createDataFrame([("a", 5, 1.0, 0.2), ("a", 0, 1.0, 0.9), ("b", 5, 9.0, 0.5)], "k string, chars int, length_ratio double, cer double")
    assert {r.k: (r.n, r.cer) for r in selection.mean_over_normal(rates, "k").collect()} == {"a": (1, 0.2), "b": (0, 0.0), None: (1, 0.1)}
    assert {r.k: r.cer for r in selection.mean_over_normal(rates, "k", None).collect()} == {"a": 0.2, "b": None, None: 0.2}


def test_long_texts_and_many_words(spark, monkeypatch):
    a = "abcdefghij" * 60
    rows = spark.createDataFrame([(a, a[:50] + "X" + a[51:] + "y"), (a, a[::-1]), (a, "z" * 650)], "a string, b string")
    got = [tuple(r) for r in rows.select(edit.distance(F.col("a"), F.col("b")), F.levenshtein("a", "b")).collect()]
    assert got[0][0] == 2 and all(x == y for x, y in got)
    words = lambda c: F.split(c, " ")
    many = " ".join(f"w{i}" for i in range(40_000))
    two = spark.createDataFrame([("a b c d e f", "a x c d f g"), ("a", "b"), (many, many.replace("w7 ", "")), (None, "a")], "a string, b string")
    assert [r[0] for r in two.select(edit.word_distance(words("a"), words("b"))).collect()] == [3, 1, 1, None]
    monkeypatch.setattr(edit, "_KEPT_BYTES", 1 << 10)  # columns in many blocks
    assert edit.align(a + "x", a[::-1]) == table_path(a + "x", a[::-1])


def test_answers_are_asked_again_one_by_one():
    asked = []

    def model(texts):
        asked.append(list(texts))
        if "bad" in texts:
            raise ValueError("no")
        return ["" if t == "empty" and len(asked) < 4 else t.upper() for t in texts]

    got = correct.answered(model, ["a", "bad", "empty", ""], 2)
    assert [x for x, _ in got] == ["A", None, "EMPTY", ""] and got[1][1] == "no" and asked[0] == ["a", "bad", "empty", ""]


def test_stores_prompts_and_tables(spark):
    rows = spark.createDataFrame([("1", "ab", "ab", 0.0), ("2", "ax", "ab", 0.5), ("3", "ax", "ab", 0.5), ("4", "x" * 50, "ab", 9.0)], "sample_id string, ocr_text string, gt_text string, cer double")
    assert [r.sample_id for r in retrieval.sentence_store(rows).collect()] == ["2"]
    store = retrieval.word_store(spark.createDataFrame([("w", "a", 1), ("w", "b", 5), ("v", "c", 2)], "wrong string, right string, count long"), 1)
    assert sorted((r.wrong, r["right"]) for r in store.collect()) == [("v", "c"), ("w", "b")]
    assert [r["right"] for r in retrieval.words_for(spark.createDataFrame([("1", "w v w")], "sample_id string, ocr_text string"), store, 1).collect()] == ["b"]
    asked = spark.createDataFrame([("t", "crafted", "Do it."), ("t", "meta", " ")], "ocr_text string, prompt_type string, crafted_prompt string")
    assert [(r.prompt_used, r.messages[0].content == "Do it.") for r in prompts.with_prompts(asked).collect()] == [("crafted", True), ("zero_shot", False)]
    assert "3 more rows are not shown." in sinks.markdown(spark.range(5), "t", 2) and "not shown" not in sinks.markdown(spark.range(2), "t", 2)
    vectors = spark.createDataFrame([(i, [1.0, float(i)]) for i in range(6)], "vec_id long, embedding array<float>")
    near = lambda n: sorted(map(tuple, retrieval.dense(vectors.selectExpr("vec_id AS query_id", "embedding"), vectors, 2, max_queries=n).select("query_id", "vec_id", "rank").collect()))
    assert near(2) == near(100) and len(near(2)) == 12
