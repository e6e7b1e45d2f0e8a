"""Rules of samples, splits, prompt formats and loaders, with known results."""

from pyspark.sql import functions as F

from pairloom.functions import classify
from pairloom.operators import errors, knowledge, sampling
from pairloom.sources import readers


def test_targets_by_percent():
    assert sampling.targets_of(150) == {"correct": 15, "easy": 15, "medium": 60, "hard": 60}
    assert sampling.targets_of(25) == {"correct": 2, "easy": 2, "medium": 10, "hard": 11} and sum(sampling.targets_of(7).values()) == 7


def test_samples_by_difficulty(spark):
    rows = [(f"s{i}", ["A", "A", "A", "B", None][i % 5], "d", 100 if i else 3, i == 1, [0.0, 0.03, 0.2, 0.9][i % 4]) for i in range(80)]
    frame = spark.createDataFrame(rows, "sample_id string, font string, dataset string, chars int, is_runaway boolean, cer double")
    got = sampling.by_difficulty(frame, {"correct": 3, "easy": 2, "hard": 100}).collect()
    assert sorted(r.difficulty for r in got) == ["correct"] * 3 + ["easy"] * 2 + ["hard"] * 20
    assert {r.font for r in got if r.difficulty == "correct"} == {"A", "B", None} and not {"s0", "s1"} & {r.sample_id for r in got}
    assert sorted(r.difficulty for r in sampling.prompt_mix(frame).collect()) == ["correct"] * 5 + ["easy"] * 5 + ["hard"] * 5 + ["medium"] * 10


def test_validation_split(spark):
    rows = spark.createDataFrame([(f"g{i}", "G", i % 2 == 0) for i in range(30)] + [("h1", "H", True), ("h2", "H", False)] + [("n", None, False)], "k string, g string, blank boolean")
    pinned = spark.createDataFrame([("g0",), ("g2",), ("zz",)], "k string")
    split = lambda **o: {r.k: r.split for r in sampling.validation_split(rows, "k", ["g"], 0.15, **o).collect()}
    plain = split()
    order = sorted((f"g{i}" for i in range(30)), key=lambda k: __import__("hashlib").md5(f"42:{k}".encode()).hexdigest())
    assert {k for k in plain if plain[k] == "val" and k[0] == "g"} == set(order[:4]) and plain["n"] == "val"  # round(4.5) is 4; one at least
    assert sum(plain[k] == "val" for k in ("h1", "h2")) == 1
    held = split(pinned=pinned, empty="blank")
    others = [k for k in order if k not in ("g0", "g2")][:2]
    assert {k for k in held if held[k] == "val" and k[0] == "g"} == {"g0", "g2"} | {k for k in others if int(k[1:]) % 2}
    assert len(held) == 33


def test_aligned_split(spark):
    rows = spark.createDataFrame([(i, f, i == 3 and f == "A") for f in ("A", "B") for i in range(20) if not (f == "B" and i > 15)], "n int, font string, blank boolean")
    got = sampling.aligned_split(rows, "n", "font", 0.5, spark.createDataFrame([(3,), (19,)], "n int"), "blank").collect()
    sides = {}
    for r in got:
        sides.setdefault(r.n, set()).add(r.split)
    assert set(sides) == set(range(16)) and all(len(x) == 1 for x in sides.values()) and sides[3] == {"val"}
    assert sum(x == {"val"} for x in sides.values()) == 8


def test_single_pages_in_one_script(spark):
    docs = spark.createDataFrame([(1, [1], "كتاب"), (2, [1, 2], "كتاب"), (3, [1], "كتاب ab"), (4, [1], "كتاب a 1"), (5, [1], None)], "k int, pages array<int>, t string")
    got = {(r.k, r.split) for r in sampling.single_page_split(docs, docs, "k", "pages", "t", 0).collect()}
    assert got == {(k, "training") for k in (1, 3, 4, 5)} | {(1, "testing"), (4, "testing")}
    assert sampling.single_page_split(docs, docs, "k", "pages", "t", 1).where("split = 'testing'").count() == 1


def test_confusions_by_group(spark):
    rows = [("ة", "ه", 50, 0.5), ("أ", "ا", 40, 0.4), ("ب", "ت", 30, 0.3), ("ح", "ج", 20, 0.2), ("ى", "ي", 10, 0.1), ("ع", "غ", 5, 0.1), ("x", "y", 1, 0.1)]
    matrix = spark.createDataFrame(rows, "gt_char string, ocr_char string, count long, probability double")
    text = errors.format_confusions_by_group(matrix, 6).first().text
    assert text.split("\n") == ["- Taa marbuta and haa: ة ~ ه", "- Hamza forms: أ ~ ا", "- Alef maksura and yaa: ى ~ ي", "- Dots: ب ~ ت, ح ~ ج", "- Others: ع ~ غ"]
    assert errors.format_confusions_by_group(matrix.where("false")).first().text == ""
    kinds = spark.createDataFrame([("ع", "غ"), ("", "ب"), ("ب", None), ("ء", "أ")], "a string, b string").select(classify.confusion_type(F.col("a"), F.col("b"))).collect()
    assert [r[0] for r in kinds] == ["other_substitution"] * 3 + ["hamza"]


def test_word_pair_texts(spark):
    pairs = spark.createDataFrame([("introduced", "a", "b")] * 3 + [("introduced", "c", "d"), ("introduced", "e", "e"), ("introduced", "", "x"), ("unfixed", "q", "r")], "kind string, wrong string, right string")
    ranked = knowledge.ranked_pairs(pairs, "introduced")
    assert [(r.wrong, r["count"], r["rank"]) for r in ranked.orderBy("rank").collect()][0] == ("a", 3, 1)
    assert knowledge.overcorrection_text(ranked, 5).first().text.split("\n") == ["- do not write a where the text has b (3 times)", "- do not write c where the text has d"]
    assert knowledge.word_examples_text(ranked, 1).first().text == "- a: b" and knowledge.word_examples_text(knowledge.ranked_pairs(pairs, "none")).first().text == ""


def test_font_files(spark, tmp_path):
    assert readers.font_file("gt", "Traditional") == "gt/PATS_A01_Dataset/TraditionalText.txt" and readers.font_file("gt", "Akhbar") == "gt/PATS_A01_Dataset/A01-AkhbarText.txt"
    (tmp_path / "A_1.txt").write_text("one")
    (tmp_path / "A_2.txt").write_text("two")
    (tmp_path / "gt.bin").write_bytes("\n \r\nكتاب\r\nقلم\n".encode("cp1256"))
    got = {r.sample_id: r.gt_text for r in readers.font_lines(spark, str(tmp_path / "A_*.txt"), str(tmp_path / "gt.bin"), "P").collect()}
    assert got == {"A_1": "كتاب", "A_2": "قلم"}
