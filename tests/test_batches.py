"""Distances and errors of whole batches against those of single pairs, and summaries that read their rows once."""

import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pairloom import queries
from pairloom.functions import batches, edit
from pairloom.functions.classify import TYPED
from pairloom.operators import errors, outcomes, sampling, selection, stats

ROWS = "dataset string, sample_id string, ord long, gt_text string, ocr_text string, corrected_text string"


def _pairs(count=1500, seed=1):
    r = random.Random(seed)
    text = lambda n, of="aeioubcd \n\tأإ": "".join(r.choice(of) for _ in range(n))
    for k in range(count):
        a = text(r.choice([0, 1, 3, 20, 63, 64, 65, 130, 330]))
        yield a, [a.translate(str.maketrans("aeiou", "eaoiu")), a + "ha " * r.randrange(80), text(r.choice([0, 2, 60, 300])), "".join(c for c in a if r.random() < 0.8), "".join(c if r.random() < 0.9 else r.choice("xyz") for c in a), a[5:] + a[:5]][k % 6]


def test_distances_of_batches():
    pairs = list(_pairs())
    assert batches.edit_distances(*zip(*pairs)).tolist() == [edit.edit_distance(*p) for p in pairs]
    words = [(a.split(" "), b.split(" ")) for a, b in pairs]
    assert batches.edit_distances(*zip(*words)).tolist() == [edit.edit_distance(*p) for p in words]


def test_errors_of_batches_are_those_of_single_pairs():
    pairs = list(_pairs())
    want = [edit.char_errors_of(*p) for p in pairs]
    batch = pa.RecordBatch.from_pydict({"k": list(range(len(pairs))), "ref": [a for a, _ in pairs], "hyp": [b for _, b in pairs]})
    got, tallied = [[] for _ in pairs], [{} for _ in pairs]
    for part in batches.error_rows(iter([batch])):
        assert part.num_rows <= batches._ROWS
        for row in part.to_pylist():
            k, at = row.pop("k"), row.pop("at")
            assert at == len(got[k])
            got[k].append(row)
    assert got == want
    for row in (x for part in batches.error_tallies(iter([batch])) for x in part.to_pylist()):
        tallied[row.pop("k")][row["gt_char"], row["ocr_char"], row["error_type"], row["position"]] = row["count"]
    assert [sum(t.values()) for t in tallied] == [len(x) for x in want]
    assert batches.error_counts(*zip(*pairs)) == [[sum(e["error_type"] == t for e in x) for t in TYPED] for x in want]
    words = [(a.split(), b.split()) for a, b in pairs]
    assert [[dict(zip(("gt_word", "ocr_word", "is_merged", "is_split"), e)) for e in x] for x in batches.word_errors(*zip(*words))] == [edit.word_errors_of(*p) for p in words]


def test_batches_of_many_errors_are_cut():
    """a batch of pairs with thousands of errors each was one list of records."""
    batch = pa.RecordBatch.from_pydict({"ref": ["ab"] * 400, "hyp": ["ab " + "ha " * 600] * 400})
    sizes = [p.num_rows for p in batches.error_rows(iter([batch]))]
    assert sum(sizes) == 400 * 1801 and max(sizes) <= batches._ROWS
    assert sum(sum(p["count"].to_pylist()) for p in batches.error_tallies(iter([batch]))) == sum(sizes) and max(p.num_rows for p in batches.error_tallies(iter([batch]))) < 10


def test_first_errors_of_each_type_are_enough_for_examples(rows):
    """every error of the table was sorted for a few examples."""
    few, every = errors.char_error_rows(rows, first=2), errors.char_error_rows(rows)
    assert few.count() < every.count()
    assert sorted(errors.first_examples(few, ["dataset"], 2).collect()) == sorted(errors.first_examples(every, ["dataset"], 2).collect())


def test_lopsided_pairs_take_the_same_path():
    r = random.Random(3)
    for _ in range(200):
        a, b = ("".join(r.choice("abc ") for _ in range(r.randrange(n))) for n in (30, 200))
        for x, y in ((a, b), (b, a)):
            table = [[max(i, j) if not i or not j else 0 for j in range(len(y) + 1)] for i in range(len(x) + 1)]
            for i in range(1, len(x) + 1):
                for j in range(1, len(y) + 1):
                    table[i][j] = min(table[i - 1][j - 1] + (x[i - 1] != y[j - 1]), table[i - 1][j] + 1, table[i][j - 1] + 1)
            i, j, path = len(x), len(y), []
            while i or j:
                if i and j and (x[i - 1] == y[j - 1] or table[i][j] == table[i - 1][j - 1] + 1):
                    i, j, step = i - 1, j - 1, (x[i - 1], y[j - 1])
                elif i and table[i][j] == table[i - 1][j] + 1:
                    i, step = i - 1, (x[i - 1], None)
                else:
                    j, step = j - 1, (None, y[j - 1])
                path.append(step)
            assert edit.align(x, y) == path[::-1]


@pytest.fixture(scope="module")
def rows(spark):
    texts = [("abc def", "abx def ha ha", "abc def"), ("abc", "abc", "axc"), ("q r s", "q", "q r t"), ("same", "same", None), ("a b", "a", "")]
    return spark.createDataFrame([("d" if i % 2 else "e", f"s{i}", i, *t) for i, t in enumerate(texts * 3)], ROWS)


def test_tallies_and_rows_give_the_same_summaries(rows):
    one, many = errors.char_error_tallies(rows, ["dataset"]), errors.char_error_rows(rows)
    for f in (lambda x: errors.taxonomy(x, ["dataset"]), lambda x: errors.confusion_matrix(x, ["dataset"], 1, False)):
        assert sorted(f(one).collect()) == sorted(f(many).collect())
    kinds = lambda f, n: {(r.dataset, r.kind): r.n for r in errors.unfixed_and_introduced(f(rows), f(rows, "corrected_text")).groupBy("dataset", "kind").agg(n.alias("n")).collect()}
    assert kinds(errors.word_error_tallies, F.sum("count")) == kinds(errors.word_error_rows, F.count("*"))


def _compared_once(frame):
    """How many times a plan aligns or measures texts in Python."""
    return frame._jdf.queryExecution().optimizedPlan().toString().count("ArrowEvalPython")


def test_comparisons_are_read_once(rows, spark):
    """each branch of a union or join compared all texts again."""
    compared = outcomes.compared(rows)
    runs = compared.select("sample_id", "ord", "dataset", F.explode(F.array(F.struct(F.lit("base").alias("run"), F.col("cer_ocr").alias("cer")), F.struct(F.lit("llm").alias("run"), F.col("cer_llm").alias("cer")))).alias("r")).select("sample_id", "ord", "dataset", "r.*")
    small = compared.select("sample_id", "outcome", "cer_delta", "cer_ocr", "cer_llm")
    assert _compared_once(compared) and not any(_compared_once(f) for f in (outcomes.extremes(small), selection.degraded_then_hard(small, 2), stats.compare_all(runs, "base")))


def test_a_mean_of_both_rates_in_one_pass(spark, rows, monkeypatch):
    """F24."""
    monkeypatch.setattr(queries, "samples", lambda *_: rows)
    assert not _compared_once(queries.agg05_delta(spark, ""))


def test_a_stratum_is_cut_before_it_is_shuffled(spark):
    """all rows of a stratum were sorted in one task."""
    drawn = sampling.stratified(spark.range(100).select("id", (F.col("id") % 2).cast("string").alias("s")), "s", {"0": 3, "1": 2}, "id")
    assert "WindowGroupLimit" in drawn._jdf.queryExecution().executedPlan().toString() and drawn.groupBy("s").count().orderBy("s").collect() == [("0", 3), ("1", 2)]
