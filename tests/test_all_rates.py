"""Eight rates of a correction in one pass, against scores of one text at a time."""

import random

from pyspark.sql import functions as F

from pairloom.operators import outcomes, pairs


def rows_of(spark):
    r = random.Random(3)
    line = lambda: "".join(r.choice("aabcde ًِكآ.,") for _ in range(r.choice([0, 3, 30, 90])))
    rows = [(r.choice(["d", "e", None]), a, r.choice([a, line(), a + " " + line(), None, a.replace("a", "b")]), r.choice([a, line(), None, ""])) for a in (line() for _ in range(400))]
    rows += [("d", None, "x", "y"), ("d", "ha", "ha " * 700, "ha ha"), ("d", "a b", "a bc", "a b c d"), (None, "a-b c", "a b", "a")]
    return spark.createDataFrame([(n, *x) for n, x in enumerate(rows)], "id long, dataset string, gt_text string, ocr_text string, corrected_text string")


def test_equal_to_scores_of_each_text(spark):
    rows = rows_of(spark)
    got = {x.id: x for x in pairs.all_rates(rows, ["id"]).collect()}
    assert len(got) == rows.count()
    for raw in (False, True):
        for name, text in (("ocr", F.col("ocr_text")), ("llm", F.coalesce("corrected_text", "ocr_text"))):
            for x in pairs.scored(rows.withColumn("h", text), "h", raw).select("id", "cer", "wer").collect():
                assert (got[x.id][f"cer_{name}{'_raw' * raw}"], got[x.id][f"wer_{name}{'_raw' * raw}"]) == (x.cer, x.wer)


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_outcomes_queue_no_rows_for_python(spark):
    """A Python function in a projection holds all columns of its rows in a queue, in memory and then on disk (F7)."""
    got = outcomes.rate_summary(rows_of(spark), ["dataset"])
    assert "ArrowEvalPython" not in plan(got) and got.columns[:5] == ["dataset", "n", "improved", "regressed", "unchanged"]
    want = outcomes.outcome_summary(outcomes.compared(rows_of(spark)), ["dataset"])
    of = lambda df: sorted(((str(x.dataset), x.n, x.improved, x.regressed, x.unchanged) for x in df.collect()))
    assert of(got) == of(want)


def test_training_metrics_queue_no_rows_for_python(spark, monkeypatch):
    """As above, where the values are written (F8)."""
    plans, write = [], outcomes.kept
    monkeypatch.setattr(outcomes, "kept", lambda df, name: (plans.append(plan(df)), write(df, name))[1])
    assert outcomes.training_metrics(rows_of(spark)).count() > 0
    assert plans and "ArrowEvalPython" not in plans[0]
