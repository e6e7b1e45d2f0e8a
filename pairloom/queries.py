"""The driver's queries over the operators, and their DuckDB SQL.

No table of text pairs exists there, so pairs are derived from every line of every document, in expressions that both engines share: the ground truth is the
line in ASCII (other characters become question marks), noise and corrections follow from the numbers of document and line.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairloom.functions import blocks, classify, text
from pairloom.operators.pairs import spread_out
from pairloom.operators import correct, dense_index, errors, gram_index, knowledge, morphology, outcomes, pairs, prefix_sums, prompts, relational, retrieval, sampling, selection, signatures, stats, validation
from pairloom.plans import jobs, shared
from pairloom.sources import readers, sinks

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
ASCII_LETTERS = "[A-Za-z]"


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def samples(spark: SparkSession, d: str) -> DataFrame:
    """``sample_id, ord, doc_id, line_no, dataset, font, gt_text, ocr_text, corrected_text``."""
    lines = spread_out(table(spark, d, "documents").select("doc_id", "lang", "source", "text")).select("doc_id", F.col("lang").alias("dataset"), F.col("source").alias("font"), F.posexplode_outer(F.split("text", "\n")).alias("at", "line"))
    out = lines.select(
        F.concat_ws("_", F.col("doc_id").cast("string"), (F.col("at") + 1).cast("string")).alias("sample_id"), (F.col("doc_id") * 1_000_000 + F.col("at") + 1).alias("ord"), "doc_id", (F.col("at") + 1).cast("long").alias("line_no"), "dataset", "font",
        F.regexp_replace("line", "[^ -~]", "?").alias("gt_text"),
    )
    gt, n, k = F.col("gt_text"), F.col("doc_id"), F.col("line_no")
    ocr = F.when(n % 3 == 1, F.translate(gt, "aeiou", "eaoiu")).when((n % 3 == 2) & (k % 2 == 0), F.concat(gt, F.lit("ha " * 600))).when(n % 3 == 2, F.concat(gt, F.lit("=" * 40))).otherwise(gt)
    out = out.withColumn("ocr_text", ocr)
    o = F.col("ocr_text")
    fixed = F.when(n % 5 == 0, gt).when(n % 5 == 1, F.translate(o, "e", "a")).when(n % 5 == 2, o).when(n % 5 == 3, F.concat(o, F.lit(" xyz xyz"))).otherwise(F.lit(""))
    return out.withColumn("corrected_text", fixed)


SAMPLES = """l AS (SELECT doc_id, lang, source, unnest(string_split(text, chr(10))) AS line, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS line_no FROM documents),
g AS (SELECT doc_id || '_' || line_no AS sample_id, doc_id * 1000000 + line_no AS ord, doc_id, line_no, lang AS dataset, source AS font, regexp_replace(line, '[^ -~]', '?', 'g') AS gt_text FROM l),
o AS (SELECT *, CASE WHEN doc_id % 3 = 1 THEN translate(gt_text, 'aeiou', 'eaoiu') WHEN doc_id % 3 = 2 AND line_no % 2 = 0 THEN gt_text || repeat('ha ', 600) WHEN doc_id % 3 = 2 THEN gt_text || repeat('=', 40) ELSE gt_text END AS ocr_text FROM g),
s AS (SELECT *, CASE doc_id % 5 WHEN 0 THEN gt_text WHEN 1 THEN translate(ocr_text, 'e', 'a') WHEN 2 THEN ocr_text WHEN 3 THEN ocr_text || ' xyz xyz' ELSE '' END AS corrected_text FROM o)"""


def _quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def runs_sql(x: str) -> str:
    """Runs limited in SQL without back references: one replacement for each printable character."""
    return reduce(lambda e, c: f"regexp_replace({e}, {_quoted(re.escape(c) + '{6,}')}, {_quoted((c * 5).replace(chr(92), chr(92) * 2))}, 'g')", [chr(i) for i in range(32, 127)], x)


def norm_sql(x: str) -> str:
    return runs_sql(f"regexp_replace(trim({x}), ' +', ' ', 'g')")


_TOKENS = "len(list_filter(regexp_split_to_array({0}, '[\\s!-/:-@\\[-`{{-~]+'), lambda x: x <> ''))"
N = f"""{SAMPLES}, n AS (SELECT *, {norm_sql('gt_text')} AS ref, {norm_sql('ocr_text')} AS hyp, {norm_sql('corrected_text')} AS llm FROM s)"""
D = f"""{N}, d AS (SELECT *, length(ref) AS chars, length(hyp) AS hyp_chars, CASE WHEN length(ref) = 0 THEN 0.0 WHEN ref = hyp THEN 0.0 ELSE levenshtein(ref, hyp) / length(ref) END AS cer, length(hyp) / greatest(length(ref), 1) AS length_ratio FROM n)"""
C = f"""{D}, c AS (SELECT *, cer AS cer_ocr, CASE WHEN length(ref) = 0 OR ref = llm THEN 0.0 WHEN llm = hyp THEN cer ELSE levenshtein(ref, llm) / length(ref) END AS cer_llm FROM d WHERE gt_text <> ''),
q AS (SELECT *, cer_llm - cer_ocr AS cer_delta, CASE WHEN cer_llm < cer_ocr - 1e-6 THEN 'improved' WHEN cer_llm > cer_ocr + 1e-6 THEN 'regressed' ELSE 'unchanged' END AS outcome, trim(ocr_text) AS ot, trim(corrected_text) AS ct, trim(gt_text) AS gt FROM c)"""


# ---- scoring and summaries


@query(f"""WITH {D}, t AS (SELECT *, {_TOKENS.format('ref')} AS words FROM d), a AS (SELECT dataset, count(*) AS num_samples, CAST(sum(chars) AS BIGINT) AS num_chars_ref, CAST(sum(words) AS BIGINT) AS num_words_ref, avg(cer) AS cer,
coalesce(stddev_samp(cer), 0) AS cer_std, median(cer) AS cer_median, list_sort(list(cer)) AS v FROM t GROUP BY dataset)
SELECT dataset, num_samples, num_chars_ref, num_words_ref, cer, cer_std, cer_median, v[CAST(least(num_samples - 1, floor(num_samples * 0.95)) + 1 AS INTEGER)] AS cer_p95 FROM a""")
def agg01_metrics(spark, d):
    rows = pairs.scored(samples(spark, d), words=False).withColumn("words", F.size(text.tokens(F.col("ref"))))
    m = pairs.metrics(rows, ["dataset"], words=False, more=(F.sum("words").cast("long").alias("num_words_ref"),))
    return m.select("dataset", "num_samples", "num_chars_ref", "num_words_ref", "cer", "cer_std", "cer_median", "cer_p95")


@query()
def agg01_word_metrics(spark, d):
    return pairs.metrics(pairs.scored(samples(spark, d)), ["dataset"])


@query(f"""WITH {D} SELECT dataset, CAST(count(*) AS BIGINT) AS total_samples, count(*) FILTER (WHERE length_ratio <= 5) AS normal_samples, count(*) FILTER (WHERE length_ratio > 5) AS runaway_samples,
count(*) FILTER (WHERE length_ratio > 5) * 100.0 / greatest(count(*), 1) AS runaway_percentage, avg(cer) AS cer_all, avg(cer) FILTER (WHERE length_ratio <= 5) AS cer_normal, coalesce(stddev_samp(cer) FILTER (WHERE length_ratio <= 5), 0) AS cer_normal_std FROM d GROUP BY dataset""")
def agg03_quality(spark, d):
    return pairs.metrics_and_quality(pairs.scored(samples(spark, d), words=False), ["dataset"])


@query(f"""WITH {D}, m AS (SELECT 'with' AS variant, dataset, avg(cer) AS cer FROM d GROUP BY dataset UNION ALL SELECT 'without', dataset, avg(cer) FROM d GROUP BY dataset) SELECT * FROM m""")
def agg04_variants(spark, d):
    rows = samples(spark, d)
    return reduce(DataFrame.unionByName, [pairs.scored(rows, diacritics=x == "with", words=False).groupBy("dataset").agg(F.avg("cer").alias("cer")).withColumn("variant", F.lit(x)) for x in ("with", "without")])


@query(f"""WITH {C}, m AS (SELECT dataset, avg(cer_ocr) AS baseline, avg(cer_llm) AS improved FROM c GROUP BY dataset)
SELECT dataset, baseline, improved, baseline - improved AS delta, CASE WHEN baseline > 0 THEN (baseline - improved) / baseline * 100 ELSE 0 END AS relative_pct FROM m""")
def agg05_delta(spark, d):
    means = shared.kept(outcomes.compared(samples(spark, d)).groupBy("dataset").agg(F.avg("cer_ocr").alias("cer_ocr"), F.avg("cer_llm").alias("cer_llm")), "delta-means")
    mean = lambda c: means.select("dataset", F.col(c).alias("cer"))
    return pairs.metric_delta(mean("cer_ocr"), mean("cer_llm"), ["dataset"])


_KEY = "CASE dataset WHEN 'en' THEN 'PATS-A01-' || font || '-train' WHEN 'fr' THEN 'KHATT-train' ELSE 'Kitab-' || dataset END"


def _keyed(spark, d):
    key = F.when(F.col("dataset") == "en", F.concat(F.lit("PATS-A01-"), "font", F.lit("-train"))).when(F.col("dataset") == "fr", "KHATT-train").otherwise(F.concat(F.lit("Kitab-"), "dataset"))
    return samples(spark, d).withColumn("dataset", key)


_SUMMARY = f"""{D}, k AS (SELECT {_KEY} AS key, * EXCLUDE (dataset) FROM d), m AS (SELECT key AS dataset, CASE WHEN key LIKE 'PATS-A01%' THEN 'PATS-A01' WHEN key LIKE 'KHATT%' THEN 'KHATT' ELSE 'other' END AS family, avg(cer) AS cer, sum(chars) AS num_chars_ref FROM k GROUP BY key)"""


def _summary(spark, d):
    rows = pairs.scored(_keyed(spark, d), words=False).groupBy("dataset").agg(F.avg("cer").alias("cer"), F.sum("chars").alias("num_chars_ref"))
    return rows.withColumn("family", pairs.family(F.col("dataset")))


@query(f"WITH {_SUMMARY} SELECT family, count(*) AS datasets, avg(cer) AS cer FROM m GROUP BY family")
def agg07_macro_average(spark, d):
    return pairs.macro_average(_summary(spark, d), "family")


@query(f"WITH {_SUMMARY} SELECT family, sum(cer * num_chars_ref) / sum(num_chars_ref) AS cer, CAST(sum(num_chars_ref) AS BIGINT) AS num_chars_ref FROM m GROUP BY family")
def agg08_micro_average(spark, d):
    return pairs.micro_average(_summary(spark, d), ["family"])


@query(f"WITH {_SUMMARY} SELECT arg_max(dataset, cer) AS highest, arg_min(dataset, cer) AS lowest FROM m")
def agg34_highest_lowest(spark, d):
    return _summary(spark, d).agg(F.max_by("dataset", "cer").alias("highest"), F.min_by("dataset", "cer").alias("lowest"))


_WORDS = "len(list_filter(string_split({0}, ' '), lambda x: x <> ''))"


@query(f"""WITH {C}, k AS (SELECT CASE WHEN ct = ot THEN 'NO_CHANGE' WHEN ct = gt THEN 'PERFECT' WHEN cer_llm < cer_ocr - 1e-6 AND {_WORDS.format('ct')} < {_WORDS.format('ot')} * 0.65::DOUBLE THEN 'REPETITION_REMOVED' WHEN cer_llm < cer_ocr - 1e-6 THEN 'PARTIAL_FIX'
WHEN cer_ocr < 0.05::DOUBLE THEN 'FALSE_POSITIVE' WHEN length(ct) > length(ot) * 1.4::DOUBLE THEN 'HALLUCINATION' WHEN length(ct) < length(ot) * 0.6::DOUBLE THEN 'TRUNCATION' ELSE 'WORD_SUBSTITUTION' END AS category FROM q),
f AS (SELECT unnest(range(0, 9)) AS ord, unnest({classify.CATEGORIES!r}) AS category)
SELECT CAST(ord AS INTEGER) AS ord, category, count(k.category) AS n FROM f LEFT JOIN k USING (category) GROUP BY ord, category""")
def agg19_categories(spark, d):
    return outcomes.category_counts(outcomes.compared(samples(spark, d)))


@query(f"WITH {C} SELECT dataset, count(*) AS n, count(*) FILTER (WHERE outcome = 'improved') AS improved, count(*) FILTER (WHERE outcome = 'regressed') AS regressed, count(*) FILTER (WHERE outcome = 'unchanged') AS unchanged, avg(cer_ocr) AS cer_ocr, avg(cer_llm) AS cer_llm FROM q GROUP BY dataset")
def agg20_outcomes(spark, d):
    return outcomes.outcome_summary(outcomes.compared(samples(spark, d)), ["dataset"])


@query(f"""WITH {C}, w AS (SELECT sample_id, outcome, cer_delta FROM q WHERE outcome = 'regressed' ORDER BY cer_delta DESC, sample_id LIMIT 40), b AS (SELECT sample_id, outcome, cer_delta FROM q WHERE outcome = 'improved' ORDER BY cer_delta, sample_id LIMIT 20) SELECT * FROM w UNION ALL SELECT * FROM b""")
def top02_extremes(spark, d):
    return outcomes.extremes(outcomes.compared(samples(spark, d)).select("sample_id", "outcome", "cer_delta"))


_BUCKET = "CASE WHEN cer_llm = 0 THEN 'perfect' WHEN cer_llm - cer_ocr > 0.005::DOUBLE THEN 'degraded' WHEN abs(cer_llm - cer_ocr) <= 0.005::DOUBLE THEN 'unchanged' ELSE 'improved' END"


@query(f"""WITH {C}, k AS (SELECT dataset, {_BUCKET} AS b FROM q) SELECT dataset, count(*) AS n, count(*) FILTER (WHERE b = 'perfect') AS perfect, count(*) FILTER (WHERE b = 'degraded') AS degraded, count(*) FILTER (WHERE b = 'unchanged') AS unchanged, count(*) FILTER (WHERE b = 'improved') AS improved FROM k GROUP BY ROLLUP (dataset)""")
def agg22_training_buckets(spark, d):
    return outcomes.training_buckets(outcomes.compared(samples(spark, d)))


@query(f"""WITH {C} SELECT CASE WHEN abs(cer_delta) <= 1e-6::DOUBLE THEN 'same' WHEN cer_delta <= -0.1::DOUBLE THEN 'large gain' WHEN cer_delta < 0 THEN 'gain' WHEN cer_delta < 0.1::DOUBLE THEN 'loss' ELSE 'large loss' END AS severity, count(*) AS n FROM q GROUP BY 1""")
def agg30_severity(spark, d):
    return outcomes.severity(outcomes.compared(samples(spark, d)))


@query(f"""WITH {C}, mv AS (SELECT dataset, cer_ocr, cer_llm, -cer_delta AS gain FROM q), m AS (SELECT dataset, count(*) AS n, avg(cer_ocr) AS ocr_cer, avg(cer_llm) AS cer, count(*) FILTER (WHERE gain > 1e-6::DOUBLE) AS improved, count(*) FILTER (WHERE gain < -1e-6::DOUBLE) AS regressed, count(*) FILTER (WHERE abs(gain) <= 1e-6::DOUBLE) AS unchanged,
count(*) FILTER (WHERE gain >= 0.1::DOUBLE) AS large_improve, count(*) FILTER (WHERE gain > 1e-6::DOUBLE AND gain < 0.1::DOUBLE) AS small_improve, count(*) FILTER (WHERE gain < -1e-6::DOUBLE AND gain > -0.1::DOUBLE) AS small_regress, count(*) FILTER (WHERE gain <= -0.1::DOUBLE) AS large_regress FROM mv GROUP BY dataset)
SELECT *, ocr_cer - cer AS cer_delta, CASE WHEN ocr_cer > 0 THEN (ocr_cer - cer) / ocr_cer * 100 ELSE 0 END AS relative_pct, improved / n * 100 AS improvement_rate, regressed / n * 100 AS regression_rate FROM m""")
def agg30_prompt_evaluation(spark, d):
    return outcomes.prompt_evaluation(outcomes.compared(samples(spark, d)), ["dataset"])


@query()
def agg20_rate_outcomes(spark, d):
    return outcomes.rate_summary(samples(spark, d), ["dataset"])


@query(f"""WITH {C}, r AS (SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY cer_delta, sample_id) AS lo, row_number() OVER (PARTITION BY dataset ORDER BY -cer_delta, sample_id) AS hi FROM q)
SELECT dataset, count(*) FILTER (WHERE cer_delta < -0.01::DOUBLE) AS improved, count(*) FILTER (WHERE abs(cer_delta) <= 0.01::DOUBLE) AS unchanged, count(*) FILTER (WHERE cer_delta > 0.01::DOUBLE) AS worsened, max(sample_id) FILTER (WHERE lo = 1) AS best, max(sample_id) FILTER (WHERE hi = 1) AS worst, avg(cer_delta) AS mean_delta FROM r GROUP BY dataset""")
def agg35_impact(spark, d):
    return outcomes.impact(outcomes.compared(samples(spark, d)), ["dataset"])


@query(f"WITH {D} SELECT sample_id, length_ratio FROM d WHERE length_ratio > 5")
def flt02_runaways(spark, d):
    return pairs.scored(samples(spark, d), words=False).where("is_runaway").select("sample_id", "length_ratio")


@query(f"WITH {D} SELECT dataset, CASE WHEN cer = 0 THEN 'correct' WHEN cer <= 0.05::DOUBLE THEN 'easy' WHEN cer <= 0.25::DOUBLE THEN 'medium' ELSE 'hard' END AS difficulty, count(*) AS n FROM d GROUP BY 1, 2")
def cls07_difficulty(spark, d):
    return pairs.scored(samples(spark, d), words=False).groupBy("dataset", classify.difficulty(F.col("cer")).alias("difficulty")).agg(F.count("*").alias("n"))


@query(f"""WITH {C} SELECT CASE WHEN length_ratio > 5 THEN 'runaway' WHEN cer_ocr = 0 AND cer_llm = 0 THEN 'correct_ocr' WHEN cer_ocr < 0.02::DOUBLE AND cer_delta > 0.005::DOUBLE THEN 'false_positive' WHEN cer_ocr >= 0.02::DOUBLE AND cer_delta > 0.01::DOUBLE THEN 'degraded_real'
WHEN abs(cer_delta) <= 0.005::DOUBLE AND cer_ocr > 0.05::DOUBLE THEN 'unfixed_hard' WHEN cer_llm = 0 AND cer_ocr > 0 THEN 'perfect' WHEN cer_delta < -0.005::DOUBLE THEN 'improved' END AS bucket, count(*) AS n FROM q GROUP BY 1""")
def cls08_dev_buckets(spark, d):
    rows = outcomes.compared(samples(spark, d))
    return rows.groupBy(classify.dev_bucket(F.col("length_ratio"), F.col("cer_ocr"), F.col("cer_llm")).alias("bucket")).agg(F.count("*").alias("n"))


# ---- functions


@query(f"WITH {SAMPLES} SELECT sample_id, {runs_sql('ocr_text')} AS limited FROM s")
def fn01_limit_runs(spark, d):
    return samples(spark, d).select("sample_id", text.limit_runs(F.col("ocr_text")).alias("limited"))


@query(f"WITH {N} SELECT sample_id, ref FROM n")
def fn02_normalise(spark, d):
    return samples(spark, d).select("sample_id", text.normalise(F.col("gt_text")).alias("ref"))


@query(f"WITH {SAMPLES} SELECT sample_id, CAST({_TOKENS.format('gt_text')} AS INTEGER) AS tokens, CAST({_WORDS.format('gt_text')} AS INTEGER) AS words, CAST(greatest(1, length(gt_text) // 4) AS BIGINT) AS estimate, CASE WHEN length(gt_text) > 220 THEN substr(gt_text, 1, 220) || ' [...]' ELSE gt_text END AS shown FROM s")
def fn04_counts(spark, d):
    c = F.col("gt_text")
    return samples(spark, d).select("sample_id", F.size(text.tokens(c)).alias("tokens"), text.word_count(c).alias("words"), text.token_estimate(c).alias("estimate"), text.truncate(c).alias("shown"))


@query("SELECT doc_id, regexp_matches(text, '[\\x{0600}-\\x{06FF}]') AS arabic, len(regexp_extract_all(text, '[\\x{0600}-\\x{06FF}]')) AS n FROM documents")
def fn05_arabic(spark, d):
    return table(spark, d, "documents").select("doc_id", text.is_arabic(F.col("text")).alias("arabic"), text.count_arabic(F.col("text")).cast("long").alias("n"))


@query(f"WITH {SAMPLES}, m AS (SELECT gram, count(*) AS n FROM (SELECT unnest(list_transform(range(1, length(gt_text) - 1), lambda i: substr(gt_text, i, 3))) AS gram FROM s) GROUP BY gram) SELECT * FROM m")
def aln07_ngrams(spark, d):
    return samples(spark, d).select(F.explode_outer(text.char_ngrams(F.col("gt_text"), 3)).alias("gram")).where("gram IS NOT NULL").groupBy("gram").agg(F.count("*").alias("n"))


@query()
def fn12_word_error_rate(spark, d):
    return pairs.scored(samples(spark, d)).select("sample_id", "wer")


# ---- alignment


@query()
def aln01_char_errors(spark, d):
    return errors.char_error_rows(samples(spark, d))


@query()
def aln02_word_errors(spark, d):
    return errors.word_error_rows(samples(spark, d))


@query()
def agg09_confusions(spark, d):
    return errors.confusion_matrix(errors.char_error_tallies(samples(spark, d), ["dataset"]), ["dataset"], arabic_only=False)


@query()
def agg10_pooled_confusions(spark, d):
    return errors.pooled(errors.confusion_matrix(errors.char_error_tallies(samples(spark, d), ["dataset"]), ["dataset"], 1, False))


@query()
def agg11_taxonomy(spark, d):
    return errors.taxonomy(errors.char_error_tallies(samples(spark, d), ["dataset"]), ["dataset"])


@query()
def agg12_examples(spark, d):
    return errors.first_examples(errors.char_error_rows(samples(spark, d), first=5), ["dataset"])


@query()
def agg13_error_changes(spark, d):
    return outcomes.error_changes(samples(spark, d), ["dataset"])


@query()
def agg13_error_changes_cumulative(spark, d):
    return outcomes.error_changes(samples(spark, d), ["dataset"], cumulative=True)


@query()
def cls09_insights(spark, d):
    return outcomes.insights(outcomes.error_changes(samples(spark, d), ["dataset"]), ["dataset"])


@query()
def agg21_word_pairs(spark, d):
    return errors.top_pairs(errors.word_pairs(errors.word_error_rows(samples(spark, d)), arabic_only=False))


@query()
def jon09_unfixed_introduced(spark, d):
    rows = samples(spark, d)
    return errors.unfixed_and_introduced(errors.word_error_tallies(rows), errors.word_error_tallies(rows, "corrected_text")).groupBy("dataset", "kind").agg(F.sum("count").alias("n"))


@query()
def top01_top_confusions(spark, d):
    return errors.top_confusions(errors.pooled(errors.confusion_matrix(errors.char_error_tallies(samples(spark, d), ["dataset"]), ["dataset"], 1, False)))


# ---- joins, sets, windows


@query("SELECT coalesce(d.doc_id, l.doc_id) AS stem, CASE WHEN d.doc_id IS NULL THEN 'gt_only' WHEN l.doc_id IS NULL THEN 'ocr_only' ELSE 'both' END AS side FROM documents d FULL JOIN labels l USING (doc_id)")
def jon01_by_stem(spark, d):
    return relational.by_stem(table(spark, d, "documents").select(F.col("doc_id").alias("stem")), table(spark, d, "labels").select(F.col("doc_id").alias("stem"))).select("stem", "side")


@query("SELECT 'f_' || doc_id AS file_id, item_id AS line_no, benchmark.text AS line FROM documents JOIN benchmark ON item_id = doc_id")
def jon02_by_line_number(spark, d):
    files = table(spark, d, "documents").select(F.concat(F.lit("f_"), F.col("doc_id").cast("string")).alias("file_id"))
    return relational.by_line_number(files, table(spark, d, "benchmark").select(F.col("item_id").cast("long").alias("line_no"), F.col("text").alias("line"))).select("file_id", "line_no", "line")


@query("SELECT doc_id, source FROM documents SEMI JOIN (SELECT doc_id FROM labels WHERE quality = 1) USING (doc_id)")
def jon03_in_split(spark, d):
    return table(spark, d, "documents").join(table(spark, d, "labels").where("quality = 1").select("doc_id"), "doc_id", "left_semi").select("doc_id", "source")


@query("SELECT c_custkey FROM customer ANTI JOIN (SELECT o_custkey AS c_custkey FROM orders WHERE o_orderstatus = 'F') USING (c_custkey)")
def jon04_pending(spark, d):
    done = table(spark, d, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey"))
    return relational.pending(table(spark, d, "customer").select("c_custkey"), done, ["c_custkey"])


@query("""SELECT d.doc_id, coalesce(l.quality, n.q) AS baseline, CASE WHEN l.quality IS NOT NULL THEN 'preferred' WHEN n.q IS NOT NULL THEN 'alternate' END AS baseline_source
FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id LEFT JOIN (SELECT item_id, CAST(length(text) AS INTEGER) AS q FROM benchmark) n ON n.item_id = d.doc_id""")
def jon05_baseline(spark, d):
    alternate = table(spark, d, "benchmark").select(F.col("item_id").alias("doc_id"), F.length("text").alias("quality"))
    return relational.with_baseline(table(spark, d, "documents").select("doc_id"), table(spark, d, "labels").select("doc_id", "quality"), alternate, "doc_id", "quality")


@query("SELECT text, max(doc_id) AS line_no FROM documents GROUP BY text")
def jon10_last_line(spark, d):
    return relational.last_line_of_text(table(spark, d, "documents").select("text", F.col("doc_id").alias("line_no")))


@query("SELECT l_partkey FROM lineitem GROUP BY l_partkey HAVING count(DISTINCT l_returnflag) = (SELECT count(DISTINCT l_returnflag) FROM lineitem)")
def jon11_common(spark, d):
    return relational.common_to_all(table(spark, d, "lineitem"), "l_partkey", "l_returnflag")


@query("SELECT o_orderkey, o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R') AS in_both FROM orders")
def jon12_overlap(spark, d):
    return relational.overlap(table(spark, d, "orders").select("o_orderkey"), table(spark, d, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey")), "o_orderkey")


@query("""SELECT coalesce(r.doc_id, l.doc_id) AS doc_id, coalesce(r.v, l.v) AS v, CASE WHEN r.doc_id IS NOT NULL THEN 'remote' ELSE 'local' END AS origin FROM (SELECT doc_id, n_chars AS v FROM documents) l FULL JOIN (SELECT doc_id, CAST(quality AS BIGINT) AS v FROM labels) r ON r.doc_id = l.doc_id""")
def jon13_merged(spark, d):
    return relational.merged_records(table(spark, d, "documents").select("doc_id", F.col("n_chars").alias("v")), table(spark, d, "labels").select("doc_id", F.col("quality").cast("long").alias("v")), "doc_id")


@query("""SELECT n.n_name AS stem, s.image_stem FROM nation n LEFT JOIN (SELECT lower(n_name) || CASE WHEN n_regionkey = 0 THEN '_a' WHEN n_regionkey = 1 THEN '' ELSE '_x' END AS image_stem FROM nation) s ON s.image_stem IN (lower(n.n_name), lower(n.n_name) || '_a', lower(n.n_name) || '_b')""")
def jon18_variants(spark, d):
    n = table(spark, d, "nation")
    tail = F.when(F.col("n_regionkey") == 0, "_a").when(F.col("n_regionkey") == 1, "").otherwise("_x")
    return relational.with_variants(n.select(F.col("n_name").alias("stem")), n.select(F.concat(F.lower("n_name"), tail).alias("image_stem")))


@query("SELECT count(*) AS shared, count(*) = 0 AS disjoint FROM (SELECT doc_id FROM documents INTERSECT SELECT item_id FROM benchmark)")
def jon19_disjoint(spark, d):
    return relational.disjoint(table(spark, d, "documents"), table(spark, d, "benchmark").select(F.col("item_id").cast("long").alias("doc_id")), "doc_id")


@query("SELECT DISTINCT regexp_replace(source || '-val', '-(val|validation|test)$', '-train') AS key FROM documents")
def jon20_train_key(spark, d):
    return table(spark, d, "documents").select(relational.train_key(F.concat("source", F.lit("-val"))).alias("key")).distinct()


@query("SELECT doc_id, 'both' AS kind FROM (SELECT doc_id FROM documents INTERSECT SELECT doc_id FROM labels) UNION ALL SELECT doc_id, 'only' FROM (SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels)")
def set01_intersect_difference(spark, d):
    a, b = table(spark, d, "documents").select("doc_id"), table(spark, d, "labels").select("doc_id")
    return a.intersect(b).withColumn("kind", F.lit("both")).unionByName(a.subtract(b).withColumn("kind", F.lit("only")))


@query("SELECT o_custkey AS k FROM orders UNION SELECT c_custkey FROM customer")
def set02_union(spark, d):
    return table(spark, d, "orders").select(F.col("o_custkey").alias("k")).union(table(spark, d, "customer").select("c_custkey")).distinct()


@query("""SELECT a.l AS a, b.l AS b, CASE WHEN len(list_distinct(a.s || b.s)) = 0 THEN 0 ELSE len(list_intersect(a.s, b.s)) / len(list_distinct(a.s || b.s)) END AS jaccard FROM (SELECT source AS l, list(DISTINCT lang) AS s FROM documents GROUP BY source) a JOIN (SELECT source AS l, list(DISTINCT lang) AS s FROM documents GROUP BY source) b ON b.l > a.l""")
def set05_jaccard(spark, d):
    s = table(spark, d, "documents").groupBy("source").agg(F.collect_set("lang").alias("s"))
    return s.toDF("a", "x").join(s.toDF("b", "y"), F.col("b") > F.col("a")).select("a", "b", retrieval.jaccard(F.col("x"), F.col("y")).alias("jaccard"))


@query("SELECT event_id, sum(value) OVER (PARTITION BY event_type, user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS running FROM events")
def win01_running(spark, d):
    return relational.running_counts(table(spark, d, "events"), ["event_type", "user_id"], ["ts", "event_id"], "value").select("event_id", "running")


@query("SELECT sample, source, k FROM (SELECT doc_id AS sample, source, CAST(row_number() OVER (PARTITION BY source ORDER BY doc_id) AS INTEGER) AS k FROM documents) WHERE k <= 10")
def win02_dataset_limit(spark, d):
    return relational.first_per_group(table(spark, d, "documents").select(F.col("doc_id").alias("sample"), "source"), ["source"], ["sample"], 10)


@query("SELECT user_id, max_by(event_type, event_id) AS event_type FROM events GROUP BY user_id")
def win07_last_per_key(spark, d):
    return relational.last_per_key(table(spark, d, "events"), ["user_id"], "event_id", "event_type")


# ---- sampling and splits

_DRAW = "md5('42:' || doc_id)"


@query(f"""WITH r AS (SELECT doc_id, lang, source, {_DRAW} AS draw, row_number() OVER (PARTITION BY lang, source ORDER BY {_DRAW}, doc_id) > 1 AS later FROM documents),
k AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY later, draw, doc_id) AS k FROM r) SELECT doc_id, lang, source FROM k WHERE k <= CASE lang WHEN 'en' THEN 100 WHEN 'fr' THEN 25 WHEN 'de' THEN 25 ELSE 0 END""")
def smp01_stratified(spark, d):
    return sampling.stratified(table(spark, d, "documents").select("doc_id", "lang", "source"), "lang", {"en": 100, "fr": 25, "de": 25}, "doc_id", "source")


@query(f"""WITH m AS (SELECT d.doc_id, d.source, CASE WHEN l.doc_id IS NOT NULL THEN 1 ELSE 0 END AS p FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels WHERE toxic = 1) l USING (doc_id)),
k AS (SELECT *, count(*) OVER (PARTITION BY source) AS n, row_number() OVER (PARTITION BY source ORDER BY p DESC, {_DRAW}, doc_id) AS k FROM m) SELECT doc_id, source, CASE WHEN p = 1 OR k <= floor(n * 0.15::DOUBLE) THEN 'val' ELSE 'train' END AS split FROM k""")
def smp06_split(spark, d):
    return sampling.split_by_ratio(table(spark, d, "documents").select("doc_id", "source"), "doc_id", ["source"], 0.15, table(spark, d, "labels").where("toxic = 1").select("doc_id"))


@query("SELECT o_orderkey, o_custkey, CASE WHEN o_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P') THEN 'val' ELSE 'train' END AS split FROM orders")
def smp07_overlap_split(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    return sampling.split_by_overlap(o.drop("o_orderstatus"), o.where("o_orderstatus = 'P'"), "o_custkey").select("o_orderkey", "o_custkey", "split")


@query(f"SELECT doc_id, lang FROM documents WHERE NOT regexp_matches(text, '[0-9]{{5,}}') ORDER BY {_DRAW}, doc_id LIMIT 200")
def smp09_drawn(spark, d):
    return sampling.drawn(table(spark, d, "documents").where("NOT text RLIKE '[0-9]{5,}'").select("doc_id", "lang"), "doc_id", 200)


def _mix_sql(targets):
    most = " ".join(f"WHEN '{k}' THEN {n}" for k, n in targets.items())
    return f"""WITH {D}, p AS (SELECT sample_id, font, md5('42:' || sample_id) AS draw, CASE WHEN cer = 0 THEN 'correct' WHEN cer <= 0.05::DOUBLE THEN 'easy' WHEN cer <= 0.25::DOUBLE THEN 'medium' ELSE 'hard' END AS difficulty FROM d WHERE chars >= 5 AND length_ratio <= 5),
r AS (SELECT *, row_number() OVER (PARTITION BY difficulty, font ORDER BY draw, sample_id) > 1 AS later FROM p), k AS (SELECT *, row_number() OVER (PARTITION BY difficulty ORDER BY later, draw, sample_id) AS k FROM r)
SELECT sample_id, font, difficulty FROM k WHERE k <= CASE difficulty {most} END"""


@query(_mix_sql(sampling.targets_of(150)))
def smp01_difficulty(spark, d):
    return sampling.by_difficulty(pairs.scored(samples(spark, d), words=False), 150).select("sample_id", "font", "difficulty")


@query(_mix_sql(sampling.MIX))
def smp05_prompt_mix(spark, d):
    return sampling.prompt_mix(pairs.scored(samples(spark, d), words=False)).select("sample_id", "font", "difficulty")


@query(f"""WITH m AS (SELECT d.doc_id, d.source, l.doc_id IS NOT NULL AS p, n_chars < 200 AS blank FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels WHERE toxic = 1) l USING (doc_id)),
k AS (SELECT *, greatest(1, round_even(count(*) OVER (PARTITION BY source) * 0.15::DOUBLE, 0)) - count(*) FILTER (WHERE p) OVER (PARTITION BY source) AS wanted, row_number() OVER (PARTITION BY source, p ORDER BY {_DRAW}, doc_id) AS k FROM m)
SELECT doc_id, source, CASE WHEN p OR (k <= wanted AND NOT blank) THEN 'val' ELSE 'train' END AS split FROM k""")
def smp06_validation(spark, d):
    rows = table(spark, d, "documents").select("doc_id", "source", (F.col("n_chars") < 200).alias("blank"))
    return sampling.validation_split(rows, "doc_id", ["source"], 0.15, table(spark, d, "labels").where("toxic = 1").select("doc_id"), "blank").drop("blank")


@query("""WITH r AS (SELECT doc_id, lang, doc_id // 7 AS slot, n_chars < 100 AS blank FROM documents), c AS (SELECT slot, bool_or(blank) AS blank FROM r GROUP BY slot HAVING count(DISTINCT lang) = (SELECT count(DISTINCT lang) FROM r)),
m AS (SELECT slot, blank, slot IN (SELECT DISTINCT doc_id FROM labels WHERE toxic = 1) AS p FROM c), k AS (SELECT *, greatest(1, round_even(count(*) OVER () * 0.15::DOUBLE, 0)) - count(*) FILTER (WHERE p) OVER () AS wanted, row_number() OVER (PARTITION BY p ORDER BY md5('42:' || slot), slot) AS k FROM m)
SELECT doc_id, lang, slot, CASE WHEN p OR (k <= wanted AND NOT k.blank) THEN 'val' ELSE 'train' END AS split FROM r JOIN k USING (slot)""")
def smp06_aligned(spark, d):
    rows = table(spark, d, "documents").select("doc_id", "lang", F.expr("doc_id div 7").alias("slot"), (F.col("n_chars") < 100).alias("blank"))
    pinned = table(spark, d, "labels").where("toxic = 1").select(F.col("doc_id").alias("slot"))
    return sampling.aligned_split(rows, "slot", "lang", 0.15, pinned, "blank").select("doc_id", "lang", "slot", "split")


@query("""WITH p AS (SELECT doc_id, len(string_split(text, chr(10))) AS pages, right(text, 2) AS t FROM documents), k AS (SELECT doc_id, row_number() OVER (ORDER BY md5('42:' || doc_id), doc_id) AS k FROM p WHERE doc_id % 2 = 1 AND pages = 1 AND NOT regexp_matches(t, '[a-zA-Z]{2,}'))
SELECT doc_id, 'training' AS split FROM p WHERE doc_id % 2 = 0 AND pages = 1 UNION ALL SELECT doc_id, 'testing' FROM k WHERE k <= 50""")
def smp09_single_page(spark, d):
    """Lines are the pages; the script is told by the last two characters, as the texts are all in Latin letters."""
    docs = table(spark, d, "documents").select("doc_id", F.split("text", "\n").alias("pages"), F.right("text", F.lit(2)).alias("end"))
    return sampling.single_page_split(docs.where("doc_id % 2 = 0"), docs.where("doc_id % 2 = 1"), "doc_id", "pages", "end", 50)


# ---- runs and statistics


def runs(spark, d):
    """Four runs over the samples: OCR, correction, their mean, and the better of both."""
    rows = outcomes.compared(samples(spark, d)).select("sample_id", "ord", "dataset", "cer_ocr", "cer_llm")
    four = F.array(*[F.struct(F.lit(k).alias("run"), v.alias("cer")) for k, v in (("base", F.col("cer_ocr")), ("llm", F.col("cer_llm")), ("mean", (F.col("cer_ocr") + F.col("cer_llm")) / 2), ("best", F.least("cer_ocr", "cer_llm")))])
    return rows.select("sample_id", "ord", "dataset", F.explode(four).alias("r")).select("sample_id", "ord", "dataset", "r.run", "r.cer")


R = f"""{C}, r AS (SELECT sample_id, dataset, 'base' AS run, cer_ocr AS cer FROM c UNION ALL SELECT sample_id, dataset, 'llm', cer_llm FROM c UNION ALL SELECT sample_id, dataset, 'mean', (cer_ocr + cer_llm) / 2 FROM c UNION ALL SELECT sample_id, dataset, 'best', least(cer_ocr, cer_llm) FROM c),
a AS (SELECT run, avg(cer) AS cer, count(*) AS datasets FROM (SELECT run, dataset, avg(cer) AS cer FROM r GROUP BY ALL) GROUP BY run)"""


@query(f"""WITH {R}, p AS (SELECT x.run, b.cer - x.cer AS d FROM r x JOIN r b USING (sample_id) WHERE b.run = 'base' AND x.run <> 'base'),
m AS (SELECT run, count(*) AS n, avg(d) AS mean_diff, coalesce(stddev_samp(d), 0) AS std_diff FROM p GROUP BY run), t AS (SELECT *, CASE WHEN n < 2 OR std_diff = 0 THEN 0 ELSE mean_diff / (std_diff / sqrt(n)) END AS t_stat, CASE WHEN n < 2 OR std_diff = 0 THEN 0 ELSE mean_diff / std_diff END AS cohens_d, count(*) OVER () AS k FROM m),
z AS (SELECT *, 1 / (1 + abs(t_stat) * 0.2316419::DOUBLE) AS u FROM t),
v AS (SELECT *, CASE WHEN t_stat = 0 THEN 1.0 ELSE 2 * (exp(-0.5 * t_stat * t_stat) * (u * (0.319381530::DOUBLE + u * (-0.356563782::DOUBLE + u * (1.781477937::DOUBLE + u * (-1.821255978::DOUBLE + u * 1.330274429::DOUBLE))))) / sqrt(2 * pi())) END AS p_value FROM z)
SELECT run, n, mean_diff, std_diff, t_stat, cohens_d, p_value, p_value * k AS p_corrected, p_value < 0.05::DOUBLE / k AS significant FROM v""")
def sta05_compare_all(spark, d):
    return stats.compare_all(runs(spark, d), "base")


@query()
def sta04_bootstrap(spark, d):
    return stats.bootstrap_interval(runs(spark, d), "base")


@query()
def sta04_exact_bootstrap(spark, d):
    return stats.exact_bootstrap(runs(spark, d), "base")


@query(f"WITH {R} SELECT * FROM a")
def agg27_run_averages(spark, d):
    return outcomes.run_averages(runs(spark, d))


@query(f"""WITH {R}, f AS (SELECT cer AS full_cer FROM a WHERE run = 'best') SELECT run, cer, cer - full_cer AS delta, CASE WHEN cer - full_cer > 0.001::DOUBLE THEN 'component helps' WHEN cer - full_cer < -0.001::DOUBLE THEN 'component hurts' ELSE 'neutral' END AS verdict FROM a, f WHERE run <> 'best'""")
def agg31_ablation(spark, d):
    return outcomes.ablation(outcomes.run_averages(runs(spark, d)), "best")


@query(f"""WITH {R}, w AS (SELECT max(cer) FILTER (WHERE run = 'base') AS b, max(cer) FILTER (WHERE run = 'best') AS c, max(cer) FILTER (WHERE run = 'llm') AS p, max(cer) FILTER (WHERE run = 'mean') AS q FROM a),
h AS (SELECT b - c AS combined_gain, (b - p) + (b - q) AS parts_gain FROM w) SELECT *, combined_gain - parts_gain AS synergy, CASE WHEN combined_gain - parts_gain > 0.001::DOUBLE THEN 'synergistic' WHEN combined_gain - parts_gain < -0.001::DOUBLE THEN 'antagonistic' ELSE 'additive' END AS verdict FROM h""")
def agg32_synergy(spark, d):
    return outcomes.synergy(outcomes.run_averages(runs(spark, d)), "base", ["llm", "mean"], "best")


@query(f"WITH {R} SELECT run, cer FROM a ORDER BY cer, run LIMIT 1")
def agg33_best_run(spark, d):
    return outcomes.best_run(outcomes.run_averages(runs(spark, d)))


@query("SELECT DISTINCT sample_id, run, v AS cer FROM (SELECT user_id AS sample_id, event_type AS run, max_by(value, event_id) AS v FROM events GROUP BY ALL) WHERE sample_id IN (SELECT user_id FROM events GROUP BY user_id HAVING count(DISTINCT event_type) = (SELECT count(DISTINCT event_type) FROM events))")
def jon06_in_every_run(spark, d):
    e = table(spark, d, "events").select(F.col("user_id").alias("sample_id"), F.col("event_type").alias("run"), F.col("value").alias("cer"), F.col("event_id").alias("ord"))
    return outcomes.in_every_run(e).select("sample_id", "run", "cer")


# ---- validation


@query(f"""WITH {SAMPLES}, t AS (SELECT dataset, list_filter(regexp_split_to_array(gt_text, '[\\s!-/:-@\\[-`{{-~]+'), lambda x: regexp_matches(x, '[A-Za-z]')) AS g, list_filter(regexp_split_to_array(ocr_text, '[\\s!-/:-@\\[-`{{-~]+'), lambda x: regexp_matches(x, '[A-Za-z]')) AS o FROM s),
z AS (SELECT dataset, unnest(g[1 : least(len(g), len(o))]) AS gt, unnest(o[1 : least(len(g), len(o))]) AS ocr FROM t), x AS (SELECT DISTINCT unnest(regexp_split_to_array(text, '[^A-Za-z]+')) AS word FROM benchmark)
SELECT dataset, count(*) AS tokens, count(*) FILTER (WHERE gt IN (SELECT word FROM x)) AS gt_valid, count(*) FILTER (WHERE ocr IN (SELECT word FROM x)) AS ocr_valid, count(*) FILTER (WHERE ocr IN (SELECT word FROM x) AND gt <> ocr) AS valid_but_wrong,
count(*) FILTER (WHERE ocr NOT IN (SELECT word FROM x) AND gt IN (SELECT word FROM x)) AS non_word, count(*) FILTER (WHERE ocr NOT IN (SELECT word FROM x) AND gt NOT IN (SELECT word FROM x)) AS both_invalid FROM z GROUP BY dataset""")
def agg16_validity(spark, d):
    return validation.token_validity(samples(spark, d), _lexicon(spark, d), ["dataset"], ASCII_LETTERS)


def _lexicon(spark, d):
    return table(spark, d, "benchmark").select(F.explode(F.split("text", "[^A-Za-z]+")).alias("word")).distinct()


# The forms and pairs of categories of a small morphology over the words of the benchmark.
_PREFIXES = [("", "none"), ("a", "vowel"), ("re", "again"), ("de", "again"), ("T", "capital")]
_SUFFIXES = [("", "none"), ("s", "many"), ("n", "many"), ("ra", "long"), ("o", "long")]
_PREFIX_STEM = [("none", "even"), ("none", "odd"), ("vowel", "even"), ("again", "odd"), ("capital", "odd")]
_STEM_SUFFIX = [("even", "none"), ("odd", "none"), ("even", "many"), ("odd", "long")]
_PREFIX_SUFFIX = [("none", "none"), ("none", "many"), ("none", "long"), ("vowel", "none"), ("vowel", "many"), ("again", "none"), ("capital", "long")]


def _morphology(spark, d):
    stems = _lexicon(spark, d).where(F.length("word") >= 3).select(F.col("word").alias("form"), F.when(F.length("word") % 2 == 0, "even").otherwise("odd").alias("category"))
    forms, pairs_ = (lambda x: spark.createDataFrame(x, "form string, category string")), (lambda x: spark.createDataFrame(x, "a string, b string"))
    return morphology.Morphology(forms(_PREFIXES), stems, forms(_SUFFIXES), pairs_(_PREFIX_STEM), pairs_(_STEM_SUFFIX), pairs_(_PREFIX_SUFFIX))


_rows_sql = lambda rows: ", ".join(f"({_quoted(x)}, {_quoted(y)})" for x, y in rows)
_TEXT_WORDS = "list_filter(regexp_split_to_array({0}, '[\\s!-/:-@\\[-`{{-~]+'), lambda x: regexp_matches(x, '[A-Za-z]'))"
_MORPHOLOGY = f"""p(prefix, prefix_category) AS (VALUES {_rows_sql(_PREFIXES)}), f(suffix, suffix_category) AS (VALUES {_rows_sql(_SUFFIXES)}), ps(x, y) AS (VALUES {_rows_sql(_PREFIX_STEM)}), sf(x, y) AS (VALUES {_rows_sql(_STEM_SUFFIX)}), pf(x, y) AS (VALUES {_rows_sql(_PREFIX_SUFFIX)}),
st AS (SELECT word AS stem, CASE WHEN length(word) % 2 = 0 THEN 'even' ELSE 'odd' END AS stem_category FROM (SELECT DISTINCT unnest(regexp_split_to_array(text, '[^A-Za-z]+')) AS word FROM benchmark) WHERE length(word) >= 3),
dw AS (SELECT DISTINCT unnest({_TEXT_WORDS.format('gt_text')}) AS word FROM s UNION SELECT DISTINCT unnest({_TEXT_WORDS.format('ocr_text')}) FROM s),
an AS (SELECT word, prefix, stem, suffix, prefix_category, stem_category, suffix_category FROM dw, p, f, st WHERE word = prefix || stem || suffix AND (prefix_category, stem_category) IN (SELECT (x, y) FROM ps) AND (stem_category, suffix_category) IN (SELECT (x, y) FROM sf) AND (prefix_category, suffix_category) IN (SELECT (x, y) FROM pf))"""


@query(f"WITH {SAMPLES}, {_MORPHOLOGY} SELECT * FROM an")
def udf07_analyses(spark, d):
    rows = samples(spark, d)
    words = [F.filter(text.tokens(F.col(c)), lambda x: x.rlike(ASCII_LETTERS)) for c in ("gt_text", "ocr_text")]
    return morphology.analyses(rows.select(F.explode(F.array_distinct(F.concat(*words))).alias("word")), _morphology(spark, d))


@query(f"""WITH {SAMPLES}, {_MORPHOLOGY}, t AS (SELECT dataset, {_TEXT_WORDS.format('gt_text')} AS g, {_TEXT_WORDS.format('ocr_text')} AS o FROM s), z AS (SELECT dataset, unnest(g[1 : least(len(g), len(o))]) AS gt, unnest(o[1 : least(len(g), len(o))]) AS ocr FROM t),
x AS (SELECT DISTINCT word FROM an) SELECT dataset, count(*) AS tokens, count(*) FILTER (WHERE gt IN (SELECT word FROM x)) AS gt_valid, count(*) FILTER (WHERE ocr IN (SELECT word FROM x)) AS ocr_valid, count(*) FILTER (WHERE ocr IN (SELECT word FROM x) AND gt <> ocr) AS valid_but_wrong,
count(*) FILTER (WHERE ocr NOT IN (SELECT word FROM x) AND gt IN (SELECT word FROM x)) AS non_word, count(*) FILTER (WHERE ocr NOT IN (SELECT word FROM x) AND gt NOT IN (SELECT word FROM x)) AS both_invalid FROM z GROUP BY dataset""")
def agg16_morphology(spark, d):
    rows = samples(spark, d)
    return validation.token_validity(rows, shared.kept(morphology.known_words(rows, ["gt_text", "ocr_text"], _morphology(spark, d), ASCII_LETTERS), "known-words"), ["dataset"], ASCII_LETTERS)


@query()
def udf09_morphology(spark, d):
    rows = samples(spark, d)
    lexicon = shared.kept(morphology.known_words(rows, ["corrected_text", "ocr_text"], _morphology(spark, d), ASCII_LETTERS), "known-words")
    return validation.reverted(rows, lexicon, letters=ASCII_LETTERS)


@query(f"""WITH {SAMPLES}, x AS (SELECT DISTINCT unnest(regexp_split_to_array(text, '[^A-Za-z]+')) AS word FROM benchmark), w AS (SELECT sample_id, unnest(list_filter(regexp_split_to_array(gt_text, '[\\s!-/:-@\\[-`{{-~]+'), lambda x: regexp_matches(x, '[A-Za-z]'))) AS word FROM s),
r AS (SELECT sample_id, count(x.word) / count(*) AS rate FROM w LEFT JOIN x USING (word) GROUP BY sample_id) SELECT sample_id, coalesce(rate, 1) AS rate FROM s LEFT JOIN r USING (sample_id)""")
def agg17_text_validity(spark, d):
    return validation.text_validity(samples(spark, d), _lexicon(spark, d), "sample_id", "gt_text", ASCII_LETTERS)


@query()
def udf09_reverted(spark, d):
    return validation.reverted(samples(spark, d), _lexicon(spark, d), letters=ASCII_LETTERS)


@query()
def agg26_runaway_stats(spark, d):
    return validation.runaway_stats(validation.without_runaways(samples(spark, d).select("gt_text", "ocr_text", "corrected_text"), letters=ASCII_LETTERS))


# ---- correctors and prompts


@query(f"WITH {SAMPLES} SELECT dataset, count(*) AS n, CAST(sum(greatest(1, length(ocr_text) // 4)) AS BIGINT) AS prompt_tokens, CAST(sum(greatest(1, length(ocr_text) // 4)) AS BIGINT) AS output_tokens, CAST(0 AS DOUBLE) AS latency_s, CAST(0 AS BIGINT) AS failed FROM s GROUP BY dataset")
def udf02_identity_totals(spark, d):
    return correct.totals(correct.identity(samples(spark, d)), ["dataset"])


@query()
def udf01_corrected(spark, d):
    return correct.corrected(samples(spark, d), "mock", arabic_only=False).drop("latency_s")


_B = prompts.BASE


@query(f"""WITH {SAMPLES}, x AS (SELECT sample_id, ocr_text, CASE doc_id % 3 WHEN 0 THEN 'zero_shot' WHEN 1 THEN 'ocr_aware' ELSE 'self_reflective' END AS kind, CASE WHEN line_no % 2 = 0 THEN 'a for e' ELSE ' ' END AS ctx FROM s),
y AS (SELECT *, CASE WHEN kind <> 'zero_shot' AND trim(ctx) <> '' THEN kind ELSE 'zero_shot' END AS prompt_used FROM x)
SELECT sample_id, prompt_used, CASE prompt_used WHEN 'ocr_aware' THEN replace({_quoted(_B)}, '<examples>', '<confusion_patterns>' || chr(10) || 'Characters that this OCR system confuses:' || chr(10) || chr(10) || ctx || chr(10) || '</confusion_patterns>' || chr(10) || chr(10) || '<examples>')
WHEN 'self_reflective' THEN replace({_quoted(_B)}, '<examples>', '<self_analysis>' || chr(10) || 'What this model gets wrong:' || chr(10) || chr(10) || 'Weaknesses:' || chr(10) || ctx || chr(10) || '</self_analysis>' || chr(10) || chr(10) || '<examples>') ELSE {_quoted(_B)} END AS system, ocr_text AS user_text FROM y""")
def prm08_prompts(spark, d):
    n = F.col("doc_id") % 3
    ctx = F.when(F.col("line_no") % 2 == 0, "a for e").otherwise(" ")
    rows = samples(spark, d).withColumn("prompt_type", F.when(n == 0, "zero_shot").when(n == 1, "ocr_aware").otherwise("self_reflective")).withColumn("confusion_context", ctx).withColumn("insights_context", ctx)
    return prompts.with_prompts(rows).select("sample_id", "prompt_used", F.col("messages")[0]["content"].alias("system"), F.col("messages")[1]["content"].alias("user_text"))


@query()
def aln06_word_changes(spark, d):
    rows = samples(spark, d).withColumn("g", text.tokens(F.col("gt_text"))).withColumn("o", text.tokens(F.col("ocr_text")))
    found = rows.where("g <> o").select("sample_id", F.posexplode(blocks.word_changes("g", "o")).alias("at", "x"))
    return found.select("sample_id", "at", "x.*")


@query(f"WITH {SAMPLES} SELECT sample_id, dataset, row_number() OVER (PARTITION BY dataset ORDER BY ord) - 1 AS place, CAST(sum(length(gt_text)) OVER (PARTITION BY dataset ORDER BY ord) AS BIGINT) AS chars_upto FROM s")
def win01_positions(spark, d):
    rows = samples(spark, d).select("sample_id", "dataset", "ord", F.length("gt_text").alias("chars"), F.lit(1).alias("one"))
    summed = prefix_sums.running_totals(rows, ["dataset"], ["ord"], {"chars_upto": "chars", "n": "one"})
    return summed.select("sample_id", "dataset", (F.col("n") - 1).alias("place"), "chars_upto")


# ---- retrieval


@query("""WITH g AS (SELECT doc_id, unnest(list_transform(range(1, length(text) - 1), lambda i: substr(text, i, 3))) AS gram FROM documents), i AS (SELECT doc_id, gram, count(*) AS tf FROM g GROUP BY ALL), f AS (SELECT gram, count(*) AS df FROM i GROUP BY gram),
n AS (SELECT doc_id, greatest(length(text) - 2, 0) AS len FROM documents), t AS (SELECT count(*) AS documents, avg(len) AS mean_length FROM n), a AS (SELECT DISTINCT item_id, unnest(list_transform(range(1, length(text) - 1), lambda i: substr(text, i, 3))) AS gram FROM benchmark),
s AS (SELECT item_id, doc_id, sum(ln(1 + (documents - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * 2.5::DOUBLE / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * len / mean_length))) AS score FROM a JOIN f USING (gram) JOIN i USING (gram) JOIN n USING (doc_id), t GROUP BY ALL),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY item_id ORDER BY round(score, 6) DESC, doc_id) AS INTEGER) AS rank FROM s) SELECT item_id, doc_id, score, rank FROM r WHERE rank <= 3""")
def jon16_bm25(spark, d):
    index = shared.kept(gram_index.gram_index(table(spark, d, "documents").select("doc_id", "text")), "grams", wide=True)
    return gram_index.bm25(table(spark, d, "benchmark"), index, 3)


@query("""WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), s AS (SELECT q.vec_id AS query_id, x.vec_id, list_inner_product(q.e, x.e) / (sqrt(list_inner_product(q.e, q.e)) * sqrt(list_inner_product(x.e, x.e))) AS score FROM v q JOIN v x ON q.vec_id <> x.vec_id WHERE q.vec_id % 100 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, vec_id) AS INTEGER) AS rank FROM s) SELECT * FROM r WHERE rank <= 5""")
def rag03_dense(spark, d):
    e = table(spark, d, "embeddings")
    return retrieval.dense(e.where("vec_id % 100 = 0").withColumnRenamed("vec_id", "query_id"), e, 5)


@query("""WITH g AS (SELECT doc_id, unnest(list_transform(range(1, length(text) - 1), lambda i: substr(text, i, 3))) AS gram FROM documents), i AS (SELECT doc_id, gram, count(*) AS tf FROM g GROUP BY ALL), f AS (SELECT gram, count(*) AS df FROM i GROUP BY gram),
n AS (SELECT doc_id, greatest(length(text) - 2, 0) AS len FROM documents), t AS (SELECT count(*) AS documents, avg(len) AS mean_length FROM n), a AS (SELECT DISTINCT item_id, unnest(list_transform(range(1, length(text) - 1), lambda i: substr(text, i, 3))) AS gram FROM benchmark),
b AS (SELECT item_id AS query_id, doc_id AS vec_id, sum(ln(1 + (documents - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * 2.5::DOUBLE / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * len / mean_length))) AS l FROM a JOIN f USING (gram) JOIN i USING (gram) JOIN n USING (doc_id), t GROUP BY item_id, doc_id
  QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY round(l, 6) DESC, doc_id) <= 50),
v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
c AS (SELECT q.vec_id AS query_id, x.vec_id, list_inner_product(q.e, x.e) / (sqrt(list_inner_product(q.e, q.e)) * sqrt(list_inner_product(x.e, x.e))) AS d FROM v q JOIN v x ON q.vec_id <> x.vec_id WHERE q.vec_id IN (SELECT item_id FROM benchmark)
  QUALIFY row_number() OVER (PARTITION BY q.vec_id ORDER BY round(d, 6) DESC, x.vec_id) <= 50),
h AS (SELECT query_id, vec_id, 0.6::DOUBLE * coalesce(l / m, 0) + 0.4::DOUBLE * coalesce(d, 0) AS score FROM (SELECT query_id, vec_id, l, max(l) OVER (PARTITION BY query_id) AS m FROM b) FULL JOIN c USING (query_id, vec_id)),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, vec_id) AS INTEGER) AS rank FROM h) SELECT query_id, vec_id, score, rank FROM r WHERE rank <= 5""")
def rag03_hybrid(spark, d):
    """The texts of benchmark items and the vectors of the same number, against all documents and all vectors."""
    index = shared.kept(gram_index.gram_index(table(spark, d, "documents").select(F.col("doc_id").alias("vec_id"), "text"), key="vec_id"), "grams", wide=True)
    e = table(spark, d, "embeddings").select("vec_id", "embedding")
    asked = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text").join(e.withColumnRenamed("vec_id", "query_id"), "query_id", "left")
    return retrieval.retrieve(shared.kept(asked, "asked"), 5, "hybrid", index, e).select("query_id", "vec_id", "score", "rank")


@query()
def rag03_inverted_lists(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", "embedding")
    quantiser, asked = dense_index.train(e), e.where("vec_id % 100 = 0").withColumnRenamed("vec_id", "query_id")
    index = shared.kept(dense_index.dense_index(e, quantiser), "dense-index")
    probe, pool, _ = dense_index.tuned(asked, e, index, quantiser, 5)
    return dense_index.near(asked, index, quantiser, 5, probe, pool)


@query()
def jon17_signatures(spark, d):
    found = shared.kept(errors.char_error_tallies(samples(spark, d), ["doc_id"]).groupBy("doc_id", "ocr_char", "error_type").agg(F.sum("count").alias("count")), "signature-errors")
    sig = signatures.signatures(found, "doc_id", found.groupBy("doc_id").agg(F.sum(F.when(F.col("error_type") == "insertion", F.col("count")).otherwise(0)).alias("invalid")))
    held, sig = table(spark, d, "labels").select("doc_id"), shared.kept(sig, "signatures")
    return signatures.signature_matches(sig.join(held, "doc_id", "left_semi").withColumnRenamed("doc_id", "query_id"), sig.join(held, "doc_id", "left_anti").withColumnRenamed("doc_id", "entry_id"))


@query("""WITH g AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), x AS (SELECT doc_id, list_sort(list_distinct(regexp_extract_all(t, '[A-Z0-9]'))) AS chars, list_distinct(list_transform(regexp_extract_all(t, '[a-z]+'), lambda w: length(w))) AS types,
len(string_split(t, chr(10))) AS difficulty, len(regexp_extract_all(t, '[a-z]{9,}')) AS invalid FROM g),
p AS (SELECT q.doc_id AS query_id, e.doc_id AS entry_id, len(list_intersect(q.chars, e.chars)) AS c, len(q.chars) + len(e.chars) AS cs, len(list_intersect(q.types, e.types)) AS y, len(q.types) + len(e.types) AS ys, abs(q.difficulty - e.difficulty) AS dd, abs(q.invalid - e.invalid) AS di
FROM x q JOIN x e ON list_has_any(q.chars, e.chars) OR list_has_any(q.types, e.types) WHERE q.doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1) AND e.doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)),
s AS (SELECT query_id, entry_id, 0.4::DOUBLE * coalesce(c / nullif(cs - c, 0), 0) + 0.3::DOUBLE * coalesce(y / nullif(ys - y, 0), 0) + 0.2::DOUBLE * (1 / (1 + dd)) + 0.1::DOUBLE * (1 / (1 + di)) AS score FROM p),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, entry_id) AS INTEGER) AS rank FROM s) SELECT * FROM r WHERE rank <= 5""")
def jon17_profiles(spark, d):
    t = F.coalesce("text", F.lit(""))
    found = lambda p: F.regexp_extract_all(t, F.lit(f"({p})"))
    # each text is met once for its words: long ones and distinct lengths follow from all lengths
    rows = table(spark, d, "documents").select("doc_id", F.array_sort(F.array_distinct(found("[A-Z0-9]"))).alias("chars"), F.transform(found("[a-z]+"), F.length).alias("lengths"), F.size(F.split(t, "\n")).alias("difficulty"))
    types = F.transform(F.array_distinct("lengths"), lambda n: n.cast("string"))
    sig = rows.select("doc_id", "chars", F.array_sort(types).alias("types"), "difficulty", F.size(F.filter("lengths", lambda n: n >= 9)).alias("invalid"))
    sig, toxic = shared.kept(sig, "profiles"), table(spark, d, "labels").where("toxic = 1").select("doc_id")
    return signatures.signature_matches(sig.join(toxic, "doc_id", "left_semi").withColumnRenamed("doc_id", "query_id"), sig.join(toxic, "doc_id", "left_anti").withColumnRenamed("doc_id", "entry_id"))


# ---- sources and sinks


@query(r"""SELECT page_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(coalesce(html, ''), '(?is)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>', '', 'g'), '<[^>]+>', ' ', 'g'), '[ \t]+', ' ', 'g'), '\n{3,}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g') AS text FROM pages""")
def src17_html(spark, d):
    return table(spark, d, "pages").select("page_id", readers.html_text(F.col("html"), unescape=False).alias("text"))


@query()
def src17_html_unescaped(spark, d):
    return table(spark, d, "pages").select("page_id", readers.html_text(F.col("html")).alias("text"))


@query("SELECT conv_id, string_agg(trim(text), chr(10) ORDER BY turn) AS text FROM conversations WHERE role <> 'system' AND trim(text) <> '' GROUP BY conv_id")
def src21_tagged(spark, d):
    c = table(spark, d, "conversations")
    line = F.struct(F.concat(F.lit("line_"), F.col("turn").cast("string")).alias("k"), F.struct("text", F.struct((F.col("role") == "system").cast("int").alias("Crossed_out")).alias("tags")).alias("v"))
    pages = c.groupBy("conv_id").agg(F.to_json(F.map_from_entries(F.collect_list(line))).alias("value"))
    return readers.tagged_lines(pages, "conv_id").where("text <> ''")


@query("SELECT conv_id, string_agg(text, chr(10) ORDER BY turn) AS text, count(*) AS pages FROM conversations GROUP BY conv_id")
def src22_joined_pages(spark, d):
    return relational.joined_pages(table(spark, d, "conversations"), "conv_id", "turn")


@query("SELECT source AS font, CASE WHEN lang = 'en' THEN 'train' ELSE 'val' END AS split, CAST(doc_id AS VARCHAR) AS sample_id FROM documents")
def src13_manifest(spark, d):
    one = table(spark, d, "documents").withColumn("split", F.when(F.col("lang") == "en", "train").otherwise("val")).groupBy("source", "split").agg(F.collect_list(F.col("doc_id").cast("string")).alias("ids"))
    fonts = one.groupBy("source").agg(F.map_from_entries(F.collect_list(F.struct("split", "ids"))).alias("m"))
    manifest = fonts.select(F.to_json(F.struct(F.create_map("source", "m").alias("splits"))).alias("value"))
    return readers.split_manifest(manifest)


@query("SELECT CAST(event_id AS VARCHAR) AS sample_id, event_type AS dataset FROM events WHERE event_id % 2 = 1")
def src14_json_lines(spark, d):
    good = F.to_json(F.struct(F.col("event_id").cast("string").alias("sample_id"), F.col("event_type").alias("dataset")))
    lines = table(spark, d, "events").select(F.when(F.col("event_id") % 2 == 1, good).otherwise(F.lit("{broken")).alias("value"))
    return readers.parse_lines(lines, "sample_id string, dataset string")


@query()
def snk01_json_document(spark, d):
    return sinks.as_json_document(pairs.metrics_and_quality(pairs.scored(samples(spark, d), words=False), ["dataset"]), "dataset")


@query("SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, sum(value) AS value FROM events GROUP BY 1, 2")
def str01_windowed_counts(spark, d):
    from pairloom.streaming.resume import windowed_counts

    return windowed_counts(table(spark, d, "events")).select(F.col("window.start").alias("start"), "event_type", "n", "value")


# ---- picks and knowledge

_PICK = "md5('42:' || sample_id)"
_FIT = "length(gt_text) BETWEEN 10 AND 200 AND length(ocr_text) <= 5.0 * greatest(length(gt_text), 1)"
_BUCKET = """CASE WHEN length_ratio > 5 THEN 'runaway' WHEN cer_ocr = 0 AND cer_llm = 0 THEN 'correct_ocr' WHEN cer_ocr < 0.02::DOUBLE AND cer_delta > 0.005::DOUBLE THEN 'false_positive' WHEN cer_ocr >= 0.02::DOUBLE AND cer_delta > 0.01::DOUBLE THEN 'degraded_real'
WHEN abs(cer_delta) <= 0.005::DOUBLE AND cer_ocr > 0.05::DOUBLE THEN 'unfixed_hard' WHEN cer_llm = 0 AND cer_ocr > 0 THEN 'perfect' WHEN cer_delta < -0.005::DOUBLE THEN 'improved' END"""


@query(f"WITH {SAMPLES} SELECT sample_id FROM s WHERE {_FIT}")
def flt08_fit_for_examples(spark, d):
    return selection.fit_for_examples(samples(spark, d), 10, 200).select("sample_id")


@query(f"WITH {SAMPLES} SELECT sample_id, CAST(regexp_extract(sample_id, '_([0-9]+)$', 1) AS BIGINT) IN (SELECT regionkey FROM (SELECT DISTINCT r_regionkey AS regionkey FROM region)) AS pinned FROM s")
def flt10_pinned(spark, d):
    rows, numbers = samples(spark, d).select("sample_id"), table(spark, d, "region").select(F.col("r_regionkey").alias("n"))
    return selection.by_number(rows, "sample_id", numbers).withColumn("pinned", F.lit(True)).unionByName(selection.by_number(rows, "sample_id", numbers, False).withColumn("pinned", F.lit(False)))


@query(f"""WITH {D}, m AS (SELECT dataset, count(*) FILTER (WHERE chars > 0 AND length_ratio <= 5) AS n, coalesce(avg(cer) FILTER (WHERE chars > 0 AND length_ratio <= 5), 0) AS cer FROM d GROUP BY dataset)
SELECT dataset, n, cer FROM m UNION ALL SELECT NULL, CAST(sum(n) AS BIGINT), avg(cer) FROM m""")
def agg28_mean_over_normal(spark, d):
    return selection.mean_over_normal(pairs.scored(samples(spark, d), words=False), "dataset")


@query(f"""WITH {C}, t AS (SELECT sample_id, cer_ocr, cer_delta, CASE WHEN cer_llm = 0 THEN 'perfect' WHEN cer_delta > 0.005::DOUBLE THEN 'degraded' WHEN abs(cer_delta) <= 0.005::DOUBLE THEN 'unchanged' ELSE 'improved' END AS k FROM q)
SELECT sample_id, 0 AS turn, CAST(row_number() OVER (ORDER BY cer_delta DESC, sample_id) AS INTEGER) AS rank FROM t WHERE k = 'degraded' QUALIFY rank <= 30
UNION ALL SELECT sample_id, 1 AS turn, CAST(row_number() OVER (ORDER BY cer_ocr DESC, sample_id) AS INTEGER) AS rank FROM t WHERE k = 'unchanged' AND cer_ocr > 0.05::DOUBLE QUALIFY rank <= 30""")
def top04_degraded_then_hard(spark, d):
    return selection.degraded_then_hard(outcomes.compared(samples(spark, d)).select("sample_id", "cer_ocr", "cer_llm", "cer_delta"), 30).select("sample_id", "turn", "rank")


@query("""WITH r AS (SELECT lang AS source, doc_id % 50 AS slot, 1.0 * (n_chars % 100) / 200 AS cer, doc_id FROM documents), f AS (SELECT count(DISTINCT source) AS n FROM r),
c AS (SELECT slot, avg(cer) AS mean_cer, count(DISTINCT source) AS k FROM r GROUP BY slot HAVING k = (SELECT n FROM f)),
p AS (SELECT *, CASE WHEN mean_cer = 0 THEN 'correct' WHEN mean_cer <= 0.05::DOUBLE THEN 'easy' WHEN mean_cer <= 0.25::DOUBLE THEN 'medium' ELSE 'hard' END AS difficulty FROM c),
k AS (SELECT *, row_number() OVER (PARTITION BY difficulty ORDER BY md5('42:' || slot), slot) AS turn FROM p) SELECT doc_id, slot, difficulty FROM r JOIN k USING (slot) WHERE turn <= CASE difficulty WHEN 'easy' THEN 5 WHEN 'medium' THEN 10 WHEN 'hard' THEN 10 ELSE 0 END""")
def smp02_aligned_pick(spark, d):
    rows = table(spark, d, "documents").select("doc_id", F.col("lang").alias("source"), (F.col("doc_id") % 50).alias("slot"), ((F.col("n_chars") % 100) / 200).alias("cer"))
    return selection.aligned_pick(rows, "source", "slot", {"easy": 5, "medium": 10, "hard": 10}).select("doc_id", "slot", "difficulty")


@query(f"""WITH {D}, x AS (SELECT DISTINCT doc_id FROM labels WHERE toxic = 1), p AS (SELECT sample_id, CASE WHEN cer <= 0.05::DOUBLE THEN 0 WHEN cer <= 0.15::DOUBLE THEN 1 WHEN cer <= 0.35::DOUBLE THEN 2 ELSE 3 END AS stratum FROM d
WHERE {_FIT} AND cer > 0 AND doc_id NOT IN (SELECT doc_id FROM x)), k AS (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY {_PICK}, sample_id) AS turn FROM p) SELECT sample_id, stratum FROM k ORDER BY turn, stratum LIMIT 25""")
def smp03_few_shot_pick(spark, d):
    rows = pairs.scored(samples(spark, d), words=False)
    toxic = rows.select("doc_id", "sample_id").join(table(spark, d, "labels").where("toxic = 1").select("doc_id"), "doc_id", "left_semi")
    return selection.few_shot_pick(rows, 25, toxic).select("sample_id", "stratum")


@query(f"""WITH {C}, b AS (SELECT sample_id, {_BUCKET} AS bucket FROM q), k AS (SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY {_PICK}, sample_id) AS turn FROM b)
SELECT sample_id, bucket FROM k WHERE turn <= CASE bucket WHEN 'degraded_real' THEN 40 WHEN 'perfect' THEN 10 ELSE 20 END AND bucket IS NOT NULL""")
def smp04_dev_pick(spark, d):
    rows = outcomes.compared(samples(spark, d))
    rows = rows.select("sample_id", classify.dev_bucket(F.col("length_ratio"), F.col("cer_ocr"), F.col("cer_llm")).alias("bucket"))
    return selection.dev_pick(rows, "bucket", 150).select("sample_id", "bucket")


@query("""WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '\\s+'), lambda x: x <> '') AS u FROM documents)
SELECT doc_id, CASE WHEN len(u) >= 40 THEN '' ELSE array_to_string(list_value('a', 'b', 'c', 'd', 'e', 'f', 'g', 'h')[1 : 40 - len(u)], ' ') END AS system, array_to_string(u[greatest(len(u) - 39, 1) : ], ' ') AS words FROM w""")
def fn21_trimmed(spark, d):
    system, user = knowledge.trimmed(F.lit("a b c d e f g h"), F.col("text"), 40)
    return table(spark, d, "documents").select("doc_id", system.alias("system"), F.trim(F.regexp_replace(user, "\\s+", " ")).alias("words"))


@query(f"WITH {D} SELECT dataset, avg(greatest(0, 1 - least(cer, 1))) AS score FROM d GROUP BY dataset")
def udf10_score(spark, d):
    return pairs.scored(samples(spark, d), words=False).groupBy("dataset").agg(F.avg(knowledge.optimiser_score(F.col("cer"))).alias("score"))


# ---- summaries of corrections, keys and tables of trials


@query()
def agg14_sample_changes(spark, d):
    return outcomes.sample_changes(samples(spark, d), ["dataset", "sample_id"]).where("baseline + residual > 0")


@query()
def agg15_change_summary(spark, d):
    return outcomes.change_summary(outcomes.error_changes(samples(spark, d), ["dataset"]), ["dataset"])


@query()
def kb06_insights_text(spark, d):
    return outcomes.insights_text(outcomes.error_changes(samples(spark, d), ["dataset"]), ["dataset"])


@query()
def agg18_revert_statistics(spark, d):
    return validation.revert_statistics(validation.reverted(samples(spark, d), _lexicon(spark, d), letters=ASCII_LETTERS))


@query()
def agg22_training_metrics(spark, d):
    return outcomes.training_metrics(samples(spark, d))


@query()
def sta01_student(spark, d):
    return stats.compare_all(runs(spark, d), "base", exact=True)


@query(f"""WITH {R}, t AS (SELECT dataset, run, avg(cer) AS cer FROM r GROUP BY ALL), p AS (SELECT dataset, max(cer) FILTER (WHERE run = 'base') AS base, max(cer) FILTER (WHERE run = 'llm') AS llm, max(cer) FILTER (WHERE run = 'mean') AS mean FROM t GROUP BY dataset)
SELECT *, CASE least(base, llm, mean) WHEN base THEN 'base' WHEN llm THEN 'llm' ELSE 'mean' END AS best FROM p""")
def agg29_trial_table(spark, d):
    return jobs.trial_table(jobs.trial_summary(runs(spark, d).withColumnRenamed("run", "trial")), ["base", "llm", "mean"])


@query("""SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN lang || '-Train' WHEN 1 THEN lang || '-val' WHEN 2 THEN lang || '-VALIDATION' ELSE lang END AS key, doc_id % 4 = 0 AS training, doc_id % 4 IN (1, 2) AS validation FROM documents WHERE lang IS NOT NULL""")
def flt09_splits(spark, d):
    lang, n = F.col("lang"), F.col("doc_id") % 4
    key = F.when(n == 0, F.concat(lang, F.lit("-Train"))).when(n == 1, F.concat(lang, F.lit("-val"))).when(n == 2, F.concat(lang, F.lit("-VALIDATION"))).otherwise(lang)
    rows = table(spark, d, "documents").where("lang IS NOT NULL").select("doc_id", key.alias("key"))
    return rows.withColumn("training", text.is_training(F.col("key"))).withColumn("validation", text.is_validation(F.col("key")))


@query("""SELECT doc_id, CASE WHEN doc_id % 3 > 0 THEN doc_id END AS number, CASE doc_id % 3 WHEN 0 THEN 'A' WHEN 1 THEN 'set:A' ELSE 'set-x:A' END AS paragraph FROM documents""")
def fn18_ids(spark, d):
    n = F.col("doc_id") % 3
    key = F.concat(F.when(n == 0, "A_").when(n == 1, "set:A_").otherwise("set-x:A_"), F.col("doc_id").cast("string"))
    return table(spark, d, "documents").select("doc_id", text.sample_number(key).alias("number"), text.paragraph_id(key).alias("paragraph"))


@query(f"""WITH {SAMPLES} SELECT sample_id, CASE doc_id % 3 WHEN 1 THEN {_quoted(prompts.SHORT)} WHEN 2 THEN {_quoted(prompts.STRICT)} ELSE {_quoted(_B)} END AS system, ocr_text AS user_text FROM s""")
def prm01_versions(spark, d):
    version = F.when(F.col("doc_id") % 3 == 1, "v1").when(F.col("doc_id") % 3 == 2, "v2").otherwise("crafted")
    said = prompts.zero_shot(F.col("ocr_text"), version)
    return samples(spark, d).select("sample_id", said[0]["content"].alias("system"), said[1]["content"].alias("user_text"))


@query("""WITH k AS (SELECT doc_id, row_number() OVER (ORDER BY md5('42:' || doc_id), doc_id) AS turn FROM documents) SELECT doc_id, CASE WHEN turn <= 50 THEN 'train' ELSE 'dev' END AS split FROM k WHERE turn <= 70""")
def smp10_train_and_dev(spark, d):
    return sampling.train_and_dev(table(spark, d, "documents").select("doc_id"), "doc_id").select("doc_id", "split")
