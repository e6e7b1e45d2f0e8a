"""Reports as text over small summaries (SNK05-SNK07, SNK11). Only summaries, and the stated numbers of samples, come to the driver."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from pairloom.functions.classify import CATEGORIES
from pairloom.functions.text import flatten, normalise, truncate
from pairloom.operators import outcomes
from pairloom.operators.pairs import RUNAWAY
from pairloom.sources.sinks import markdown


def report(title: str, sections: dict[str, DataFrame], notes: dict[str, str] | None = None) -> str:
    """A Markdown report: a table for each section, under its note if there is one."""
    body = []
    for name, table in sections.items():
        head, *rest = markdown(table, name).split("\n\n", 1)
        note = (notes or {}).get(name)
        body.append("\n\n".join([head, *([note] if note else []), *rest]))
    return "\n".join([f"# {title}\n", *body])


def baseline_report(parts: dict[str, DataFrame], title: str = "Baseline", confusions: int = 20) -> str:
    """The report of ``plans.jobs.baseline``: rates with and without runaways and diacritics, the most frequent confusions, the taxonomy."""
    top = parts["confusions"].orderBy(F.desc("count"), "gt_char", "ocr_char").limit(confusions)
    return report(
        title,
        {"All samples": parts["metrics"].orderBy("dataset"), "Without runaways": parts["metrics_normal"].orderBy("dataset"), "Without diacritics": parts["metrics_no_diacritics"].orderBy("dataset"),
         "Quality": parts["quality"].orderBy("dataset"), "Confusions": top, "Error types": parts["taxonomy"].where("count > 0").orderBy("dataset", "level", F.desc("count"), "value")},
        {"Without runaways": f"A runaway is over {RUNAWAY:g} times as long as its reference.", "Confusions": f"The {confusions} most frequent."},
    )


def correction_report(parts: dict[str, DataFrame], title: str = "Corrections") -> str:
    """The report of ``plans.jobs.analysed``: outcomes, categories and error changes."""
    return report(title, {"Outcomes": parts["outcomes"].orderBy("dataset"), "Categories": parts["categories"].orderBy("ord").drop("ord"), "Error types": parts["changes"].where("baseline + residual > 0").orderBy("dataset", F.desc("baseline"), "error_type")})


def comparison_report(parts: dict[str, DataFrame], title: str = "Runs") -> str:
    """The report of ``plans.jobs.run_comparison``: averages, the best run, statistics."""
    statistics = parts["statistics"].join(parts["intervals"], "run", "left").orderBy("run")
    return report(title, {"Averages": parts["averages"].orderBy("cer", "run"), "Best": parts["best"], "Against the baseline": statistics})


def training_report(rows: DataFrame, metrics: DataFrame, unfixed: DataFrame, introduced: DataFrame, title: str = "Training analysis", pairs: int = 50) -> str:
    """Training classes of compared ``rows``, ``outcomes.training_metrics``, and the most frequent word pairs (``wrong, right, count``) left and made."""
    order = [F.col("dataset").isNotNull(), F.col("dataset")]
    best = lambda p: p.orderBy(F.desc("count"), "wrong", "right").limit(pairs)
    return report(title, {"Classes": outcomes.training_buckets(rows).orderBy(*order), "Rates": metrics.orderBy(*order, "diacritics", "rate", "text"), "Left wrong": best(unfixed), "Made wrong": best(introduced)}, {"Classes": "The first row is that of all data sets."})


def paper_table(summary: DataFrame, row: str, columns: list[str], caption: str, percent: bool = True, lowest_best: bool = True) -> str:
    """A LaTeX table of ``summary``, a line for each ``row`` in order, the best number of each column in bold, a dash for null."""
    rows = summary.select(row, *columns).orderBy(row).collect()
    pick = min if lowest_best else max
    best = {c: pick((r[c] for r in rows if r[c] is not None), default=None) for c in columns}
    escaped = lambda x: "".join("\\" + ch if ch in "_%&#$" else ch for ch in str(x))

    def cell(v: float | None, c: str) -> str:
        if v is None:
            return "--"
        text = f"{v * 100:.2f}" if percent else f"{v:.4f}" if isinstance(v, float) else str(v)
        return f"\\textbf{{{text}}}" if v == best[c] else text

    lines = [" & ".join([escaped(r[row]), *(cell(r[c], c) for c in columns)]) + " \\\\" for r in rows]
    head = " & ".join(escaped(x) for x in [row, *columns]) + " \\\\"
    return "\n".join(["\\begin{table}", f"\\caption{{{escaped(caption)}}}", f"\\begin{{tabular}}{{l{'r' * len(columns)}}}", "\\hline", head, "\\hline", *lines, "\\hline", "\\end{tabular}", "\\end{table}"]) + "\n"


def sample_report(corrections: DataFrame, title: str, regressed: int = 40, improved: int = 20, without_runaways: bool = False) -> str:
    """A text report: counts of outcomes, mean rates, categories with their mean change, then the samples that lost and gained most with their texts
    (on one line, at most 220 characters). A sample is a runaway by its OCR text; ``without_runaways`` leaves those out of all but their count."""
    rows = outcomes.compared(corrections)
    ratio = F.length(normalise(F.col("ocr_text"))) / F.greatest(F.length(normalise(F.col("gt_text"))), F.lit(1))
    rows = rows.withColumn("runaway", F.coalesce(ratio > RUNAWAY, F.lit(False)))
    used = rows.where(~F.col("runaway")) if without_runaways else rows
    found = {r.category: r for r in used.groupBy("category").agg(F.count("*").alias("n"), F.avg("cer_delta").alias("delta")).collect()}
    whole = rows.agg(F.count("*").alias("n"), F.count_if("runaway").alias("runaways")).first()
    if not whole.n:
        return f"{title}\n\nNo valid samples.\n"
    counts = outcomes.outcome_summary(used, []).first()
    lines = [title, "=" * len(title), "", f"Samples: {whole.n}, runaways: {whole.runaways}{' (left out)' if without_runaways else ''}"]
    lines += [f"Improved: {counts.improved}, regressed: {counts.regressed}, unchanged: {counts.unchanged}"]
    if counts.n:
        lines += [f"Mean CER: {counts.cer_ocr:.4f} -> {counts.cer_llm:.4f}"]
    lines += ["", "Categories"] + [f"  {c:<20}{found[c].n if c in found else 0:>10}  {f'{found[c].delta:+.4f}' if c in found else ''}".rstrip() for c in CATEGORIES]
    texts = used.select("sample_id", "dataset", "outcome", "category", "cer_ocr", "cer_llm", "cer_delta", *[truncate(flatten(F.coalesce(c, F.lit("")))).alias(c) for c in ("gt_text", "ocr_text", "corrected_text")])
    picked = outcomes.extremes(texts, regressed, improved).collect()
    for label, kind, sign in (("Regressed, worst first", "regressed", -1), ("Improved, best first", "improved", 1)):
        here = sorted((r for r in picked if r.outcome == kind), key=lambda r: (sign * r.cer_delta, r.sample_id))  # noqa: B023
        lines += ["", label, "-" * len(label)] + [sample_block(n, r) for n, r in enumerate(here, 1)]
    return "\n".join(lines) + "\n"


def sample_block(n: int, r: Row) -> str:
    return f"[{n}] {r.sample_id} ({r.dataset}) {r.category}\n    CER {r.cer_ocr:.4f} -> {r.cer_llm:.4f} ({r.cer_delta:+.4f})\n    GT : {r.gt_text}\n    OCR: {r.ocr_text}\n    LLM: {r.corrected_text}"


def console(summary: DataFrame, key: str, say: Callable[[str], None] = print) -> None:
    """A line for each row of a summary."""
    for r in summary.orderBy(key).collect():
        say(f"{r[key]}: " + ", ".join(f"{c} {v:.4f}" if isinstance(v, float) else f"{c} {v}" for c, v in r.asDict().items() if c != key))
