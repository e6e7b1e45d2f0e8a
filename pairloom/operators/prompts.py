"""Prompt records as Column expressions (PRM01-PRM10, KB04, KB07).

Wordings are parameters with plain defaults; sections keep the tags by which injection finds its place."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairloom.functions.text import strip

# Section tags and anchors.
EXAMPLES, EXAMPLES_END, OUTPUT_FORMAT = "<examples>", "</examples>", "<output_format>"
BASE = "You correct OCR text. Return the text with only clear errors mended.\n\n<examples>\n</examples>\n\n<output_format>\nThe corrected text only.\n</output_format>"
SHORT = "Correct the OCR errors of this Arabic text. Return only the corrected text."
STRICT = "You are an editor of Arabic OCR text. Mend only clear recognition errors, add and remove nothing, keep what is right. Return only the corrected text."
VERSIONS = {"crafted": BASE, "v1": SHORT, "v2": STRICT}
SECTIONS = {
    "confusion": ("confusion_patterns", "Characters that this OCR system confuses:"),
    "self": ("self_analysis", "What this model gets wrong:"),
    "sentences": ("retrieved_corrections", "Corrections of similar texts:"),
    "words": ("retrieved_words", "Corrections of similar words:"),
}


def blank(c: Column) -> Column:
    return strip(F.coalesce(c, F.lit(""))) == ""


def section(kind: str, body: Column) -> Column:
    """A tagged section, or null for a blank body."""
    tag, label = SECTIONS[kind]
    return F.when(~blank(body), F.concat(F.lit(f"<{tag}>\n{label}\n\n"), body, F.lit(f"\n</{tag}>")))


def _before_first(base: Column, anchor: str, text: Column) -> Column:
    at = F.locate(anchor, base)
    return F.concat(F.substring(base, F.lit(1), at - 1), text, F.substring(base, at, F.length(base)))


def inject(base: Column, text: Column) -> Column:
    """Text before the examples, else before the output format, else at the end; null or blank text changes nothing."""
    gap = F.lit("\n\n")
    out = (
        F.when(F.locate(EXAMPLES, base) > 0, _before_first(base, EXAMPLES, F.concat(text, gap)))
        .when(F.locate(OUTPUT_FORMAT, base) > 0, _before_first(base, OUTPUT_FORMAT, F.concat(text, gap)))
        .otherwise(F.concat(F.regexp_replace(base, "(?U)\\s+$", ""), gap, text))
    )
    return F.when(blank(text), base).otherwise(out)


def inject_examples(base: Column, text: Column) -> Column:
    """Examples at the end of the examples block; without one, in a new block."""
    block = F.concat(F.lit(f"{EXAMPLES}\n"), text, F.lit(f"\n{EXAMPLES_END}"))
    out = (
        F.when(F.locate(EXAMPLES_END, base) > 0, _before_first(base, EXAMPLES_END, F.concat(F.lit("\n"), text, F.lit("\n"))))
        .when(F.locate(OUTPUT_FORMAT, base) > 0, _before_first(base, OUTPUT_FORMAT, F.concat(block, F.lit("\n\n"))))
        .otherwise(F.concat(F.regexp_replace(base, "(?U)\\s+$", ""), F.lit("\n\n"), block))
    )
    return F.when(blank(text), base).otherwise(out)


def messages(system: Column, user: Column) -> Column:
    return F.array(F.struct(F.lit("system").alias("role"), system.alias("content")), F.struct(F.lit("user").alias("role"), user.alias("content")))


def self_section(insights: Column, pairs: Column, traps: Column) -> Column:
    part = lambda label, c: F.when(~blank(c), F.concat(F.lit(f"{label}\n"), c))
    return section("self", F.concat_ws("\n\n", part("Weaknesses:", insights), part("Words often missed:", pairs), part("Do not change:", traps)))


def zero_shot(ocr_text: Column, version: Column, versions: dict[str, str] = VERSIONS, examples: Column | None = None) -> Column:
    """Messages of the plain task in one of ``versions``; the first stands for a version that is not there."""
    first, *others = versions.items()
    system = F.lit(first[1])
    for name, text in others:
        system = F.when(version == name, F.lit(text)).otherwise(system)
    return messages(system if examples is None else inject_examples(system, F.coalesce(examples, F.lit(""))), ocr_text)


def crafted(ocr_text: Column, system: Column, fallback: str = STRICT) -> Column:
    """Messages with a system text written elsewhere, and with ``fallback`` where that is blank."""
    return messages(F.when(blank(system), F.lit(fallback)).otherwise(system), ocr_text)


def task_message(text: Column) -> Column:
    """A task for the model itself: a single turn of the user."""
    return F.array(F.struct(F.lit("user").alias("role"), text.alias("content")))


def with_prompts(rows: DataFrame, base: str = BASE) -> DataFrame:
    """Adds ``messages`` and ``prompt_used`` by the column ``prompt_type``; a type whose contexts are all blank, or an unknown one, is zero-shot.

    Contexts are read from ``confusion_context, insights_context, word_pairs_context, overcorrection_context, retrieved_sentences,
    retrieved_words, few_shot_examples, crafted_prompt``; columns that are not there are blank."""
    col = lambda c: F.col(c) if c in rows.columns else F.lit("")
    root = F.lit(base)
    confusion = section("confusion", col("confusion_context"))
    own = self_section(col("insights_context"), col("word_pairs_context"), col("overcorrection_context"))
    found = F.nullif(F.concat_ws("\n\n", section("sentences", col("retrieved_sentences")), section("words", col("retrieved_words"))), F.lit(""))
    both = F.nullif(F.concat_ws("\n\n", confusion, own), F.lit(""))
    kind = F.col("prompt_type")
    added = F.when(kind == "ocr_aware", confusion).when(kind == "self_reflective", own).when(kind == "combined", both).when(kind == "rag", found)
    system = inject_examples(inject(root, F.coalesce(added, F.lit(""))), F.coalesce(col("few_shot_examples"), F.lit("")))
    # prompts that were written elsewhere stand for the whole system text
    given = F.when(kind.isin("crafted", "meta") & ~blank(col("crafted_prompt")), col("crafted_prompt"))
    system = F.coalesce(given, system)
    return rows.withColumn("prompt_used", F.when(added.isNotNull() | given.isNotNull(), kind).otherwise("zero_shot")).withColumn("messages", messages(system, F.col("ocr_text")))


def pair_lines(pairs: DataFrame, by: list[str], n: int = 15) -> DataFrame:
    """``by, text``: word pairs as lines, most frequent first."""
    rows = F.slice(F.array_sort(F.collect_list(F.struct((-F.col("count")).alias("k"), "wrong", "right"))), 1, n)
    return pairs.groupBy(*by).agg(F.array_join(F.transform(rows, lambda x: F.concat(x["wrong"], F.lit(" > "), x["right"])), "\n").alias("text"))


def design_task(samples: DataFrame, header: str = "Write a system prompt for the correction of OCR text. Samples by difficulty follow.", footer: str = "Return the prompt only.") -> str:
    """The text that asks a model to write a prompt: ``samples`` (``difficulty, cer, font, ocr_text, gt_text, ord``; a few picked rows) under their difficulty."""
    parts = [header]
    rows = samples.orderBy("ord").collect()
    for level in ("correct", "easy", "medium", "hard"):
        if here := [r for r in rows if r.difficulty == level]:
            parts.append(f"\n### {level}\n")
            for n, r in enumerate(here, 1):
                parts.append(f"Sample {n} (CER {r.cer:.4f}{f', font {r.font}' if r.font else ''})\nOCR: {r.ocr_text}\nGT: {r.gt_text}\n")
    return "\n".join([*parts, footer])


def refine_task(prompt: str, rows: DataFrame, n: int = 15, footer: str = "Say why the prompt failed on these, and return a better prompt only.") -> str:
    """The text that asks a model to mend ``prompt``: of ``rows`` (``sample_id, cer_ocr, cer_llm, ocr_text, corrected_text, gt_text``) the ``n`` that lost most, ties by id."""
    failed = rows.where("cer_llm > cer_ocr")
    worst = failed.orderBy(F.desc(F.col("cer_llm") - F.col("cer_ocr")), "sample_id").limit(n).collect()
    parts = [f"Current prompt:\n---\n{prompt}\n---", f"{failed.count()} texts got worse, the worst {len(worst)}:\n"]
    parts += [f"Failure {k} (CER {r.cer_ocr:.4f} -> {r.cer_llm:.4f})\nOCR: {r.ocr_text}\nLLM: {r.corrected_text}\nGT: {r.gt_text}\n" for k, r in enumerate(worst, 1)]
    return "\n".join([*parts, footer])


def pick_generated(records: DataFrame, wanted: str) -> DataFrame:
    """The first record that matches a kind, else the first of all."""
    return records.orderBy((F.col("kind") != wanted).cast("int"), "ord").limit(1)
