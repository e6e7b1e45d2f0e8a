"""Correctors: a batch interface that never raises, a native identity, and resumable application (UDF01-UDF06, ORC02, ORC04)."""

from __future__ import annotations

import json
import os
import time
import urllib.request
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairloom.functions.text import accepted_output, is_arabic, token_estimate
from pairloom.operators.prompts import BASE

SCHEMA = "sample_id string, dataset string, ocr_text string, corrected_text string, prompt_tokens long, output_tokens long, latency_s double, success boolean, error string"
BACKENDS: dict[str, Callable[..., Callable[[list[str]], list[str | None]]]] = {}


def backend(name: str):
    """Registers a factory that makes a function from texts to corrected texts; it is called once in each Python worker."""

    def register(factory):
        BACKENDS[name] = factory
        return factory

    return register


@backend("mock")
def _mock():
    return lambda texts: texts


@backend("api")
def _api(url: str = "", model: str = "", system: str = BASE, timeout: float = 120.0, key_variable: str = "", **options):
    """A model behind a chat endpoint of the common form (``POST {url}/chat/completions``), asked one text at a time; failures are raised to the caller,
    which asks again. The key is read from the environment variable ``key_variable`` of the worker, if one is named."""
    if not url:
        raise ValueError("the api backend needs the url of a chat endpoint")

    def ask(text: str) -> str | None:
        body = {"model": model, "messages": [{"role": "system", "content": system}, {"role": "user", "content": text}], **options}
        headers = {"Content-Type": "application/json"} | ({"Authorization": f"Bearer {os.environ[key_variable]}"} if key_variable else {})
        request = urllib.request.Request(f"{url.rstrip('/')}/chat/completions", json.dumps(body).encode(), headers)
        with urllib.request.urlopen(request, timeout=timeout) as answer:
            return json.load(answer)["choices"][0]["message"]["content"]

    return lambda texts: [ask(t) if t.strip() else t for t in texts]


def identity(rows: DataFrame) -> DataFrame:
    """The mock corrector without Python."""
    text = F.coalesce("ocr_text", F.lit(""))
    return rows.select("sample_id", "dataset", "ocr_text", text.alias("corrected_text"), token_estimate(text).alias("prompt_tokens"), token_estimate(text).alias("output_tokens"), F.lit(0.0).alias("latency_s"), F.lit(True).alias("success"), F.lit(None).cast("string").alias("error"))


def answered(model: Callable[[list[str]], list[str | None]], texts: list[str], retries: int) -> list[tuple[str | None, str | None]]:
    """An answer or an error for each text: the batch is asked first, then every text without an answer that is not blank alone, ``retries`` times."""
    out: list[tuple[str | None, str | None]] = [(None, None)] * len(texts)

    def ask(places: list[int]) -> None:
        try:
            answers = list(model([texts[k] for k in places]))
        except Exception as e:  # noqa: BLE001  the contract of a corrector
            answers, error = [None] * len(places), str(e)[:500]
        else:
            error = None
        for k, x in zip(places, answers):
            fine = x is not None and (x.strip() or not texts[k].strip())
            out[k] = (x, None) if fine else (None, error or "blank answer")

    ask(list(range(len(texts))))
    for _ in range(retries):
        for k in [k for k, (x, _) in enumerate(out) if x is None]:
            ask([k])
    return out


def corrected(rows: DataFrame, name: str = "mock", batch: int = 64, retries: int = 2, arabic_only: bool = True, **options) -> DataFrame:
    """Corrections of ``rows`` (``sample_id, dataset, ocr_text``) by a registered backend, made with ``options``. A failed or blank answer is asked again by itself, then stands as the OCR text with success false."""
    factory = BACKENDS[name]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = factory(**options)
        for frame in frames:
            for first in range(0, len(frame), batch):
                part = frame.iloc[first : first + batch].copy()
                texts, began = part["ocr_text"].fillna("").tolist(), time.time()
                answers = answered(model, texts, retries)
                part["corrected_text"] = [t if x is None else x for t, (x, _) in zip(texts, answers)]
                part["prompt_tokens"] = [max(1, len(t) // 4) for t in texts]
                part["output_tokens"] = [max(1, len((a or "").split())) for a in part["corrected_text"]]
                part["latency_s"] = (time.time() - began) / max(1, len(part))
                part["success"], part["error"] = [x is not None for x, _ in answers], [e for _, e in answers]
                yield part[["sample_id", "dataset", "ocr_text", "corrected_text", "prompt_tokens", "output_tokens", "latency_s", "success", "error"]]

    out = rows.select("sample_id", "dataset", "ocr_text").mapInPandas(run, SCHEMA)
    if not arabic_only:
        return out
    kept = accepted_output(F.col("corrected_text"), F.col("ocr_text"))
    return out.withColumn("success", F.col("success") & F.coalesce(is_arabic(F.col("corrected_text")), F.lit(False))).withColumn("corrected_text", kept)


def totals(corrections: DataFrame, by: list[str]) -> DataFrame:
    return corrections.groupBy(*by).agg(F.count("*").alias("n"), F.sum("prompt_tokens").alias("prompt_tokens"), F.sum("output_tokens").alias("output_tokens"), F.avg("latency_s").alias("latency_s"), F.count_if(~F.col("success")).alias("failed"))
