"""Explanation text for prediction rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weekcast.functions import labels as L
from weekcast.session import stage

TEMPLATE_SOURCE = "offline_template"


def without_insights(predictions: DataFrame) -> DataFrame:
    return predictions.drop("insight", "insight_source")


def with_templates(predictions: DataFrame) -> DataFrame:
    """Template text as a plain column expression: no Python worker involved."""
    return without_insights(predictions).withColumns({
        "insight": L.template_insight(), "insight_source": F.lit(TEMPLATE_SOURCE)})


def with_prompts(predictions: DataFrame) -> DataFrame:
    return without_insights(predictions).withColumn("prompt", L.prompt())


def with_generated(predictions: DataFrame, generate: Callable[[str], str] | None = None,
                   source: str = "generator") -> DataFrame:
    """Text from a caller-supplied generator, one prompt per row.

    A row whose call fails, or returns nothing, falls back to its template and
    is labelled so. Prompts and templates are built on the JVM; only the call
    itself runs in Python, in Arrow batches.
    """
    if generate is None:
        return with_templates(predictions)
    base = with_templates(predictions).withColumn("_prompt", L.prompt())
    out = T.StructType([f for f in base.schema.fields if f.name != "_prompt"])

    def fill(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts, sources = [], []
            for request, fallback in zip(batch["_prompt"], batch["insight"]):
                try:
                    text = generate(request)
                except Exception:
                    text = None
                texts.append(text or fallback)
                sources.append(source if text else TEMPLATE_SOURCE)
            yield batch.assign(insight=texts, insight_source=sources).drop(columns="_prompt")

    return base.mapInPandas(fill, out)


def with_generated_batches(predictions: DataFrame, generate: Callable[[list[str]], list],
                           source: str = "generator", batch: int = 16, in_flight: int = 4,
                           retries: int = 1) -> DataFrame:
    """Text from a generator that takes a list of prompts and returns as many texts.

    A task keeps up to ``in_flight`` batches of ``batch`` prompts going. A batch that fails,
    or whose answer has another length, is asked again ``retries`` times, and then prompt
    by prompt, so one bad prompt costs only its own row; such a row, and one without text,
    gets its template. The result is written to the shared folder, so rows are asked for
    once however often they are read.
    """
    base = with_templates(predictions).withColumn("_prompt", L.prompt())
    out = T.StructType([f for f in base.schema.fields if f.name != "_prompt"])

    def tried(prompts: list[str]) -> list:
        for _ in range(1 + retries):
            try:
                texts = list(generate(prompts))
                if len(texts) == len(prompts):
                    return texts
            except Exception:                           # the caller's service: any failure
                continue
        if len(prompts) == 1:
            return [None]
        return [text for p in prompts for text in tried([p])]

    def fill(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with ThreadPoolExecutor(in_flight) as pool:
            for frame in frames:
                prompts = frame["_prompt"].tolist()
                parts = [prompts[i:i + batch] for i in range(0, len(prompts), batch)]
                texts = [text or None for part in pool.map(tried, parts) for text in part]
                yield frame.assign(
                    insight=[t or old for t, old in zip(texts, frame["insight"], strict=True)],
                    insight_source=[source if t else TEMPLATE_SOURCE for t in texts],
                ).drop(columns="_prompt")

    return stage(base.mapInPandas(fill, out), "told")
