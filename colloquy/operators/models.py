"""Plug-in points for text models and embedders.

Both run inside tasks over Arrow batches; Spark decides how rows are spread. A
failure becomes a row with ``error`` set, never a failed job.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from colloquy.functions import text, vectors

# A factory is called once per task, so a model is loaded once per task.
TextModel = Callable[[str], str]
Embedder = Callable[[list[str]], list[list[float]]]

MODEL_SCHEMA = "id string, raw string, error string, latency_ms bigint"


def run_text_model(prompts: DataFrame, factory: Callable[[], TextModel]) -> DataFrame:
    """Answer every (id, prompt) row; input order is kept inside a partition."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import time

        model = factory()
        for batch in batches:
            rows = []
            for key, prompt in zip(batch["id"], batch["prompt"]):
                started = time.monotonic()
                raw, error = None, None
                try:
                    raw = model(prompt)
                except Exception as problem:
                    error = f"{type(problem).__name__}: {problem}"
                rows.append((key, raw, error, int((time.monotonic() - started) * 1000)))
            yield pd.DataFrame(rows, columns=["id", "raw", "error", "latency_ms"])

    return prompts.select("id", "prompt").mapInPandas(run, MODEL_SCHEMA)


def run_embedder(
    texts: DataFrame, factory: Callable[[], Embedder], text_column: str = "text"
) -> DataFrame:
    """Add ``vector`` and ``error``; an empty or odd answer is an error."""

    @F.pandas_udf("vector array<float>, error string")
    def embed(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        model = factory()

        def checked(vector) -> tuple[list[float], None]:
            numbers = [float(x) for x in vector]
            if not numbers:
                raise ValueError("empty vector")
            return numbers, None

        def alone(value: str) -> tuple[list[float] | None, str | None]:
            try:
                return checked(model([value])[0])
            except Exception as problem:
                return None, f"{type(problem).__name__}: {problem}"

        for batch in batches:
            out = [(None, "ValueError: empty text")] * len(batch)
            asked = [i for i, value in enumerate(batch) if value]
            values = [batch.iat[i] for i in asked]
            # One call for a batch; texts are tried alone where it fails.
            try:
                found = model(values) if values else []
                if len(found) != len(values):
                    raise ValueError("as many vectors as texts are asked for")
                answers = [checked(v) for v in found]
            except Exception:
                answers = [alone(value) for value in values]
            for i, answer in zip(asked, answers):
                out[i] = answer
            yield pd.DataFrame(out, columns=["vector", "error"])

    return texts.withColumn("_embedded", embed(F.col(text_column))).select(
        *texts.columns, "_embedded.vector", "_embedded.error"
    )


def hashed_vector(text_column: Column, dim: int) -> Column:
    return vectors.hashed_terms(text.words(text_column), dim)


def embed(
    texts: DataFrame,
    text_column: str = "text",
    factory: Callable[[], Embedder] | None = None,
    dim: int = 64,
) -> DataFrame:
    """Dense vectors by the given embedder, or by signed hashed terms without one."""
    if factory is not None:
        return run_embedder(texts, factory, text_column)
    tokens = F.col("_tokens")
    return texts.withColumn("_tokens", text.words(F.coalesce(text_column, F.lit("")))).select(
        *texts.columns,
        vectors.hashed_vectors(tokens, dim).alias("vector"),
        F.when(F.size(tokens) == 0, "empty text").alias("error"),
    )
