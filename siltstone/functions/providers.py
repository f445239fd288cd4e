"""Pluggable embedding, scoring and answering functions with deterministic defaults, and a cache of answers."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import token_count


class Embedder(Protocol):
    def __call__(self, texts: list[str]) -> list[list[float]]: ...


class Model(Protocol):
    def __call__(self, prompts: list[str]) -> list[str]: ...


class HashingEmbedder:
    """Signed counts of hashed words, normalised: the default when no model is plugged in."""

    def __init__(self, dim: int = 64):
        self.dim = dim

    def __call__(self, texts: list[str]) -> list[list[float]]:
        out = np.zeros((len(texts), self.dim))
        for i, text in enumerate(texts):
            for w in (text or "").lower().split():
                h = int(hashlib.md5(w.encode()).hexdigest()[:15], 16)
                out[i, h % self.dim] += 1 if h >> 59 else -1
        size = np.linalg.norm(out, axis=1, keepdims=True)
        return np.divide(out, size, out=np.zeros_like(out), where=size > 0).astype(np.float32).tolist()


class ExtractiveModel:
    """Answers with the first sentence of the prompt's last line."""

    def __call__(self, prompts: list[str]) -> list[str]:
        return [(p or "").strip().split("\n")[-1].split(". ")[0] for p in prompts]


def embed(text: Column, embedder: Embedder = HashingEmbedder(), batch: int = 64) -> Column:
    """array<float> of a text column; the embedder is sent to the workers once a task and called with batches."""

    @F.pandas_udf("array<float>")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            texts = part.fillna("").tolist()
            yield pd.Series([v for i in range(0, len(texts), batch) for v in embedder(texts[i : i + batch])], dtype=object)

    return run(text)


def answer(prompt: Column, model: Model = ExtractiveModel(), batch: int = 16) -> Column:
    """The model's answer to a prompt column."""

    @F.pandas_udf("string")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            prompts = part.fillna("").tolist()
            yield pd.Series([x for i in range(0, len(prompts), batch) for x in model(prompts[i : i + batch])], dtype=object)

    return run(prompt)


def cached_answers(prompts: DataFrame, prompt: str, cache, model: Callable[[list[str]], list[str]] = ExtractiveModel()) -> DataFrame:
    """prompts with answer, from cache (a KeyedTable with id, answer) where it has them; only missing ones reach the model, and are stored."""
    keyed = prompts.withColumn("id", F.md5(prompt))
    todo = cache.missing(keyed.select("id", F.col(prompt).alias("_p")).dropDuplicates(["id"]))
    if not todo.isEmpty():
        cache.upsert(todo.select("id", answer(F.col("_p"), model).alias("answer")))
    return keyed.join(cache.load(), "id", "left").drop("id")


def summarised(text: Column, limit: int, model: Model = ExtractiveModel()) -> Column:
    """Texts under limit tokens as they are; only longer ones go to the model."""
    return F.when(token_count(text) < limit, text).otherwise(answer(F.when(token_count(text) >= limit, text), model))
