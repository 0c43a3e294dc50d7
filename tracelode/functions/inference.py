"""Contracts around models: pluggable encoders and scorers in Arrow batches, with deterministic stand-ins."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import tokenize_mixed

DIM = 64


def encoder(load: Callable[[], Callable[[list[str]], np.ndarray]]):
    """A column function text -> array<float>. ``load`` runs once in each worker, so a model is loaded there and not shipped."""

    @F.pandas_udf("array<float>")
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load()
        for texts in batches:
            vectors = model(texts.fillna("").tolist())
            norm = np.linalg.norm(vectors, axis=1, keepdims=True)
            yield pd.Series(list(np.divide(vectors, norm, out=np.zeros_like(vectors), where=norm > 0).astype(np.float32)))

    return encode


def hashing_encoder() -> Callable[[list[str]], np.ndarray]:
    """Signed word hashing; stands in for a text encoder."""

    def encode(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), DIM))
        for k, t in enumerate(texts):
            for w in t.lower().split():
                h = xxhash.xxh3_64_intdigest(w.encode())
                out[k, h % DIM] += 1.0 if h >> 63 else -1.0
        return out

    return encode


def scorer(load: Callable[[], Callable[[list[str], list[str]], np.ndarray]]):
    """A column function (query, passage) -> double, by a model loaded once in each worker."""

    @F.pandas_udf("double")
    def score(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        model = load()
        for q, p in batches:
            yield pd.Series(np.asarray(model(q.fillna("").tolist(), p.fillna("").tolist()), float))

    return score


def _released(model) -> None:
    """Frees a model that has a ``close``, as it does when its partition ends, be it by an error."""
    getattr(model, "close", lambda: None)()


def image_encoder(load: Callable[[], Callable[[list[bytes | None]], list[np.ndarray]]]):
    """A column function image file -> array<array<float>>, a vector for each patch. Loaded once in each worker's partition and released after it; null gives null."""

    @F.pandas_udf("array<array<float>>")
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load()
        try:
            for files in batches:
                there = files.notna()
                vectors = [np.asarray(v, np.float32) for v in model([bytes(f) for f in files[there]])]
                if len(vectors) != there.sum() or any(v.ndim != 2 or not np.isfinite(v).all() for v in vectors):
                    raise ValueError("an image encoder must give one finite matrix an image")
                yield pd.Series([v.tolist() for v in vectors], index=files.index[there], dtype=object).reindex(files.index).astype(object).where(there, None)
        finally:
            _released(model)

    return encode


def generator(load: Callable[[], Callable[[list[str]], list[str]]]):
    """A column function prompt -> text, by a model loaded once in each worker's partition and released after it; null gives null."""

    @F.pandas_udf("string")
    def generate(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load()
        try:
            for prompts in batches:
                there = prompts.notna()
                texts = list(model(prompts[there].tolist()))
                if len(texts) != there.sum():
                    raise ValueError("a generator must give one text a prompt")
                yield pd.Series(texts, index=prompts.index[there], dtype=object).reindex(prompts.index).where(there, None)
        finally:
            _released(model)

    return generate


def visual_bounds(low: int, high: int) -> tuple[int, int]:
    """The least and the most visual tokens of an image; a wrong pair is an error."""
    if low < 1 or high < low:
        raise ValueError("visual tokens must be positive and in order")
    return low, high


def lexical_score(query: Column, passage: Column) -> Column:
    """The share of the query's distinct tokens that the passage has; stands in for a cross-encoder and stays in the JVM."""
    q = F.array_distinct(tokenize_mixed(query))
    return F.when(F.size(q) == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(q, tokenize_mixed(passage))) / F.size(q))


def message(question: Column, evidence: Column) -> Column:
    """A prompt as array<struct<type, text>>: the task, the evidence with its citation ids, the question."""
    parts = F.transform(evidence, lambda e: F.struct(F.lit("text").alias("type"), F.concat(F.lit("["), e["alias"], F.lit("] "), e["text"]).alias("text")))
    task = F.lit("Answer from the evidence alone, cite its ids, and abstain if it does not answer. Reply with one JSON object: answer, abstain, citation_ids.")
    one = lambda c: F.array(F.struct(F.lit("text").alias("type"), c.alias("text")))
    return F.concat(one(task), parts, one(question))
