"""Embedders: any function from a text Column to an ARRAY column; models are pluggable, those here need none."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from .vectors import feature_hash_embedding, fit_dimension

#: Dimensions that topics add to in the seeded embedding.
TOPICS = ((("space", "moon", "nasa"), slice(0, 5)), (("artificial intelligence", "ai"), slice(10, 15)))


def seeded_vector(text: str | None, dim: int = 384) -> list[float] | None:
    """A vector drawn from a seed made of the first 100 characters, moved by topics, at length 1; null for null."""
    if text is None:
        return None
    v = np.random.RandomState(sum(map(ord, text[:100]))).rand(dim).astype(np.float32) * np.float32(0.1)
    low = text.lower()
    for words, where in TOPICS:
        if any(w in low for w in words):
            v[where] += 0.5
    return (v / np.linalg.norm(v)).tolist()


def seeded_embedding(text: Column, dim: int = 384) -> Column:
    """seeded_vector in Arrow batches: a stand-in for a model in tests."""

    @F.pandas_udf(ArrayType(FloatType()))
    def embed(batch: pd.Series) -> pd.Series:
        return batch.map(lambda t: seeded_vector(t, dim))

    return embed(text)


def model_embedding(load: Callable[[], Callable[[list[str]], np.ndarray]], batch_size: int = 32) -> Callable[[Column], Column]:
    """An embedder from a model: load is called once in each worker, the model on batches of texts; null texts are embedded as empty."""

    @F.pandas_udf(ArrayType(FloatType()))
    def embed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load()
        for batch in batches:
            texts = batch.fillna("").tolist()
            rows = [v for k in range(0, len(texts), batch_size) for v in np.asarray(model(texts[k : k + batch_size]), np.float32).tolist()]
            yield pd.Series(rows)

    return embed


def embed_by_type(rows: DataFrame, embedders: Mapping[str, Callable[[Column], Column]], content_type: str = "content_type", text: str = "content", dim: int = 512) -> DataFrame:
    """rows with vector: the embedding of each content type's own embedder, that of text for all others, cut or filled to dim values.

    The rows are split by type and united, so that each goes through one embedder only.
    """
    kind = F.coalesce(F.col(content_type), F.lit("text"))
    own = [k for k in embedders if k != "text"]
    parts = [(~kind.isin(own) if own else F.lit(True), embedders.get("text", feature_hash_embedding)), *((kind == k, embedders[k]) for k in own)]
    return reduce(DataFrame.unionByName, (rows.filter(which).withColumn("vector", fit_dimension(embed(F.col(text)), dim)) for which, embed in parts))
