"""Embedding of texts behind a small protocol; by default hashed words, normalised."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class Embedder(Protocol):
    def encode(self, texts: list[str]) -> np.ndarray: ...
    def dimension(self) -> int: ...
    def name(self) -> str: ...


class HashEmbedder:
    """Signed buckets of the words' md5; needs no model."""

    def __init__(self, size: int = 64):
        self.size = size

    def encode(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.size), np.float32)
        for i, t in enumerate(texts):
            for w in (t or "").lower().split():
                h = int(hashlib.md5(w.encode()).hexdigest()[:12], 16)
                out[i, h // 2 % self.size] += 1 if h % 2 else -1
        return out

    def dimension(self) -> int:
        return self.size

    def name(self) -> str:
        return f"hash-{self.size}"


def transformer(model: str, device: str | None = None):
    """An embedder of the optional sentence-transformers package, loaded once in each worker."""

    def load() -> Embedder:
        from sentence_transformers import SentenceTransformer

        net = SentenceTransformer(model, device=device)

        class Loaded:
            encode = staticmethod(lambda texts: net.encode(texts, convert_to_numpy=True))
            dimension = staticmethod(net.get_sentence_embedding_dimension)
            name = staticmethod(lambda: model)

        return Loaded()

    return load


def factory(model_name: str = "hash", size: int = 64):
    """A loader of the named embedder; none for "none"."""
    if model_name == "none":
        return None
    return (lambda: HashEmbedder(size)) if model_name == "hash" else transformer(model_name)


def encode(text: Column | str, load=None) -> Column:
    """Unit vectors; null texts count as empty, and a zero vector stays one."""
    load = load or factory()

    @F.pandas_udf("array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load()
        for s in batches:
            v = np.asarray(model.encode([x or "" for x in s]), np.float32)
            norm = np.linalg.norm(v, axis=1, keepdims=True)
            yield pd.Series(list(v / np.where(norm > 0, norm, 1)))

    return run(F.col(text) if isinstance(text, str) else text)


def with_embeddings(chunks: DataFrame, text: str = "text", load=None, name: str = "hash-64") -> DataFrame:
    return chunks.withColumn("embedding", encode(text, load)).withColumn("embedding_model", F.lit(name))
