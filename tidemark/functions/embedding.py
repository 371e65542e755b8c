"""Embedders: a small protocol, a deterministic default, and the column form."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class Embedder(Protocol):
    name: str
    dimension: int

    def embed_batch(self, texts: list[str]) -> np.ndarray: ...


class HashEmbedder:
    """Deterministic float32 vector from character codes.

    Position i holds ``(code + i * 0.001) mod 1``; positions beyond the text
    hold ``(byte length * (i + 1) * 0.001) mod 1``, every step in float32.
    """

    name = "hash"

    def __init__(self, dimension: int = 1536):
        self.dimension = dimension

    def embed_batch(self, texts: list[str]) -> np.ndarray:
        thousandth, one = np.float32(0.001), np.float32(1.0)
        at = np.arange(self.dimension, dtype=np.int64)
        ramp = at.astype(np.float32) * thousandth
        out = np.empty((len(texts), self.dimension), dtype=np.float32)
        for row, text in zip(out, texts):
            size = len(text.encode())
            np.mod((size * (at + 1)).astype(np.float32) * thousandth, one, out=row)
            codes = np.frombuffer(text[: self.dimension].encode("utf-32-le"), dtype=np.uint32)
            n = len(codes)
            row[:n] = np.mod(codes.astype(np.float32) + ramp[:n], one)
        return out


def batch_vectors(batches: Iterator[pd.Series], model: Embedder, batch_size: int) -> Iterator[pd.Series]:
    """Vectors of the texts, ``batch_size`` at a time: a batch of vectors goes on before the next is made."""
    for texts in batches:
        for i in range(0, len(texts), batch_size):
            some = texts.iloc[i : i + batch_size]
            vectors = model.embed_batch(some.fillna("").tolist())
            yield pd.Series([vector.astype(np.float32) for vector in vectors], index=some.index, dtype=object)


def embed(
    df: DataFrame, embedder: Embedder | None = None, text: str = "content", out: str = "embedding", batch_size: int = 256
) -> DataFrame:
    """Add an ``array<float>`` column; the embedder is called with whole batches."""
    model = embedder or HashEmbedder()

    @F.pandas_udf("array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        yield from batch_vectors(batches, model, batch_size)

    return df.withColumn(out, run(F.col(text)))


def hash_embed(df: DataFrame, dim: int = 1536, text: str = "text", out: str = "embedding") -> DataFrame:
    return embed(df, HashEmbedder(dim), text, out)
