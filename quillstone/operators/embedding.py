"""Vectors of texts by a pluggable embedder; the one at hand hashes character trigrams."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, FloatType, StructField, StructType

#: Texts to vectors of one length.
Embedder = Callable[[list[str]], list[list[float]]]
WIDTH = 256


def hashed_trigrams(texts: list[str]) -> list[list[float]]:
    """Counts of hashed trigrams of the lower-cased words, damped, of length 1. Deterministic, without a service."""
    out = []
    for text in texts:
        v = np.zeros(WIDTH)
        for word in (text or "").lower().split():
            for k in range(len(word)):
                v[zlib.crc32(f" {word} "[k : k + 3].encode()) % WIDTH] += 1
        v = np.sqrt(v)
        out.append((v / (np.linalg.norm(v) or 1)).tolist())
    return out


def embed(rows: DataFrame, text_col: str, embedder: Embedder = hashed_trigrams, out: str = "embedding") -> DataFrame:
    """Adds the vector of a text; the embedder runs in the executors, on batches."""
    def batches(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            yield pdf.assign(**{out: embedder(pdf[text_col].fillna("").tolist())})

    return rows.mapInPandas(batches, StructType([*rows.schema.fields, StructField(out, ArrayType(FloatType()))]))
