"""Vector distances and a seeded embedder for callers without a model."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def l2(a: Column, b: Column) -> Column:
    terms = F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double")))
    return F.sqrt(F.aggregate(terms, F.lit(0.0), lambda acc, t: acc + t))


def hashing_embedder(dim: int = 64, seed: int = 0) -> Callable[[list[str]], np.ndarray]:
    """Unit vectors from hashed words: deterministic, needs no model file."""

    def encode(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), dim), dtype=np.float32)
        for row, text in enumerate(texts):
            for word in text.lower().split():
                h = zlib.crc32(word.encode(), seed)
                out[row, h % dim] += 1.0 if h & 0x80000000 else -1.0
        norms = np.linalg.norm(out, axis=1, keepdims=True)
        return out / np.where(norms == 0, 1, norms)

    return encode


def embed_column(text: Column, make_encoder: Callable[[], Callable[[list[str]], np.ndarray]]) -> Column:
    """Encode a text column; ``make_encoder`` runs once per task, so models load once."""

    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encoder = make_encoder()
        for texts in batches:
            vectors = encoder(texts.fillna("").tolist())
            yield pd.Series([v.astype(np.float32) for v in vectors])

    return encode(text)
