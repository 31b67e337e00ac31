"""Embedding and dot-product helpers."""
from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

Encoder = Callable[[list[str]], np.ndarray]

BATCH = 64


def summed_words(texts: list[list[str]], place: Callable[[str], int], dim: int) -> np.ndarray:
    """Signed counts of the words of each text; ``place`` gives ``2 * position``, one more for a plus."""
    at = np.array([place(word) for words in texts for word in words], np.int64)
    rows = np.repeat(np.arange(len(texts)), [len(words) for words in texts])
    signs = (at & 1) * 2 - 1
    return np.bincount(rows * dim + (at >> 1), signs, len(texts) * dim).reshape(len(texts), dim).astype(np.float32)


@lru_cache(1 << 17)
def _crc_place(word: str, dim: int) -> int:
    h = zlib.crc32(word.encode("utf-8"))
    return h % dim * 2 + ((h >> 16) & 1)


def hashing_encoder(texts: list[str], dim: int = 384) -> np.ndarray:
    """Deterministic stand-in encoder: hashed, signed word counts.

    Replace it with any callable from texts to a matrix (a sentence encoder).
    """
    return summed_words([t.lower().split() for t in texts], lambda w: _crc_place(w, dim), dim)


def unit_rows(matrix: np.ndarray) -> np.ndarray:
    norms = np.linalg.norm(matrix, axis=1, keepdims=True)
    return (matrix / np.where(norms == 0, 1.0, norms)).astype(np.float32)


def encoded_parts(batches: Iterator[pa.Array], encoder: Encoder, batch_size: int) -> Iterator[pa.Array]:
    """Vectors of each batch; only ``batch_size`` texts and vectors are unpacked at once."""
    for texts in batches:
        for at in range(0, len(texts), batch_size):
            rows = unit_rows(np.asarray(encoder([t or "" for t in texts[at : at + batch_size].to_pylist()])))
            ends = pa.array(np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1])
            yield pa.ListArray.from_arrays(ends, pa.array(rows.ravel()))
        if not len(texts):
            yield pa.array([], pa.list_(pa.float32()))


def embed(text: Column, encoder: Encoder = hashing_encoder, batch_size: int = BATCH) -> Column:
    """Unit-length float vectors, encoded ``batch_size`` texts at a time."""

    @F.arrow_udf(ArrayType(FloatType()))
    def encoded(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        yield from encoded_parts(batches, encoder, batch_size)

    return encoded(text)


def dot(a: Column, b: Column) -> Column:
    """Inner product in double precision."""
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)


def stacked(column: pd.Series) -> np.ndarray:
    """Matrix of a column of vectors."""
    return np.stack(column.to_numpy()).astype(np.float64)
