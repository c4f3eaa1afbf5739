"""Text encoders: the seam for a sentence model, and hashed words where there is none."""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def hashed_words(texts: list[str], width: int = 256) -> np.ndarray:
    """Counts of lower-cased words by hash, as unit rows; a text without words is a zero row."""
    out = np.zeros((len(texts), width))
    for row, text in zip(out, texts, strict=True):
        places = [zlib.crc32(w.encode()) % width for w in re.findall(r"\w+", text.lower())]
        row += np.bincount(places, minlength=width) if places else 0
    size = np.sqrt((out * out).sum(1, keepdims=True))
    return out / np.where(size > 0, size, 1)


def with_encoder(df: DataFrame, text: str, out: str, load: Callable[[], Callable[[list[str]], np.ndarray]] = lambda: hashed_words) -> DataFrame:
    """df with vectors from a model; load runs once per task and returns a function from texts to a matrix. By default words are hashed."""

    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load()
        for texts in batches:
            yield pd.Series(list(model(texts.fillna("").tolist()).astype(np.float32)))

    return df.withColumn(out, encode(text))
