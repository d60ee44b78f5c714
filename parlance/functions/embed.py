"""Embedding hook: any function of a text column to a vector column; here an offline stand-in without a model."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def hashing_embedder(size: int = 64) -> Callable[[Column], Column]:
    """Words hashed to signed places of a unit vector. It says nothing about meaning."""

    @F.pandas_udf("array<double>")
    def embed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            out = []
            for text in texts:
                v = np.zeros(size)
                for word in (text or "").lower().split():
                    h = crc32(word.encode())
                    v[h % size] += 1 if h >> 31 else -1
                out.append((v / (np.linalg.norm(v) or 1)).tolist())
            yield pd.Series(out)

    return embed
