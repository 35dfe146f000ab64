"""Embedding texts by a pluggable model, in Arrow batches, to unit vectors."""

from __future__ import annotations

import hashlib
from typing import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A model takes a list of texts to an array with a row for each.
Model = Callable[[list[str]], np.ndarray]
DIMS = 768


def seeded(texts: list[str], dims: int = DIMS) -> np.ndarray:
    """The stand-in where no model runs: normal numbers from a generator that the text's md5 seeds, so equal texts have equal vectors."""
    return np.array([np.random.default_rng(int(hashlib.md5(t.encode()).hexdigest()[:8], 16)).standard_normal(dims) for t in texts]).reshape(len(texts), dims)


def embedded(docs: DataFrame, key: str, text: str = "text", model: Model = seeded, prefix: str = "", batch: int = 256) -> DataFrame:
    """(key, embedding array<float>): each text after ``prefix`` through ``model``, at most ``batch`` texts a call, at unit length.

    A null text is empty; a vector of length 0 stays as it is.
    """

    def run(frames):
        for pdf in frames:
            for i in range(0, len(pdf), batch):
                part = pdf.iloc[i : i + batch]
                v = np.asarray(model([prefix + t for t in part["__text"]]), float)
                n = np.linalg.norm(v, axis=1, keepdims=True)
                yield pd.DataFrame({key: part[key].to_numpy(), "embedding": list((v / np.where(n == 0, 1, n)).astype("float32"))})

    kind = dict(docs.dtypes)[key]
    return docs.select(key, F.coalesce(text, F.lit("")).alias("__text")).mapInPandas(run, f"`{key}` {kind}, embedding array<float>")
