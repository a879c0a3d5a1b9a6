"""Batch scoring of images (or their features) with a pluggable multi-head classifier."""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import types as T

from fieldstate import schema as S
from fieldstate.functions import vectors as V

# functions of this module travel to the workers with the job
cloudpickle.register_pickle_by_value(sys.modules[__name__])

Model = Callable[[pd.DataFrame], list[np.ndarray]]


def score_images(
    df: DataFrame,
    load_model: Callable[[], Model],
    inputs: list[str],
    keys: list[str],
    heads: tuple[str, ...] = S.CATEGORIES,
    batch: int = S.SCORE_BATCH,
    digits: int = S.SCORE_DIGITS,
) -> DataFrame:
    """(keys, one probability vector per head, rounded to ``digits``).

    Only ``keys`` and ``inputs`` travel to Python, and only ``keys`` and heads come back.

    ``load_model`` runs once per task and returns a function from a frame of at most ``batch`` rows (the
    ``inputs`` columns) to one (rows, classes) matrix per head. Rows are scored where they are; nothing is shuffled.
    """
    heads = tuple(heads)
    needed = df.select(*keys, *[c for c in inputs if c not in keys])
    fields = [df.schema[k] for k in keys] + [T.StructField(h, T.ArrayType(T.DoubleType())) for h in heads]

    def score(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = load_model()
        for frame in frames:
            for start in range(0, len(frame), batch):
                part = frame.iloc[start : start + batch]
                matrices = model(part[inputs])
                scored = {h: list(np.round(np.asarray(m, dtype=np.float64), digits)) for h, m in zip(heads, matrices)}
                yield part[keys].assign(**{h: pd.Series(v, index=part.index) for h, v in scored.items()})

    return needed.mapInPandas(score, T.StructType(fields))


def argmax_label(vector: str) -> Column:
    """Class code of the highest probability, the first on a tie."""
    return V.first_top_code(vector)


def linear_softmax(column: str, weights: Callable[[int], list[np.ndarray]]) -> Callable[[], Model]:
    """A fixed multi-head model over a feature column: softmax of a linear map per head.

    ``weights`` gives one (classes, features) matrix per head for a number of features.
    """

    def load() -> Model:
        def predict(frame: pd.DataFrame) -> list[np.ndarray]:
            x = np.stack(frame[column].to_numpy()).astype(np.float64)
            out = []
            for w in weights(x.shape[1]):
                z = x @ w.T
                e = np.exp(z - z.max(axis=1, keepdims=True))
                out.append(e / e.sum(axis=1, keepdims=True))
            return out

        return predict

    return load
