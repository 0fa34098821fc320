"""Multi-layer perceptron regression: rounds of gradient sums over partitions.

In each round every task sums the loss's gradient over its rows and hands on one array; Spark adds the arrays up, and the
driver, which holds the weights and nothing else, takes one step. Rows are never moved.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass
class Perceptron:
    """Layers (weights, biases) with a rectifier between them, on standardised features, for a standardised target."""

    features: list[str]
    layers: list[tuple[np.ndarray, np.ndarray]]
    centre: np.ndarray
    scale: np.ndarray

    def predict(self, x: np.ndarray) -> np.ndarray:
        out = (x - self.centre[:-1]) / self.scale[:-1]
        for k, (w, b) in enumerate(self.layers):
            out = out @ w + b
            if k < len(self.layers) - 1:
                out = np.maximum(out, 0.0)
        return out[:, 0] * self.scale[-1] + self.centre[-1]


def shapes(n_features: int, hidden: Sequence[int]) -> list[tuple[int, int]]:
    sizes = [n_features, *hidden, 1]
    return list(zip(sizes[:-1], sizes[1:], strict=True))


def unpacked(flat: np.ndarray, sizes: Sequence[tuple[int, int]]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Layers of one array of all weights and biases."""
    out, at = [], 0
    for n, m in sizes:
        out.append((flat[at : at + n * m].reshape(n, m), flat[at + n * m : at + n * m + m]))
        at += n * m + m
    return out


def gradient_sum(flat: np.ndarray, sizes: Sequence[tuple[int, int]], x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Rows, sum of squared errors / 2 and its gradient by all weights, in one array."""
    layers = unpacked(flat, sizes)
    inputs = [x]
    for k, (w, b) in enumerate(layers):
        z = inputs[-1] @ w + b
        inputs.append(np.maximum(z, 0.0) if k < len(layers) - 1 else z)
    off = inputs[-1][:, 0] - y
    back, grads = off[:, None], []
    for k in range(len(layers) - 1, -1, -1):
        grads.append(np.concatenate([(inputs[k].T @ back).ravel(), back.sum(axis=0)]))
        if k:
            back = (back @ layers[k][0].T) * (inputs[k] > 0)
    return np.concatenate([[len(y), off @ off / 2], *grads[::-1]])


def fit_perceptron(
    df: DataFrame, features: Sequence[str], y: str, hidden: Sequence[int] = (64, 32), rounds: int = 200, rate: float = 0.01, penalty: float = 1e-4, seed: int = 42
) -> Perceptron:
    """The perceptron after ``rounds`` steps (Adam on the mean loss over all rows), from weights drawn with the seed.

    Rows with an unknown feature or y do not count; without rows the model predicts 0. ``df`` is read once for its means
    and once a round, so it should be cheap to read or persisted.
    """
    columns = [*features, y]
    rows = df.select(*(F.col(c).cast("double").alias(f"c{k}") for k, c in enumerate(columns)))
    known = rows.filter(" AND ".join(f"abs(c{k}) < double('infinity')" for k in range(len(columns))))
    found = known.agg(F.count("*"), *(f(f"c{k}") for f in (F.avg, F.stddev_pop) for k in range(len(columns)))).first()
    if not found[0]:
        return Perceptron(list(features), unpacked(np.zeros(len(features) + 1), shapes(len(features), ())), np.zeros(len(columns)), np.ones(len(columns)))
    centre, spread = np.array(found[1 : 1 + len(columns)]), np.array(found[1 + len(columns) :])
    scale = np.where(spread > 0, spread, 1.0)
    sizes = shapes(len(features), hidden)
    rng = np.random.default_rng(seed)
    flat = np.concatenate([np.concatenate([rng.normal(0, np.sqrt(2 / n), n * m), np.zeros(m)]) for n, m in sizes])
    decayed = np.concatenate([np.concatenate([np.ones(n * m), np.zeros(m)]) for n, m in sizes])
    first, second = np.zeros_like(flat), np.zeros_like(flat)
    for step in range(1, rounds + 1):
        weights = flat.copy()

        def summed(batches: Iterator[pd.DataFrame], weights: np.ndarray = weights) -> Iterator[pd.DataFrame]:
            total = np.zeros(len(weights) + 2)
            for batch in batches:
                z = (batch.to_numpy(float) - centre) / scale
                total += gradient_sum(weights, sizes, z[:, :-1], z[:, -1])
            yield pd.DataFrame({"g": [total]})

        parts = known.mapInPandas(summed, "g array<double>").select(F.posexplode("g").alias("k", "v")).groupBy("k").agg(F.sum("v").alias("v"))
        total = np.zeros(len(flat) + 2)
        for r in parts.collect():  # one number for each weight
            total[r["k"]] = r["v"]
        slope = total[2:] / total[0] + penalty * decayed * flat
        first, second = 0.9 * first + 0.1 * slope, 0.999 * second + 0.001 * slope**2
        flat = flat - rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    return Perceptron(list(features), unpacked(flat, sizes), centre, scale)


def scored_by_perceptron(df: DataFrame, model: Perceptron, out: str = "y_pred") -> DataFrame:
    """df with the model's prediction; null where a feature is unknown."""
    sent = df.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def predicted(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        for columns in batches:
            x = np.column_stack([c.to_numpy(float) for c in columns])
            yield pd.Series(np.where(np.isfinite(x).all(axis=1), sent.value.predict(x), np.nan)).astype("Float64").where(np.isfinite(x).all(axis=1))

    return df.withColumn(out, predicted(*(F.col(c).cast("double") for c in model.features)))
