"""The perceptron: slopes by differences, a curve learned, the same weights under any partitioning."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from gustflow.operators import mlp


def test_gradient_is_that_of_differences():
    rng = np.random.default_rng(0)
    sizes = mlp.shapes(3, (5, 4))
    flat = rng.normal(size=sum(n * m + m for n, m in sizes))
    x, y = rng.normal(size=(20, 3)), rng.normal(size=20)
    found = mlp.gradient_sum(flat, sizes, x, y)
    assert found[0] == 20
    for k in range(len(flat)):
        step = np.zeros_like(flat)
        step[k] = 1e-6
        up, down = (mlp.gradient_sum(flat + s, sizes, x, y)[1] for s in (step, -step))
        assert found[2 + k] == pytest.approx((up - down) / 2e-6, abs=1e-4)
    halves = mlp.gradient_sum(flat, sizes, x[:7], y[:7]) + mlp.gradient_sum(flat, sizes, x[7:], y[7:])
    assert np.allclose(found, halves)


def test_a_curve_is_learned_under_any_partitioning(spark):
    x = np.linspace(-3, 3, 400)
    rows = [(float(v), float(k % 3), float(abs(v) * 10 + 5 * (k % 3))) for k, v in enumerate(x)] + [(None, 1.0, 1.0), (1.0, 1.0, float("nan"))]
    df = spark.createDataFrame(rows, "a double, b double, y double").persist()
    model = mlp.fit_perceptron(df.repartition(3), ["a", "b"], "y", (8,), rounds=60, rate=0.05)
    scored = mlp.scored_by_perceptron(df, model)
    rmse = scored.filter("a IS NOT NULL AND NOT isnan(y)").agg(F.sqrt(F.avg(F.pow(F.col("y") - F.col("y_pred"), 2)))).first()[0]
    assert rmse < 2.5  # a straight line leaves 9
    assert scored.filter("a IS NULL").first()["y_pred"] is None
    again = mlp.fit_perceptron(df.repartition(1), ["a", "b"], "y", (8,), rounds=60, rate=0.05)
    for (w, b), (v, c) in zip(model.layers, again.layers, strict=True):
        assert np.allclose(w, v, atol=1e-6) and np.allclose(b, c, atol=1e-6)
    none = mlp.fit_perceptron(df.filter("false"), ["a", "b"], "y", (8,))
    assert none.predict(np.array([[1.0, 2.0]])).tolist() == [0.0]
