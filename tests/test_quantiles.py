"""Exact quantiles without a group's values in one task."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gustflow.operators import metrics, quantiles, reports


@pytest.fixture(scope="module")
def rows(spark):
    random.seed(3)
    made = [("many", random.gauss(0, 1), float(random.randint(0, 9))) for _ in range(30_000)]
    made += [("ties", float(random.randint(0, 2)), None) for _ in range(5_000)] + [(None, float(k), 1.0) for k in range(7)]
    made += [("one", 4.0, 2.0), ("none", None, None), ("odd", float("inf"), 0.0), ("odd", float("-inf"), 0.0), ("odd", 3.0, 5.0), ("two", 1.0, 1.0), ("two", 2.0, 1.0)]
    random.shuffle(made)
    return spark.createDataFrame(made, "g string, a double, b double").repartition(5).persist()


@pytest.mark.parametrize("accuracy, qs", [(5_000, [0.9, 0.95, 0.99]), (50, [0.45, 0.4501, 0.0, 1.0]), (5_000, [k / 99 for k in range(100)])])
def test_as_percentile(rows, monkeypatch, qs, accuracy):
    monkeypatch.setattr(quantiles, "ACCURACY", accuracy)
    monkeypatch.setattr(quantiles, "ACCURACY_OF_ALL", accuracy)
    at = F.array(*map(F.lit, qs))
    for by, df in ((["g"], rows), ([], rows), ([], rows.filter("false"))):
        wanted = df.groupBy(*by).agg(F.percentile("a", at).alias("a"), F.percentile("b", at).alias("b")).collect()
        assert sorted(map(str, quantiles.quantiles(df, by, ["a", "b"], qs).collect())) == sorted(map(str, wanted))


def test_missed_cuts_are_seen(rows, monkeypatch):
    """Cuts that enclose no wanted rank: the result is the same."""
    monkeypatch.setattr(quantiles, "_brackets", lambda qs, far: [0.1, 0.11])
    got = {r["g"]: r["a"] for r in quantiles.quantiles(rows, ["g"], ["a"], [0.5, 0.77]).collect()}
    values = [r["a"] for r in rows.filter("g = 'many'").collect()]
    assert np.allclose(got["many"], np.quantile(values, [0.5, 0.77])) and got["one"] == [4.0, 4.0]


def test_place_is_a_count(spark):
    df = spark.range(60).select((F.col("id") / 2).alias("v"), F.array(*(F.lit(float(k // 2)) for k in range(40))).alias("cuts"))
    for n in (5, 40):
        for inclusive in (False, True):
            some = df.withColumn("cuts", F.slice("cuts", 1, n)).select("v", quantiles.place("cuts", n, F.col("v"), inclusive).alias("at"))
            for r in some.collect():
                assert r["at"] == sum(k // 2 <= r["v"] if inclusive else k // 2 < r["v"] for k in range(n))


def test_tails_hold_no_group_in_one_task(rows):
    """No exact percentile over rows is left in the plan of a metric by groups."""
    df = rows.select("g", F.col("a").alias("y"), F.col("b").alias("p"))
    found = metrics.core_metrics(df, ["g"], "y", "p")
    assert "percentile(" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_markers_hold_no_group_in_one_task(rows):
    """No exact percentile over a histogram's rows is left; groups whose key is null stay."""
    bars = reports.histogram(rows.filter("g IS NULL OR g != 'odd'"), ["g"], "a", q=0.7)
    assert "percentile(" not in bars._jdf.queryExecution().optimizedPlan().toString()
    markers = rows.filter("a IS NOT NULL AND (g IS NULL OR g != 'odd')").groupBy("g").agg(F.percentile("a", F.lit(0.7))).collect()
    assert sorted(str(tuple(r)) for r in bars.select("g", "marker").distinct().collect()) == sorted(str(tuple(r)) for r in markers)
