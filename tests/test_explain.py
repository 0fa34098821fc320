"""Contributions of trees against all subsets of features; losses by name; functions called from SQL."""

from __future__ import annotations

import datetime as dt
import itertools
import math

import numpy as np
import pytest
from pyspark.ml.regression import DecisionTreeRegressor, GBTRegressor, RandomForestRegressor
from pyspark.sql import functions as F

from gustflow.functions import losses
from gustflow.functions.sql import register_sql
from gustflow.operators import explain as E
from gustflow.operators import learning as L

NAMES = ["a", "b", "c", "d"]


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(300, 4)).round(1)
    y = x[:, 0] * 3 + np.where(x[:, 1] > 0, 5, -2) * x[:, 2] + rng.normal(size=300) * 0.1
    rows = [(k, "DJF" if k % 2 else "JJA", *map(float, x[k]), float(y[k])) for k in range(300)]
    return spark.createDataFrame(rows, "k int, season string, a double, b double, c double, d double, y double")


def expected(node, x, known):
    """A tree's prediction with only some features known: by parts of the training rows elsewhere."""
    if node.getClass().getSimpleName() != "InternalNode":
        return node.prediction()
    f, cut = node.split().featureIndex(), node.split().threshold()
    left, right = node.leftChild(), node.rightChild()
    if f in known:
        return expected(left if x[f] <= cut else right, x, known)
    n, m = left.impurityStats().count(), right.impurityStats().count()
    return (n * expected(left, x, known) + m * expected(right, x, known)) / (n + m)


@pytest.mark.parametrize("kind", ["tree", "forest", "boosted"])
def test_contributions_are_those_of_all_subsets(spark, table, kind):
    made = {"tree": DecisionTreeRegressor(maxDepth=5), "forest": RandomForestRegressor(numTrees=3, maxDepth=3, seed=1), "boosted": GBTRegressor(maxIter=3, maxDepth=3, seed=1)}[kind]
    data = L.assembled(table, NAMES)
    model = made.setLabelCol("y").setPredictionCol("p").fit(data)
    odd = spark.createDataFrame([(900, "DJF", None, 1.0, 1.0, 1.0, 0.0)], table.schema).withColumn("p", F.lit(0.0))
    scored = model.transform(data).select(*table.columns, "p")
    explained = E.checked_additive(E.tree_contributions(scored.unionByName(odd), model, NAMES), "p", close=1e-9)
    got = {r["k"]: r for r in explained.collect()}
    assert got.pop(900)["contributions"] is None and len(got) == 300
    trees = [model] if kind == "tree" else model.trees
    weights = [1.0] if kind == "tree" else [1 / 3] * 3 if kind == "forest" else model.treeWeights
    value = lambda x, known: sum(w * expected(t._java_obj.rootNode(), x, known) for w, t in zip(weights, trees, strict=True))
    for k in (0, 7, 123):
        r = got[k]
        x = [r[c] for c in NAMES]
        assert r["base"] == pytest.approx(value(x, ()), abs=1e-9)
        for i in range(4):
            others = [j for j in range(4) if j != i]
            want = sum(
                math.factorial(n) * math.factorial(3 - n) / 24 * (value(x, (*s, i)) - value(x, s)) for n in range(4) for s in itertools.combinations(others, n)
            )
            assert r["contributions"][i] == pytest.approx(want, abs=1e-9)
    shares = E.group_shares(explained, NAMES, {"a": "wind", "b": "wind", "c": "rest", "d": "rest"}, ["season"])
    for season in ("DJF", "JJA"):
        some = np.array([r["contributions"] for r in got.values() if r["season"] == season])
        wind, rest = np.abs(some[:, :2].sum(axis=1)).mean(), np.abs(some[:, 2:].sum(axis=1)).mean()
        found = {r["group"]: r["share"] for r in shares.filter(F.col("season") == season).collect()}
        assert found == {"wind": pytest.approx(100 * wind / (wind + rest)), "rest": pytest.approx(100 * rest / (wind + rest))}
    ranges = {r["group"]: (r["least"], r["greatest"]) for r in E.share_ranges(shares).collect()}
    assert all(lo <= hi for lo, hi in ranges.values()) and set(ranges) == {"wind", "rest"}
    with pytest.raises(Exception, match="add up"):
        E.checked_additive(explained.withColumn("p", F.col("p") + 1), "p").collect()


def test_losses_by_name(spark):
    df = spark.createDataFrame([(1.0, 3.0), (5.0, 1.0), (2.0, 2.5)], "y double, p double")
    mean = lambda f: df.agg(F.avg(f(F.col("y"), F.col("p")))).first()[0]
    assert mean(losses.build("mse")) == pytest.approx((4 + 16 + 0.25) / 3) and mean(losses.build("mae")) == pytest.approx(6.5 / 3)
    assert mean(losses.build("huber", delta=1.0)) == pytest.approx((1.5 + 3.5 + 0.125) / 3)
    assert mean(losses.build("pinball", tau=0.9)) == pytest.approx((0.2 + 3.6 + 0.05) / 3)
    both = losses.build("combined", components=[{"name": "mae", "weight": 2}, {"name": "pinball", "tau": 0.9, "weight": 0.5}])
    assert mean(both) == pytest.approx((2 * 6.5 + 0.5 * 3.85) / 3)
    with pytest.raises(ValueError, match="not registered"):
        losses.build("other")

    @losses.loss("signed")
    def _signed():
        return lambda y, p: p - y

    assert "signed" in losses.available() and mean(losses.build("signed")) == pytest.approx(-1.5 / 3)
    losses._LOSSES.pop("signed")


def test_functions_are_called_from_sql(spark):
    register_sql(spark)
    register_sql(spark)  # again, in the same session
    one = spark.sql("SELECT wind_speed(3, 4) AS a, wind_from(0, -1) AS b, wind_from(1, 0) AS c, season_of(DATE '2020-12-01') AS d, pinball_loss(5, 1, 0.9) AS e, huber_loss(5, 1, 1) AS f, season_of(NULL) AS g").first()
    assert tuple(one) == (5.0, pytest.approx(0.0), pytest.approx(270.0), "DJF", pytest.approx(3.6), pytest.approx(3.5), None)
    days = [(s, dt.date(2020, 1, d), float(d)) for s, ds in (("x", (1, 2, 4, 5, 9)), ("y", (3, 4))) for d in ds]
    spark.createDataFrame(days, "s string, day date, v double").createOrReplaceTempView("days_of_test")
    runs = spark.sql("SELECT * FROM day_runs(TABLE(SELECT s, day FROM days_of_test) PARTITION BY s ORDER BY day)").collect()
    assert sorted((r["key"], r["day"].day, r["run"]) for r in runs) == [("x", 1, 0), ("x", 2, 0), ("x", 4, 1), ("x", 5, 1), ("x", 9, 2), ("y", 3, 0), ("y", 4, 0)]
    back = spark.sql("SELECT * FROM lookback(2, TABLE(SELECT s, day, v FROM days_of_test) PARTITION BY s ORDER BY day)").collect()
    assert sorted((r["key"], tuple(r["window"])) for r in back) == [("x", (1.0, 2.0)), ("x", (2.0, 4.0)), ("x", (4.0, 5.0)), ("x", (5.0, 9.0)), ("y", (3.0, 4.0))]


def test_day_runs_take_batches(spark):
    """Rows pass the table function by batches, and a key's run goes on from one batch to the next."""
    register_sql(spark)
    rows = [(k, dt.date(2020, 1, 1) + dt.timedelta(days=d + d // 5)) for k in (7, 8) for d in range(40)] + [(9, None), (9, dt.date(2020, 1, 1)), (9, dt.date(2020, 1, 2)), (None, dt.date(2020, 1, 1))]
    spark.createDataFrame(rows, "k bigint, day date").createOrReplaceTempView("batches_of_test")
    held = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        found = spark.sql("SELECT * FROM day_runs(TABLE(SELECT k, day FROM batches_of_test) PARTITION BY k ORDER BY day)")
        assert "ArrowEvalPythonUDTF" in found._jdf.queryExecution().executedPlan().toString()
        got = {(r["key"], r["day"]): r["run"] for r in found.collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", held)
    assert len(got) == len(rows) and all(got[(str(k), day)] == (day - dt.date(2020, 1, 1)).days // 6 for k, day in rows[:80])
    assert all(got[(None if k is None else str(k), day)] == 0 for k, day in rows[80:])
