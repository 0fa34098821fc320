"""Means of points that share their neighbours; models scored on rows read once."""

from __future__ import annotations

from pyspark.sql import functions as F

from gustflow.operators import learning, spatial


def test_points_of_one_place_share_their_means(spark, monkeypatch):
    points = spark.range(300).select(F.col("id").alias("point"), F.when(F.col("id") != 7, F.col("id") % 3 * 1.0).alias("lat"), (F.col("id") % 2 * 1.0).alias("lon"))
    stations = spark.range(9).select("id", (F.col("id") % 3 * 0.9).alias("lat"), (F.col("id") / 5).alias("lon"))
    values = spark.range(9).crossJoin(spark.range(4).select(F.col("id").alias("day"))).filter("id + day <> 5").withColumn("v", F.when(F.col("id") != 4, F.col("id") * 10.0 + F.col("day")))
    near = spatial.k_nearest(points, stations, 4)
    table = lambda df: sorted((r["point"], r["day"], round(r["v"], 9)) for r in df.collect())
    wanted = table(spatial.idw(spatial.idw_weights(near, "point"), values, "point", "day", "v"))
    met: list[int] = []

    def mean(weights):
        met.append(weights.count())
        return spatial.idw(weights, values, "_place", "day", "v")

    for few in (10_000, 0):
        monkeypatch.setattr(spatial, "SHARED_PLACES", few)
        assert table(spatial.over_places(near, mean, "point", "day", "v")) == wanted
    assert met == [6 * 4, 6 * 4]  # six places, whatever the number of points


def test_zoo_reads_other_once(spark):
    rows = spark.range(60).select(F.col("id").alias("k"), (F.col("id") * 1.0).alias("x"), (F.col("id") * 3.0 + 1).alias("y"))
    found = learning.screened(rows, rows, ["x"], "y", ["linear", "tree"])
    assert found.columns == ["k", "x", "y", "model", "y_pred"] and found.groupBy("model").count().filter("count = 60").count() == 2
    assert all(abs(r["y_pred"] - r["y"]) < 1e-6 for r in found.filter("model = 'linear'").collect())
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Range (") == 1
