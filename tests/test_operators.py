"""Operators on small hand-made tables: ties, nulls, gaps, errors."""

from __future__ import annotations

import datetime as dt
import math

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from gustflow.operators import features as X
from gustflow.operators import inference as I
from gustflow.operators import learning as L
from gustflow.operators import metrics as M
from gustflow.operators import relations as R
from gustflow.operators import selection as S
from gustflow.operators import spatial as G
from gustflow.operators import windows as W
from gustflow.plans import study
from gustflow.sources import scan, sink
from gustflow.streaming import daily

D = dt.date


def day(k):
    return D(2020, 1, 1) + dt.timedelta(days=k)


@pytest.fixture(scope="module")
def gaps(spark):
    rows = [(s, day(k), None if k == 2 else float(10 * s + k)) for s in (1, 2) for k in range(10) if k != 5]
    return spark.createDataFrame(rows, "station int, day date, v double")


def test_densify_then_lag(gaps):
    d = W.densify(gaps, "station", "day")
    assert d.count() == 20
    got = {r["day"]: r["l"] for r in d.withColumn("l", W.lagged("v", 1, "station", "day")).filter("station = 1").collect()}
    assert got[day(6)] is None and got[day(7)] == 16.0 and got[day(3)] is None
    with pytest.raises(ValueError):
        W.assert_gap_free(gaps, "station", "day")
    assert W.assert_gap_free(d, "station", "day").count() == 20


def test_rolling_needs_enough(gaps):
    d = W.densify(gaps, "station", "day").filter("station = 1")
    got = [r["m"] for r in d.withColumn("m", W.rolling_mean("v", 3, 2, "station", "day")).orderBy("day").collect()]
    assert got[0] is None and got[1] == 10.5 and got[2] == 10.5 and got[3] == pytest.approx(12.0)


def test_lookback_edge_and_purge(spark):
    df = spark.createDataFrame([(1, day(k), float(k), "train" if k < 4 else "test") for k in range(6)], "s int, day date, v double, label string")
    edge = {r["day"]: [x["v"] for x in r["window"]] for r in W.lookback(df, "s", "day", ["v"], 3, "edge").collect()}
    assert edge[day(0)] == [0.0, 0.0, 0.0] and edge[day(1)] == [0.0, 0.0, 1.0] and edge[day(5)] == [3.0, 4.0, 5.0]
    kept = {r["day"] for r in W.lookback(df, "s", "day", ["v"], 2, label="label").collect()}
    assert kept == {day(1), day(2), day(3), day(5)}


def test_peak_takes_the_earliest_of_equals(spark):
    rows = [(1, dt.datetime(2020, 1, 1, h), 5.0 if h in (3, 7) else 1.0) for h in range(24)] + [(2, dt.datetime(2020, 1, 1, h), None if h == 4 else 1.0) for h in range(24)]
    df = spark.createDataFrame(rows, "s int, ts timestamp_ntz, v double")
    got = X.peak_rows(df, ["s"], "ts", "v", hours=24).collect()
    assert [(r["s"], r["ts"].hour) for r in got] == [(1, 3)]
    twice = df.filter("s = 1").unionByName(df.filter("s = 1").limit(1))
    with pytest.raises(PySparkException, match="an hour comes twice"):
        X.peak_rows(twice, ["s"], "ts", "v", hours=24).collect()
    assert X.peak_rows(twice, ["s"], "ts", "v").count() == 1
    assert [(r["s"]) for r in X.complete_days(df, ["s"], "ts", "v").collect()] == [1]


def test_metrics_known(spark):
    df = spark.createDataFrame([("a", 1.0, 2.0), ("a", 3.0, 3.0), ("b", 5.0, 5.0), ("b", 5.0, 6.0), ("b", None, 1.0)], "g string, y double, p double")
    got = {r["g"]: r for r in M.core_metrics(df, ["g"], "y", "p").collect()}
    assert got["a"]["n"] == 2 and got["a"]["rmse"] == pytest.approx(math.sqrt(0.5)) and got["a"]["r2"] == pytest.approx(0.5)
    assert got["b"]["r2"] is None and got["b"]["bias"] == 0.5
    assert M.core_metrics(df.filter("false"), ["g"], "y", "p").count() == 0


def test_harmonics_recover_a_curve(spark):
    rows = [(1, D(2019, 1, 1) + dt.timedelta(days=k)) for k in range(365)] + [(2, day(0))]
    df = spark.createDataFrame(rows, "s int, day date")
    t = 2 * F.pi() * (F.dayofyear("day") - 1) / 365.25
    made = X.harmonic_climatology(df.withColumn("y", 5 + 2 * F.cos(t) - F.sin(2 * t)), "s", "day", "y")
    got = {(r["s"], r["doy"]): r["clim"] for r in made.collect()}
    assert got[1, 1] == pytest.approx(7.0) and got[2, 1] is None and len(got) == 732


def test_bilinear_is_exact_on_planes_and_falls_back(spark):
    grid = spark.createDataFrame([(i, j, None if (i, j) == (2, 2) else 2.0 * i + 3.0 * j) for i in range(4) for j in range(5)], "i int, j int, v double")
    pts = spark.createDataFrame([(1, 0.25, 1.5), (2, 3.0, 4.0), (3, 9.0, 0.0), (4, 1.9, 1.6)], "id int, lat double, lon double")
    got = {r["id"]: r["v"] for r in G.bilinear_values(pts, grid, "id", (0.0, 1.0, 4), (0.0, 1.0, 5), "v").collect()}
    assert got[1] == pytest.approx(5.0) and got[2] == pytest.approx(18.0) and got[3] is None and got[4] is None


def test_polygons_leave_out_their_edges(spark):
    ring = [(0.0, 0.0), (2.0, 0.0), (2.0, 2.0), (0.0, 2.0), (0.0, 0.0)]
    polygons = spark.createDataFrame([(7, ring)], "id int, ring array<struct<x: double, y: double>>")
    pts = spark.createDataFrame([(1.0, 1.0), (2.0, 1.0), (3.0, 3.0)], "x double, y double")
    assert [r["cluster"] for r in G.assign_polygon(pts, polygons, "x", "y").orderBy("x").collect()] == [7, -1, -1]


def test_polygons_by_cells_are_those_by_array(spark):
    rng = np.random.default_rng(3)
    shapes = []
    for n in range(60):
        (x, y), w = rng.uniform(-50, 50, 2), 10 ** rng.uniform(-3, 1.5)
        corners = [(x, y), (x + w, y), (x + w, y + w / 3), (x + w / 2, y + w), (x, y + w / 2), (x, y)]
        shapes.append((n, [(float(a), float(b)) for a, b in corners]))
    polygons = spark.createDataFrame(shapes, "id int, ring array<struct<x: double, y: double>>")
    at = [(n, float(a), float(b)) for n, (a, b) in enumerate(rng.uniform(-60, 60, (400, 2)))] + [(1000, None, 1.0), (1001, -999.0, 0.0)]
    at += [(2000 + n, ring[0][0] + 1e-4, ring[0][1] + 1e-4) for n, ring in shapes] * 2
    pts = spark.createDataFrame(at, "n int, x double, y double")
    found = [sorted(map(tuple, G.assign_polygon(pts, polygons, "x", "y", limit=limit).select("n", "cluster").collect())) for limit in (100, 0)]
    assert found[0] == found[1] and len(found[0]) == len(at) and len(set(found[0])) > 60
    assert [r["cluster"] for r in G.assign_polygon(pts.limit(2), polygons.filter("false"), "x", "y").collect()] == [-1, -1]


def nearest_of(place, stations, k):
    return sorted((math.sqrt((s[1] - place[0]) ** 2 + (s[2] - place[1]) ** 2), s[0]) for s in stations if None not in s)[:k]


def test_k_nearest_by_cells_are_those_of_brute_force(spark):
    rng = np.random.default_rng(5)
    city = [(n, 10 + float(a) * 1e-4, 10 + float(b) * 1e-4) for n, (a, b) in enumerate(rng.uniform(0, 1, (150, 2)))]
    land = [(200 + n, float(a), float(b)) for n, (a, b) in enumerate(rng.uniform(-40, 40, (50, 2)))]
    copies = [(300 + n, 1.5, 2.5) for n in range(40)] + [(400, None, 1.0), (300, 1.5, 2.5)]
    held = city + land + copies
    places = [(float(a), float(b)) for a, b in rng.uniform(-60, 60, (60, 2))] + [(10.00005, 10.00005), (1.5, 2.5), (1.5, 2.5), (10.0, 10.4), (4000.0, -900.0)]
    pts = spark.createDataFrame([(n, *p) for n, p in enumerate(places)] + [(999, None, 0.0)], "n int, lat double, lon double")
    stations = spark.createDataFrame(held, "id int, lat double, lon double")
    for k, limit in ((1, 0), (7, 0), (7, 1000), (500, 0)):
        found = {r["n"]: [(round(s["d"], 9), s["id"]) for s in r["near"]] for r in G.k_nearest(pts, stations, k, limit=limit).collect()}
        assert found.pop(999) == []
        assert found == {n: [(round(d, 9), s) for d, s in nearest_of(p, set(held), k)] for n, p in enumerate(places)}
    for limit in (0, 1000):
        assert [r["near"] for r in G.k_nearest(pts.limit(2), stations.filter("false"), 2, limit=limit).collect()] == [[], []]


def test_idw_of_valid_stations_is_that_of_brute_force(spark):
    rng = np.random.default_rng(6)
    held = [(n, float(a), float(b)) for n, (a, b) in enumerate(rng.uniform(0, 5, (30, 2)))]
    values = [(s[0], day(d), float(rng.uniform(0, 9)) if rng.uniform() < 0.4 else None) for s in held for d in range(3)]
    places = [(1, 0.5, 0.5), (2, 4.0, 1.0), (3, held[0][1], held[0][2]), (4, 0.5, 0.5)]
    got = G.idw_valid_only(
        spark.createDataFrame(places, "p int, lat double, lon double"),
        spark.createDataFrame(values, "id int, day date, v double"),
        spark.createDataFrame(held, "id int, lat double, lon double"), "p", "day", "v", 4,
    )
    wanted = {}
    for p, *at in places:
        for d in range(3):
            v = {i: x for i, when, x in values if when == day(d) and x is not None}
            near = [(1 / max(away, 1e-10) ** 2, v[i]) for away, i in nearest_of(at, [s for s in held if s[0] in v], 4)]
            wanted[p, day(d)] = round(sum(w * x for w, x in near) / sum(w for w, _ in near), 9)
    assert {(r["p"], r["day"]): round(r["v"], 9) for r in got.collect()} == wanted


def test_idw_directions_cross_north(spark):
    w = spark.createDataFrame([(1, 1, 1.0), (1, 2, 1.0)], "point int, id int, w double")
    v = spark.createDataFrame([(1, day(0), 350.0), (2, day(0), 10.0), (2, day(1), None)], "id int, day date, d double")
    got = G.idw_direction(w, v, "point", "day", "d").first()["d"]
    assert min(got, 360 - got) < 1e-6


def test_smoothing_keeps_a_constant(spark):
    grid = spark.createDataFrame([(1, i, j, 4.0) for i in range(5) for j in range(6)], "day int, i int, j int, v double")
    assert all(r["v"] == pytest.approx(4.0) for r in G.smoothed(grid, ["day"], "v", 5, 6).collect())


def test_events_bridge_and_chunk(spark):
    active = {3, 4, 6, 15}
    rows = [(s, day(k), 10.0 + k / 100 if k in active else k / 100) for s in (1, 2, 3) for k in range(20)]
    df = spark.createDataFrame(rows, "s int, day date, v double")
    got = {r["day"]: r["event"] for r in W.event_days(df, "s", "day", "v", k=2, q=0.8).collect()}
    assert got[day(3)] == got[day(5)] == got[day(6)] and got[day(7)].startswith("quiet") and got[day(7)] != got[day(14)]


def test_fallback_names_the_best(spark):
    s = spark.createDataFrame([("c", "p", "x", 1.0), ("c", "q", "x", 2.0)], "cluster string, pipeline string, arm string, rmse double")
    ok = spark.createDataFrame([("q", "x")], "pipeline string, arm string")
    r = S.winners_with_fallback(s, ok, ["cluster"], "rmse", ["pipeline", "arm"]).first()
    assert r["pipeline"] == "q" and r["fallback_from"] == "p/x"


def test_top_models_by_validation_with_their_twins_and_test_scores(spark):
    nan = float("nan")
    val = [("m1", 0.90, 1.0, 0), ("m2", 0.9005, 1.005, 0), ("m3", 0.88, 1.2, 0), ("m4", 0.5, 0.1, 0), ("bad", 0.95, 0.1, 3), ("none", None, 0.1, 0), ("nan", nan, 0.1, 0), ("m5", 0.6, None, 0)]
    rows = [("a", m, "val", r2, 9.0, p90, n) for m, r2, p90, n in val] + [("a", "m1", "test", 0.7, 2.0, 3.0, 0), ("a", "m4", "test", 0.9, 2.5, 3.5, 0)]
    df = spark.createDataFrame(rows, "arm string, model string, split string, r2 double, rmse double, rmse_p90 double, n_nonfinite int")
    got = S.top_models(df, ["arm"], 3).orderBy("rank").collect()
    assert [(r["model"], r["omitted"], r["r2_test"], r["rmse_test"]) for r in got] == [("m1", "m2", 0.7, 2.0), ("m3", "", None, None), ("m4", "", 0.9, 2.5)]
    assert got[0]["gap_r2"] == pytest.approx(0.2) and got[1]["gap_r2"] is None
    assert [r["model"] for r in S.top_models(df, ["arm"], 1).collect()] == ["m1"]
    assert S.top_models(df.filter("false"), ["arm"], 3).count() == 0


def test_hour_windows_follow_the_offset_and_refuse_bad_hours(spark):
    times = [f"2020-01-0{1 + h // 24} {h % 24:02d}:00:00" for h in range(3, 51)]  # two days from 03:00
    df = spark.createDataFrame([("s", t, float(k)) for k, t in enumerate(times)], "s string, t string, v double").withColumn("t", F.col("t").cast("timestamp"))
    got = W.hourly_day_windows(df, "s", "t", ["v"], offset_hours=3).orderBy("day").collect()
    assert [(str(r["day"]), len(r["window"]), r["window"][0]["v"]) for r in got] == [("2020-01-01", 24, 0.0), ("2020-01-02", 24, 24.0)]
    assert [str(r["day"]) for r in W.hourly_day_windows(df, "s", "t", ["v"]).collect()] == ["2020-01-02"]
    for bad in (df.limit(1).unionByName(df), df.withColumn("t", F.expr("t + interval 1 minute"))):
        with pytest.raises(Exception, match="twice|full hour"):
            W.hourly_day_windows(bad, "s", "t", ["v"]).collect()


def test_losses_are_paired_before_they_are_averaged(spark):
    inf = float("inf")
    rows = [("w", "a", 1, 2.0), ("w", "b", 1, 4.0), ("k", "a", 1, 1.0), ("k", "b", 1, None), ("w", "a", 2, inf), ("k", "a", 2, 1.0), ("w", "a", 3, 3.0), ("k", "c", 3, 1.0)]
    df = spark.createDataFrame([("m", *r) for r in rows] + [("n", "w", "a", 1, 3.0), ("n", "k", "a", 1, 0.0)], "model string, arm string, station string, day int, e double")
    got = {r["day"]: r["d"] for r in I.loss_differential(df, "day", "arm", ["model"], "e", "w", "k").collect()}
    assert got == {1: (3.0 + 9.0) / 2, 2: None, 3: None}


def test_joins_are_validated(spark):
    a = spark.createDataFrame([(1, "x"), (1, "y")], "k int, v string")
    b = spark.createDataFrame([(1, "z")], "k int, w string")
    assert R.validated_join(a, b, ["k"], validate="many_to_one").count() == 2
    assert R.validated_join(b, b.withColumnRenamed("w", "x"), ["k"]).count() == 1
    for left, right, validate in ((a, b, "one_to_one"), (b, a, "many_to_one"), (a, b, "one_to_many")):
        with pytest.raises(PySparkException, match="repeats keys"):
            R.validated_join(left, right, ["k"], validate=validate).collect()
    twice = a.unionByName(a.limit(1))
    assert R.same_rows(a, a.repartition(3)) and not R.same_rows(a, twice)
    assert tuple(R.compared_rows(twice, a).first()) == (1, 0, False) and tuple(R.compared_rows(a.filter("false"), a.filter("false")).first()) == (0, 0, True)
    keys = spark.createDataFrame([(1,), (2,)], "k int")
    assert sorted(map(tuple, R.fetched_rows(b, keys, ["k"], missing="null").collect())) == [(1, "z"), (2, None)]
    with pytest.raises(PySparkException, match="a key has no row"):
        R.fetched_rows(b, keys, ["k"]).collect()
    with pytest.raises(PySparkException, match="more than one row"):
        R.fetched_rows(a, keys, ["k"], missing="null").collect()
    with pytest.raises(ValueError):
        R.parse_merges("1-2,2-3")


def test_permutation_keeps_values(spark):
    df = spark.range(500).withColumn("v", F.col("id") * 2)
    p = R.permuted(df, ["id"], ["v"], 3)
    assert p.select(F.sum("v")).first()[0] == df.select(F.sum("v")).first()[0]
    assert p.filter(F.col("v") != F.col("id") * 2).count() > 450
    places = R.numbered(df.repartition(7), F.xxhash64("id"), ["id"], "place").collect()
    assert sorted(r["place"] for r in places) == list(range(500))
    assert len({tuple(r) for r in p.collect()} & {tuple(r) for r in R.permuted(df.repartition(5), ["id"], ["v"], 3).collect()}) == 500
    assert R.permuted(df.filter("false"), ["id"], ["v"], 3).count() == 0


def test_permutation_importance_by_hour_bands(spark):
    hours = [f"t_h{h:02d}" for h in range(24)]
    df = spark.range(300).select("id", *(F.pmod(F.xxhash64("id", F.lit(c)), F.lit(100)).cast("double").alias(c) for c in [*hours, "place"]))
    df = df.withColumn("y", F.col("t_h13") * 2.0).withColumn("station", F.col("id") % 2)
    bands = L.hour_bands({"t": hours, "place": ["place"]})
    assert list(bands)[3] == "t 12-15h" and bands["t 12-15h"] == hours[12:16] and len(bands) == 6
    with pytest.raises(ValueError):
        L.hour_bands({"t": hours}, 5)
    got = L.permutation_importance(df, lambda c: c["t_h13"] * 2.0, bands, ["id"], "y", repeats=2, by=["station"]).collect()
    assert len(got) == 6 * 2 * 2
    for r in got:
        moved = r["block"] == "t 12-15h"
        assert (r["delta_rmse"] > 20) == moved and (moved or r["delta_rmse"] == r["delta_rmse_p90"] == 0)


def test_permutation_importance_is_that_of_the_partners(spark):
    df = spark.range(80).select("id", (F.col("id") * 1.0).alias("a"), (F.pmod(F.xxhash64("id"), F.lit(9)) * 1.0).alias("b")).withColumn("y", F.col("a") + F.col("b"))
    rows = [r.asDict() for r in R.with_partner(df, ["id"], ["a", "b"], 4).collect()]
    cut = float(np.percentile([r["y"] for r in rows], 90))
    for r in L.permutation_importance(df, lambda c: c["a"] + c["b"] * 0.5, {"x": ["a"], "z": ["b"]}, ["id"], "y", repeats=1, seed=4).collect():
        score = lambda kept: math.sqrt(np.mean([(q["a"] + q["b"] * 0.5 - q["y"]) ** 2 for q in kept]))
        name = {"x": "a", "z": "b"}[r["block"]]
        swapped = [q | {name: q["partner"][name]} for q in rows]
        tail = lambda kept: [q for q in kept if q["y"] >= cut]
        assert r["delta_rmse"] == pytest.approx(score(swapped) - score(rows))
        assert r["delta_rmse_p90"] == pytest.approx(score(tail(swapped)) - score(tail(rows)))


def test_champions_are_chosen_by_validation_and_scored_by_test(spark):
    scores = [("a", "m1", "val", 0.90, 5.0), ("a", "m2", "val", 0.87, 4.0), ("a", "m3", "val", 0.2, 1.0), ("a", "m4", "val", None, 0.5)]
    scores += [(a, m, "test", r2 and r2 - 0.1, e + 1) for a, m, _, r2, e in scores] + [("b", "m1", "val", 0.5, 1.0)]
    picks = S.champion_rules(spark.createDataFrame(scores, "arm string, model string, split string, r2 double, rmse_p90 double"), ["arm"])
    assert {(r["arm"], r["rule"]): (r["model"], r["test_rmse_p90"]) for r in picks.collect()} == {
        ("a", "r2"): ("m1", 6.0), ("a", "rmse_p90"): ("m3", 2.0), ("a", "r2_slack_then_rmse_p90"): ("m2", 5.0)
    }
    assert [(r["n"], r["n_models"]) for r in S.rule_summary(picks).collect()] == [(1, 1)] * 3


def test_grids_are_snapped_and_masked(spark):
    axis = spark.createDataFrame([(0.0,), (0.25,), (0.5,)], "lat double")
    rows = spark.createDataFrame([(1, 0.2500004, 7.0), (2, -0.0000009, 8.0)], "id int, lat double, v double")
    mask = axis.withColumn("inside", F.col("lat") > 0)
    got = R.masked(R.snapped(rows, "lat", axis), mask, ["lat"], ["v"])
    assert sorted((r["id"], r["lat"], r["v"]) for r in got.collect()) == [(1, 0.25, 7.0), (2, 0.0, None)]
    for off in (0.2500011, None):
        with pytest.raises(PySparkException, match="not on the reference grid"):
            R.snapped(spark.createDataFrame([(off,)], "lat double"), "lat", axis).collect()


def test_selections_overlap(spark):
    f = lambda *names: spark.createDataFrame([(n,) for n in names], "f string")
    assert sorted(map(tuple, R.overlap(f("a", "b", "b"), f("b", "c"), "f").collect())) == [("a", True, False), ("b", True, True), ("c", False, True)]


def test_artifacts_of_other_schemas_are_refused():
    good = {"schema_version": 2, "target_kind": "absolute", "model_name": "m", "resolution": "daily", "feature_names": ["a"]}
    assert study.checked_artifact(good, "daily") is good
    for bad in (good | {"schema_version": 1}, {k: v for k, v in good.items() if k != "target_kind"}, good | {"model_name": "old"}):
        with pytest.raises(study.LegacyArtifact):
            study.checked_artifact(bad, legacy=["old"])
    with pytest.raises(study.UnsupportedResolution):
        study.checked_artifact(good, "hourly")
    with pytest.raises(ValueError):
        study.checked_artifact(good, banned=["a"])


def test_command_line(spark, tmp_path, capsys):
    from gustflow.__main__ import main

    at = lambda name: str(tmp_path / name)
    main(["list"])
    assert "a09_core_metrics" in capsys.readouterr().out.split()
    rows = [(a, "m", t, s, day(40 * d), 10.0 + d, e * (1 + d)) for a, e in (("base", 2.0), ("full", 1.0)) for t in (0, 1) for s in (1, 2) for d in range(9)]
    spark.createDataFrame(rows, "arm string, model string, tag int, station int, day date, y double, e double").write.parquet(at("residuals"))
    main(["draws", at("residuals"), at("metrics"), "--n", "50"], spark)
    main(["effects", at("metrics"), at("effects"), "--metric", "rmse"], spark)
    effect = spark.read.parquet(at("effects")).first()
    assert effect["effect"] == pytest.approx(math.sqrt(np.mean([(1.0 + d) ** 2 for d in range(9)]))) and effect["n_replicates"] == 2
    scores = [("a", "DJF", "m1", s, 0.5, 1.0) for s in ("val", "test")]
    spark.createDataFrame(scores, "arm string, season string, model string, split string, r2 double, rmse_p90 double").write.parquet(at("scores"))
    main(["champions", at("scores"), at("champions")], spark)
    assert spark.read.parquet(at("champions")).count() == 3
    with pytest.raises(ValueError):
        main(["run", "nothing", at("x"), at("y")], spark)


def test_corrected_product_adds_the_winners_residuals(spark):
    grid = spark.createDataFrame([(1, 0.0, 0.0, day(0), 5.0), (2, 9.0, 9.0, day(0), 1.0), (3, 0.0, 0.0, day(1), 4.0)], "point int, lat double, lon double, day date, proxy double")
    stations = spark.createDataFrame([(1, 0.0, 0.0), (2, 9.0, 9.0)], "id int, lat double, lon double")
    predictions = [(p, "arm", 1, "DJF", s, day(0), y, 5.0) for p, s, y in (("good", 1, 7.0), ("good", 2, -2.0), ("bad", 1, 50.0), ("best", 1, 99.0))]
    predictions = spark.createDataFrame(predictions, "pipeline string, arm string, cluster int, season string, id int, day date, y_pred double, proxy double")
    scores = spark.createDataFrame([("best", "arm", 1, "DJF", 0.1), ("good", "arm", 1, "DJF", 1.0), ("bad", "arm", 1, "DJF", 2.0)], "pipeline string, arm string, cluster int, season string, rmse double")
    usable = scores.filter("pipeline <> 'best'").select("pipeline", "arm")
    got = study.corrected_product(grid, stations, predictions, scores, usable, "rmse", k=1)
    assert {r["point"]: r["corrected"] for r in got.collect()} == {1: 7.0, 2: 0.0, 3: None}


def test_effects_by_family_and_axis(spark):
    """Each row is that of the plain effect over its family's models; q values are shared out among an axis's comparisons."""
    rng = np.random.default_rng(6)
    arms, models, tags = {"base": 0.0, "good": -0.3, "same": 0.0, "bad": 2.0}, ["m1", "m2", "m3"], [0, 1]
    rows = [
        (a, t, m, b, 10 if (a, m) != ("same", "m3") else 9, 5 + off + 0.05 * rng.normal(), 3 + 2 * off + 0.1 * rng.normal(), 0.5 - off + 0.01 * rng.normal())
        for a, off in arms.items() for t in tags for m in models for b in range(60)
    ]
    df = spark.createDataFrame(rows, "arm string, tag int, model string, b int, rows int, rmse double, rmse_p90 double, r2 double").persist()
    comparisons = [("good", "base", "good", "features", "base"), ("same", "base", "same", "features", "base"), ("bad", "base", "bad", "selection", "bad")]
    got = {
        (r["comparison"], r["family"], r["metric"]): r
        for r in I.study_effects(df, "arm", "tag", "model", comparisons, {"m1": "linear", "m2": "tree"}, ["rmse", "rmse_p90", "r2"], {"selection": "rmse_p90"}).collect()
    }
    families = {"linear": ["m1"], "tree": ["m2"], "other": ["m3"], "all": models}
    assert len(got) == 3 * 4 * 3 - 3  # m3 covers other rows in arm same, so that family has no pair there
    for (name, family, metric), r in got.items():
        worse, better = next((w, b) for n, w, b, _, _ in comparisons if n == name)
        one = I.paired_effects(df.filter(F.col("model").isin(families[family])), "arm", "tag", "model", worse, better, [metric]).first()
        for c in ("effect", "se_boot", "se_rep", "se", "ci_lo", "ci_hi", "z", "p", "n_replicates", "n_models"):
            assert r[c] == pytest.approx(one[c]), (name, family, metric, c)
        judged = family == "all" and metric == ("rmse_p90" if name == "bad" else "rmse")
        assert (r["verdict"] is not None) == judged == (r["q"] is not None)
    ps = sorted((got[n, "all", "rmse"]["p"], n) for n in ("good", "same"))
    assert got[ps[1][1], "all", "rmse"]["q"] == pytest.approx(ps[1][0])
    assert got[ps[0][1], "all", "rmse"]["q"] == pytest.approx(min(2 * ps[0][0], ps[1][0]))
    assert got["bad", "all", "rmse_p90"]["q"] == pytest.approx(got["bad", "all", "rmse_p90"]["p"])
    assert got["good", "all", "rmse"]["verdict"] == "adds" and got["bad", "all", "rmse_p90"]["verdict"] == "harms"
    assert got["good", "all", "rmse"]["sesoi"] == pytest.approx(0.05, rel=0.02) and got["bad", "all", "rmse_p90"]["sesoi"] == pytest.approx(0.07, rel=0.05)


def test_effects_find_a_known_gain(spark):
    kinds = "arm string, tag int, model string, block int, n double, see double, sy double, syy double, n_p90 double, se_p90 double, see_p90 double, rows long"
    errors = {("base", 0): 4.0, ("full", 0): 1.0, ("base", 1): 9.0, ("full", 1): 1.0}  # mean squares of each replicate
    rows = [(a, t, "m", b, 10.0, e * 10, 20.0 + b, 400.0, 1.0, e, e, b) for (a, t), e in errors.items() for b in range(8)]
    rows += [("base", 1, "half", b, 10.0, 10.0, 20.0, 400.0, 1.0, 1.0, 1.0, b) for b in range(8)]
    rows += [("full", 1, "half", b, 10.0, 10.0, 20.0, 400.0, 1.0, 1.0, 1.0, b) for b in range(7)]  # other rows: left out
    draws = I.seeded_draws(spark, list(range(8)), 50, 1)
    m = I.drawn_metrics(spark.createDataFrame(rows, kinds), draws, ["arm", "tag", "model"], "block")
    r = I.paired_effects(m, "arm", "tag", "model", "base", "full", ["rmse"]).first()
    assert r["effect"] == pytest.approx(1.5) and r["n_replicates"] == 2 and r["n_models"] == 1  # (2 - 1 and 3 - 1)
    assert r["se_rep"] == pytest.approx(0.5) and r["ci_lo"] <= 1.5 <= r["ci_hi"]
    one = I.paired_effects(m.filter("tag = 0"), "arm", "tag", "model", "base", "full", ["bias_p90"]).first()
    assert one["effect"] == pytest.approx(1.0 - 4.0) and one["se_rep"] == 0.0  # with its sign: better minus worse


def test_verdicts_stand_against_the_effect_of_interest(spark):
    cases = [(0.3, 0.5, 0.1, 0.2, "adds"), (0.1, 0.5, 0.1, 0.2, "inconclusive"), (-0.5, -0.3, 0.1, 0.2, "harms"),
             (-0.2, 0.2, 0.1, 0.2, "no information"), (0.3, 0.5, None, 0.2, "indeterminate"), (0.3, 0.5, 0.1, float("nan"), "indeterminate")]
    df = spark.createDataFrame(cases, "lo double, hi double, se double, s double, want string")
    c = F.col
    assert df.filter(I.verdict(c("lo"), c("hi"), c("se"), c("s")) != c("want")).count() == 0


def test_diebold_mariano_by_hand(spark):
    for days in (9, 40):
        x = [1.0 + math.sin(k) for k in range(days)]
        df = spark.createDataFrame(list(enumerate(x)), "k int, d double").withColumn("day", F.expr("date_add(DATE '2020-01-01', k)"))
        r = I.diebold_mariano(df, "day", "d").first()
        if days < 10:
            assert r["dm"] is None and r["p"] is None and r["n"] == 9
            continue
        z = np.array(x) - np.mean(x)
        var = z @ z / days + sum(2 * (1 - k / 6) * (z[k:] @ z[:-k]) / days for k in range(1, 6))
        assert r["dm"] == pytest.approx(np.mean(x) / math.sqrt(var / days) * math.sqrt((days - 1) / days))
    # a day without a value stays in its run of days, so what follows it is paired with what came before
    x = [1.0 + math.sin(k) for k in range(30)]
    df = spark.createDataFrame([(k, None if k == 11 else v) for k, v in enumerate(x)], "k int, d double").withColumn("day", F.expr("date_add(DATE '2020-01-01', k)"))
    z = np.array(x[:11] + x[12:])
    mean, z = z.mean(), z - z.mean()
    var = z @ z / 29 + sum(2 * (1 - k / 6) * (z[k:] @ z[:-k]) / 29 for k in range(1, 6))
    assert I.diebold_mariano(df, "day", "d").first()["dm"] == pytest.approx(mean / math.sqrt(var / 29) * math.sqrt(28 / 29))
    # table values of Student's t
    for t, n, p in ((2.228, 10, 0.05), (1.0, 1, 0.5), (2.0, 2, 0.18350342), (0.0, 5, 1.0), (12.0, 2863, 2.2e-32)):
        assert I.student_two_sided(t, n) == pytest.approx(p, rel=0.05)


def test_decisions_below_the_floor_are_to_discard(spark):
    gains = {"control": [0.1, 0.2, 0.3, 0.5], "kept": [1.0, 1.0, 1.0, -0.1], "open": [5.0, 1.0, -1.0, -1.0], "steady": [0.1, 0.1, 0.1, 0.1], "low": [-1.0] * 4}
    rows = [(f, s, g) for f, gs in gains.items() for s, g in enumerate(gs)]
    got = S.decision(spark.createDataFrame(rows, "f string, s int, g double"), "f", "s", "g", "control").collect()
    assert {r["f"]: r["decision"] for r in got} == {"kept": "keep", "open": "open", "steady": "discard", "low": "discard"}


def test_population_climatology_fits_the_days_means(spark):
    rng = np.random.default_rng(4)
    days = {"much": sorted(rng.choice(np.arange(1, 366), 60, replace=False)), "few": [10, 100, 200, 300], "one": [5]}
    rows = [(k, int(d), float(rng.normal())) for k, ds in days.items() for d in ds for _ in range(int(rng.integers(1, 5)))]
    df = spark.createDataFrame(rows, "k string, doy int, v double").withColumn("day", F.expr("date_add(DATE '2021-01-01', doy - 1)"))
    got = {}
    for r in X.population_climatology(df, "k", "day", "v").collect():
        got.setdefault(r["k"], {})[r["doy"]] = r["clim"]
    for k, n in (("much", 3), ("few", 1), ("one", 0)):
        means = {d: np.mean([v for key, e, v in rows if key == k and e == d]) for d in days[k]}
        design = lambda ds: np.column_stack([np.ones(len(ds))] + [f(2 * np.pi * j * np.array(ds) / 365.25) for j in range(1, n + 1) for f in (np.cos, np.sin)])  # noqa: B023, E731
        c = np.linalg.lstsq(design(list(means)), np.array(list(means.values())), rcond=None)[0]
        assert np.allclose(design(range(1, 367)) @ c, [got[k][d] for d in range(1, 367)])


def test_draws_of_days_stay_in_their_runs(spark):
    ends = [9] * 10 + [29] * 20
    moving = I.moving_block_draws(spark, ends, 5, 20, 1)
    assert {x["s"] for x in moving.groupBy("b").agg(F.sum("c").alias("s")).collect()} == {6}
    starts = {x["start"] for x in moving.collect()}
    assert starts <= {*range(6), *range(10, 26)} and len(starts) > 10
    with pytest.raises(ValueError):
        I.moving_block_draws(spark, ends, 21, 1, 1)
    drawn = {x["b"]: x["s"] for x in I.stationary_draws(spark, ends, 4.0, 20, 1).groupBy("b").agg(F.sum("c").alias("s")).collect()}
    assert drawn[0] == 30 and all(30 <= s < 50 for s in drawn.values())


def test_stretch_sums_are_sums_of_their_days(spark):
    at = [0, 1, 2, 3, 10, 11, 12]
    rows = [("a", day(d), float(d), d) for d in at] + [("b", day(d), 1.0, d) for d in at if d != 2]
    sums = spark.createDataFrame(rows, "arm string, day date, n double, rows long")
    days = I.numbered_days(sums, "day")
    assert [r["run_end"] for r in days.orderBy("at").collect()] == [3, 3, 3, 3, 6, 6, 6]
    got = {(r["arm"], r["start"]): r["n"] for r in I.stretch_sums(sums, days, ["arm"], "day", 3).collect()}
    assert got == {("a", 0): 3.0, ("a", 1): 6.0, ("a", 4): 33.0, ("b", 0): 2.0, ("b", 1): 2.0, ("b", 4): 3.0}


def test_quantile_mapping_of_a_shift(spark):
    df = spark.range(200).select(F.col("id").cast("double").alias("x"), (F.col("id") + 5.0).alias("y"))
    got = X.quantile_delta_mapping(df, df, "x", "y").filter(F.abs(F.col("mapped") - F.col("y")) > 1e-9)
    assert got.count() == 0


def test_validation_sample_leaves_years_to_train():
    units = [(y, m) for y in range(2000, 2010) for m in range(1, 13)]
    drawn = L.sampled_validation(units, (1, 4, 7, 10), 0.15, 42)
    assert drawn == L.sampled_validation(units, (1, 4, 7, 10), 0.15, 42)
    assert {m for _, m in drawn} == {2, 3, 5, 6, 8, 9, 11, 12} and len(drawn) == 16


def test_arms_and_feature_groups():
    arms = study.build_arms(["a"], {"g": ["b", "c"], "h": ["d"]}, {"noise": ["n"]})
    assert [a.name for a in arms] == ["base", "full", "add_g", "drop_g", "add_h", "drop_h", "control_noise"]
    with pytest.raises(ValueError):
        study.build_arms(["a"], {"g": ["a"]})
    assert study.resolved_features("core,static", ["x"], ["x", "nf_a", "nf_s"], static=["nf_s"]) == ["x", "nf_s"]
    with pytest.raises(ValueError):
        study.resolved_features("bogus", ["x"], ["x"])


def test_units_are_replaced_and_missing_found(spark, tmp_path):
    path = str(tmp_path / "units")
    df = spark.createDataFrame([("s1", "a", 1.0), ("s2", "a", 2.0)], "season string, arm string, v double")
    sink.write_units(df, path, ["season", "arm"])
    sink.write_units(df.filter("season = 's1'").withColumn("v", F.lit(9.0)), path, ["season", "arm"])
    assert sorted(r["v"] for r in spark.read.parquet(path).collect()) == [2.0, 9.0]
    wanted = spark.createDataFrame([("s1", "a"), ("s3", "a")], "season string, arm string")
    assert [r["season"] for r in sink.missing_units(spark, path, wanted, ["season", "arm"]).collect()] == ["s3"]
    sink.write_json(spark, str(tmp_path / "meta"), {"k": [1, 2]})
    assert sink.read_json(spark, str(tmp_path / "meta")) == {"k": [1, 2]}
    with pytest.raises(ValueError):
        sink.merged_periods({"a": df.withColumn("d", F.lit(day(0))), "b": df.withColumn("d", F.lit(day(1)))}, "d")
    assert sink.next_experiment(["exp1", "exp12", "other"]) == "exp13"
    assert "<td>s1</td>" in sink.html_table(df, "t")


def test_scans(spark, tmp_path):
    root = tmp_path / "north" / "sl"
    spark.createDataFrame([(1, float("nan"))], "k int, v double").write.parquet(str(root / "t2m_2001.parquet"))
    got = scan.scan(spark, str(root / "t2m_2001.parquet"), ["v"]).first()
    assert got["v"] is None
    (tmp_path / "files" / "north" / "sl").mkdir(parents=True)
    for n in ("t2m_2001.parquet", "readme.parquet"):
        (tmp_path / "files" / "north" / "sl" / n).write_bytes(b"x")
    found = scan.discovered(spark, str(tmp_path / "files"))
    assert [(r["region"], r["name"], r["year"]) for r in found.collect()] == [("north", "t2m", 2001)]
    assert len(scan.fingerprint(found).first()["fingerprint"]) == 40
    calls = []
    make = lambda: calls.append(1) or spark.range(3)
    for _ in range(2):
        assert scan.cached(spark, str(tmp_path / "cache"), make).count() == 3
    assert len(calls) == 1
    for key in ("a", "b", "a"):
        assert scan.cached(spark, str(tmp_path / "keyed"), make, key=key).count() == 3
    assert len(calls) == 3 and scan.cached(spark, str(tmp_path / "cache"), make, use_cache=False).count() == 3 and len(calls) == 4
    assert sorted(p.name for p in (tmp_path / "keyed").iterdir()) == ["key=a", "key=b"]
    assert scan.first_existing(spark, [str(tmp_path / "new"), str(tmp_path / "keyed")]) == str(tmp_path / "keyed")
    with pytest.raises(FileNotFoundError):
        scan.first_existing(spark, [str(tmp_path / "new")])
    with pytest.raises(ValueError):
        scan.single_variable(spark.createDataFrame([(1, 2, 3)], "valid_time int, a int, b int"), ["time"])


def test_streamed_days_and_sessions(spark, tmp_path):
    rows = [(1, dt.datetime(2020, 1, 1, h), float(h)) for h in range(24)] + [(2, dt.datetime(2020, 1, 1, 3), 1.0), (1, dt.datetime(2020, 1, 9, 3), 1.0)]
    spark.createDataFrame(rows, "s int, ts timestamp, v double").write.parquet(str(tmp_path / "in"))
    source = lambda: spark.readStream.schema("s int, ts timestamp, v double").parquet(str(tmp_path / "in"))
    for name, made in (("days", daily.complete_days(source(), "s", "ts", "v")), ("sessions", daily.sessions(source(), "s", "ts", "90 minutes"))):
        q = made.writeStream.outputMode("append").format("memory").queryName(name).option("checkpointLocation", str(tmp_path / name)).start()
        q.processAllAvailable()
        q.stop()
    assert [(r["s"], r["n"], r["peak"]) for r in spark.table("days").collect()] == [(1, 24, 23.0)]
    assert sorted((r["s"], r["n"]) for r in spark.table("sessions").collect()) == [(1, 24), (2, 1)]


def test_holdout_climatology_leaves_its_fold_out(spark):
    rows = [(s, day(d), float(s * 10 + d % 7), "train" if d % 5 else "test") for s in range(4) for d in range(0, 300, 3) if (s + d) % 4]
    df = spark.createDataFrame(rows, "station int, day date, y double, label string").withColumn("fold", F.col("station") % 2)
    got = {(r["fold"], r["doy"]): r["clim"] for r in X.holdout_climatology(df, "fold", "label", "day", "y").collect()}
    for f in (0, 1):
        train = df.filter((F.col("label") == "train") & (F.col("fold") != f)).withColumn("k", F.lit(f))
        wanted = {(r["k"], r["doy"]): r["clim"] for r in X.population_climatology(train, "k", "day", "y").collect()}
        assert all(abs(got[k] - v) < 1e-6 for k, v in wanted.items()) and len(wanted) == 366
    sizes = {r["fold"]: r["n_train"] for r in X.holdout_sizes(df, "station", "fold", "label").collect()}
    assert sizes == {f: sum(1 for s, _, _, k in rows if k == "train" and s % 2 != f) for f in (0, 1)}


def test_artifacts_are_found_by_name(spark, tmp_path):
    from gustflow.sources import scan

    for name in ("best_model_c1.joblib", "best_model_c12_DJF.keras", "best_model_c2_XYZ.joblib", "other.joblib"):
        (tmp_path / name).write_text("x")
    assert {(r["cluster"], r["season"]) for r in scan.artifacts(spark, str(tmp_path)).collect()} == {(1, None), (12, "DJF")}


def test_names_tell_group_look_back_and_kind(spark):
    from gustflow.functions import columns as C

    names = spark.createDataFrame([("ctrl_noise",), ("perm_z",), ("gust",), ("x_lag30h",), ("tp_tend3h",)], "name string")
    n = F.col("name")
    got = {r["name"]: (r["g"], r["h"]) for r in names.select("name", C.column_group(n, {"gust": "core"}).alias("g"), C.lookback_hours(n).alias("h")).collect()}
    assert got == {"ctrl_noise": ("noise", 0), "perm_z": ("permuted", 0), "gust": ("core", 0), "x_lag30h": ("unknown", 30), "tp_tend3h": ("unknown", 3)}
    assert names.agg(C.purge_days(C.lookback_hours(n)).alias("d")).first()["d"] == 2
    kinds = spark.createDataFrame([(None, "MLPRegressor"), (None, "Ridge"), ("absolute", "MLPRegressor")], "k string, m string")
    assert [r["t"] for r in kinds.select(C.target_kind(F.col("k"), F.col("m")).alias("t")).collect()] == ["ratio", "absolute", "absolute"]


def test_rebuilt_features_need_their_columns(spark):
    with pytest.raises(ValueError, match="tp_sum_basin"):
        X.rebuilt_features(spark.createDataFrame([(1, day(0))], "station int, day date"), "station", "day")
