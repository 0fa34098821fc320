"""Tables of the reports on small cases, against plain loops and numpy."""

from __future__ import annotations

import datetime as dt

import numpy as np
import pytest

from gustflow.operators import reports as R


def test_slices_of_few_many_and_tied_cards(spark):
    rng = np.random.default_rng(1)
    for n, k in ((37, 10), (36, 5), (4, 10), (1, 3), (0, 3)):
        values = [float(v) for v in rng.integers(0, 12, n)]  # many ties
        cards = spark.createDataFrame([(i, v) for i, v in enumerate(values)] + [(99, None)], "id int, v double")
        order = sorted(range(n), key=lambda i: (values[i], i))
        first = max(n // 2 - k // 2, 0)
        wanted = {"best": order[:k], "median": order[first : n // 2 - k // 2 + k], "worst": order[::-1][:k]}
        found = {}
        for r in R.slices(cards, "v", ["id"], k).orderBy("place").collect():
            found.setdefault(r["slice"], []).append((r["place"], r["id"]))
        assert found == {s: list(enumerate(ids, 1)) for s, ids in wanted.items() if ids}, (n, k)


def test_scorecards_leave_rows_without_a_value_out(spark):
    rows = [("a", 1.0, 2.0, 4.0), ("a", 3.0, 3.0, 3.0), ("a", None, 9.0, 9.0), ("b", 1.0, 1.0, 1.0), ("c", 2.0, 3.0, None), ("d", 5.0, 5.0, 4.0), ("d", 5.0, 6.0, 5.0)]
    df = spark.createDataFrame(rows, "g string, y double, p double, r double")
    found = {r["g"]: r for r in R.scorecards(df, ["g"], "y", "p", "r", least=2).collect()}
    assert sorted(found) == ["a", "d"] and found["a"]["n"] == 2 and found["d"]["r2"] is None
    assert np.allclose([found["a"][c] for c in ("rmse", "rmse_ref", "r2", "bias", "obs_max")], [0.5**0.5, 4.5**0.5, 0.5, 0.5, 3.0])
    assert R.scorecards(df.filter("false"), ["g"], "y", "p", "r").count() == 0


def test_deploy_windows(spark):
    rng = np.random.default_rng(2)
    days = [dt.date(2020, 1, 1) + dt.timedelta(k) for k in range(70) if k % 31 not in (3, 4)]
    rows = [(m, d, float(y), float(y + e)) for m in ("x", "z") for d, y, e in zip(days, rng.normal(size=len(days)), rng.normal(size=len(days)), strict=True)]
    df = spark.createDataFrame(rows, "m string, day date, y double, p double")
    for window, name in (("monthly", lambda d: (d.year, d.month)), ("biweekly", lambda d: (d.year, d.month, d.day <= 15))):
        wanted = {}
        for m in ("x", "z"):
            mine = [r for r in rows if r[0] == m]
            r2 = []
            for key in sorted({name(r[1]) for r in mine}):
                y, p = np.array([r[2:] for r in mine if name(r[1]) == key]).T
                if len(y) >= 5:
                    r2.append(round(1 - ((p - y) ** 2).sum() / ((y - y.mean()) ** 2).sum(), 4))
            wanted[m] = (len(r2), np.mean(r2), np.std(r2, ddof=1), min(r2))
        found = {r[0]: tuple(r)[1:] for r in R.deploy_windows(df, ["m"], "day", "y", "p", window).collect()}
        assert sorted(found) == ["x", "z"] and all(np.allclose(found[m], wanted[m]) for m in found)
    with pytest.raises(ValueError):
        R.deploy_windows(df, ["m"], "day", "y", "p", "weekly")


def test_differences_where_the_reference_lacks_a_node(spark):
    rows = [(1, "a", 3.0), (1, "a", 5.0), (1, "b", 4.0), (2, "b", 7.0), (3, "a", 1.0)]
    d = R.pipeline_differences(spark.createDataFrame(rows, "node int, p string, v double"), ["node"], "p", "v", "a")
    assert sorted(map(tuple, d.collect())) == [(1, "a", 5.0, None), (1, "b", 4.0, -1.0), (2, "b", 7.0, None), (3, "a", 1.0, None)]
    assert tuple(R.colour_scales(d).first()) == (1.0, 7.0, 1.0)
    assert tuple(R.colour_scales(d.filter("node = 3")).first()) == (1.0, 1.0, 1.0)


def test_boxes_and_histograms_as_numpy_has_them(spark):
    rng = np.random.default_rng(3)
    values = {"a": rng.normal(size=200).tolist() + [9.0, -8.0], "b": [2.0] * 5, "c": [1.0, 2.0]}
    df = spark.createDataFrame([(g, v) for g, vs in values.items() for v in vs] + [("a", None), ("d", None)], "g string, v double")
    found = {r["g"]: r for r in R.boxes(df, ["g"], "v").collect()}
    assert sorted(found) == ["a", "b", "c"]
    for g, vs in values.items():
        v = np.array(vs)
        q1, q2, q3 = np.quantile(v, [0.25, 0.5, 0.75])
        inside = (v >= q1 - 1.5 * (q3 - q1)) & (v <= q3 + 1.5 * (q3 - q1))
        assert np.allclose([found[g][c] for c in ("n", "q1", "median", "q3", "low", "high", "outside")], [len(v), q1, q2, q3, v[inside].min(), v[inside].max(), (~inside).sum()])
    bars = R.histogram(df, ["g"], "v").orderBy("g", "bin").collect()
    mine = [r for r in bars if r["g"] == "a"]
    counts, edges = np.histogram(values["a"], np.linspace(min(values["a"]), max(values["a"]), 40))
    assert [r["n"] for r in mine] == counts.tolist() and np.allclose([r["begins"] for r in mine], edges[:-1])
    assert np.isclose(sum(r["density"] * (r["ends"] - r["begins"]) for r in mine), 1.0) and np.isclose(mine[0]["marker"], np.quantile(values["a"], 0.9))
    assert [(r["bin"], r["n"], r["density"]) for r in bars if r["g"] == "b"] == [(0, 5, None)]
    assert R.histogram(df.filter("g = 'd'"), ["g"], "v").count() == 0 and R.boxes(df, [], "v").count() == 1


def test_audits_sizes_and_effects(spark):
    df = spark.createDataFrame([("train", 1), ("train", 2), ("test", 2), (None, 3)], "split string, s int")
    audit = R.row_audit({"before": df, "after": df.filter("s = 2"), "none": df.filter("false")}, ["split"])
    assert sorted(map(tuple, audit.collect()), key=str) == sorted([("train", 2, 1, 0), ("test", 1, 1, 0), (None, 1, 0, 0)], key=str)
    assert tuple(R.split_sizes(df, [], "split", "s").first()) == (3, 2, 0, 1)
    effects = spark.createDataFrame([("m", 1.0, 0.5, 2.0), ("m", -4.0, -9.0, 1.0), ("z", 0.0, 0.0, 0.0)], "metric string, e double, lo double, hi double")
    found = R.effect_matrix(effects, "metric", "e", "lo", "hi").orderBy("metric", "e").collect()
    assert [(r["scaled"], r["star"]) for r in found] == [(-1.0, ""), (0.25, "*"), (None, "")]
