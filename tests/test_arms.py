"""Arms of a study, what they are compared with, and the study's stages from rows to effects."""

from __future__ import annotations

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from gustflow.__main__ import main
from gustflow.functions.columns import variable_of
from gustflow.plans import arms as A

GROUPS = {"a": "grupo1", "b_max": "grupo2", "b_mean": "grupo2", "c": "static", "d": "grupo1"}


def test_sets_of_arms_and_what_they_are_compared_with(spark):
    made = A.study_arms(["a"], ["b_max", "b_mean", "c", "d"], GROUPS, ["core", "groups", "controls", "anchors"], static=["c"])
    by_name = {a.name: a for a in made}
    assert len(by_name) == len(made) == 2 + 8 + 2 + 3 + 2
    assert by_name["full"].features == ("a", "b_max", "b_mean", "c", "d") and by_name["add__c"].features == ("a", "c")
    assert by_name["drop__b_max"].features == ("a", "b_mean", "c", "d")
    assert "add_grp__grupo1" not in by_name  # one of its features is in the base
    assert by_name["drop_grp__grupo1"].features == ("b_max", "b_mean", "c") and by_name["add_grp__grupo2"].features == ("a", "b_max", "b_mean")
    assert by_name["ctrl__noise"].features == ("a", "ctrl_noise") and by_name["ctrl__perm_static"].features == ("a", "perm_c")
    pairs = {n: (w, b) for n, w, b in A.comparisons(made)}
    assert pairs["add__c"] == ("base", "add__c") and pairs["drop__c"] == ("drop__c", "full")
    assert pairs["full_vs_base"] == ("base", "full") and pairs["real_vs_perm_static"] == ("ctrl__perm_static", "add_grp__static")
    assert [c[0] for c in A.comparisons(made, ["base", "full", "add__c", "elsewhere"])] == ["add__c", "full_vs_base"]
    assert [a.name for a in A.study_arms(["a"], ["c"], GROUPS, ["singles"])] == ["add__c", "drop__c"]
    assert A.read_arms(A.arm_table(spark, made)) == sorted(made, key=lambda a: a.name)


def test_arms_that_cannot_be(spark):
    for base, new, sets in ((["a"], ["c"], ["groups"]), (["a"], ["c"], ["anchors", "pairs"]), (["a"], [], ["anchors"]), (["a"], ["a", "c"], ["anchors"]), (["a"], ["z"], ["anchors"])):
        with pytest.raises(ValueError):
            A.study_arms(base, new, GROUPS, sets)
    for variables, without in ((["b", "zz"], []), (["b"], ["c"])):
        with pytest.raises(ValueError):
            A.selected_arms("x", variables, without, list(GROUPS))


def test_selection_by_variables(spark):
    made = A.selected_arms("few", ["b", "c"], ["c"], list(GROUPS))
    assert [(a.name, a.features, a.reference) for a in made] == [("sel__few", ("b_max", "b_mean", "c"), "full"), ("sel__few_sem_c", ("b_max", "b_mean"), "sel__few")]
    both = made + A.study_arms(["a"], ["b_max", "b_mean", "c", "d"], GROUPS, ["anchors"])
    assert ("sel_vs_base", "base", "sel__few") in A.comparisons(both) and ("sel__few", "sel__few", "full") in A.comparisons(both)
    names = ["b_max", "u_lag3h", "gust_max_prev24h_mean", "x_roll7d", "plain", "max", "a_diff_range"]
    table = spark.createDataFrame([(n,) for n in names], "n string")
    assert [r[0] for r in table.select(variable_of(F.col("n"))).collect()] == [A.base_variable(n) for n in names]


def test_controls_come_from_other_stations(spark):
    rows = [(s, d, s * 1.0 if d else None, -s * 10.0) for s in range(7) for d in range(3)]
    df = spark.createDataFrame(rows, "s int, d int, h double, g double")
    found = A.with_controls(df, ["h", "g"], "s", "d").collect()
    assert len(found) == 21 and len({r["ctrl_noise"] for r in found}) == 21
    donor = {r["s"]: r["perm_h"] for r in found}
    assert all(r["perm_h"] == donor[r["s"]] and r["perm_g"] == -10 * r["perm_h"] for r in found)  # one donor for all features
    assert sorted(donor.values()) == list(range(7)) and all(s != h for s, h in donor.items())
    assert {tuple(r) for r in A.with_controls(df.repartition(5), ["h", "g"], "s", "d").collect()} == {tuple(r) for r in found}
    assert A.with_controls(df.filter("s = 1"), ["h"], "s", "d").columns == ["s", "d", "h", "g", "ctrl_noise"]
    assert A.with_controls(df.filter("false"), ["h"], "s", "d").count() == 0


def test_kept_arms_are_added_once(spark, tmp_path):
    path = str(tmp_path / "arms")
    first = A.study_arms(["a"], ["c"], GROUPS, ["anchors"])
    assert A.keep_arms(spark, path, first) == A.keep_arms(spark, path, first) == ["base", "full"]
    more = A.study_arms(["a"], ["c"], GROUPS, ["anchors", "singles"])
    assert A.keep_arms(spark, path, more) == ["add__c", "base", "drop__c", "full"] and spark.read.parquet(path).count() == 4
    with pytest.raises(ValueError, match="base"):
        A.keep_arms(spark, path, A.study_arms(["d"], ["c"], GROUPS, ["anchors"]))


def test_stages_from_rows_to_effects(spark, tmp_path):
    """A feature that matters shows; one that does not, does not. Fits and residuals are numpy's."""
    rng = np.random.default_rng(5)
    rows = []
    for cluster, s in ((1, 1), (1, 2), (2, 3)):
        for k in range(0, 730):
            a, c, d = rng.normal(size=3)
            y = 10 + cluster * a + 2 * c + 0.3 * rng.normal()
            rows.append((cluster, s, dt.date(2020, 1, 1) + dt.timedelta(k), float(a) if k % 50 else None, float(c), float(d), float(y)))
    at = lambda name: str(tmp_path / name)
    spark.createDataFrame(rows, "cluster int, station int, day date, a double, c double, d double, y double").write.parquet(at("rows"))
    main(["arms", at("arms"), "--base", "a", "--new", "c,d", "--group", "static=c", "--group", "grupo1=a", "--group", "g=d", "--sets", "anchors,singles"], spark)
    main(["prepare", at("rows"), at("prepared"), "--features", "a,c,d", "--val", "2020-02,2021-08", "--gap", "2"], spark)
    prepared = spark.read.parquet(at("prepared")).toPandas()
    assert set(prepared.split) == {"train", "val", "test"} and prepared.a.notna().all()
    first_of_april = prepared[(prepared.day >= dt.date(2021, 4, 1)) & (prepared.day <= dt.date(2021, 4, 2))]
    assert first_of_april.empty and not prepared[prepared.day == dt.date(2021, 4, 3)].empty
    main(["screen", at("prepared"), at("arms"), at("models"), "--models", "least_squares"], spark)
    models = spark.read.parquet(at("models")).toPandas()
    assert set(models.season) == {"ALL", "DJF", "JJA"} and set(models.arm) == {"base", "full", "add__c", "add__d", "drop__c", "drop__d"}  # val: February and August
    one = models[(models.cluster == 1) & (models.season == "ALL") & (models.arm == "full")].iloc[0]
    train = prepared[(prepared.cluster == 1) & (prepared.split == "train")]
    x = np.column_stack([np.ones(len(train)), *(train[f] for f in one.features)])
    b = np.linalg.lstsq(x, train.y, rcond=None)[0]
    assert one.n == len(train) and np.allclose([one.intercept, *one.coefficients], b)
    main(["study", at("prepared"), at("models"), at("residuals")], spark)
    residuals = spark.read.parquet(at("residuals")).toPandas()
    test = prepared[prepared.split == "test"]
    assert len(residuals) == 6 * len(test)
    mine = residuals[(residuals.cluster == 1) & (residuals.arm == "full")].sort_values(["station", "day"])
    some = test[test.cluster == 1].sort_values(["station", "day"])
    assert np.allclose(mine.y_pred, np.column_stack([np.ones(len(some)), *(some[f] for f in one.features)]) @ b) and np.allclose(mine.e, mine.y_pred - mine.y)
    main(["aggregate", at("residuals"), at("table")], spark)
    table = spark.read.parquet(at("table")).toPandas().set_index(["arm", "model", "cluster"])
    assert len(table) == 6 * 3 and np.isclose(table.loc[("full", "least_squares", "1"), "rmse"], np.sqrt((mine.e**2).mean()))
    main(["draws", at("residuals"), at("metrics"), "--n", "50"], spark)
    effect = {}
    for better in ("add__c", "add__d"):
        main(["effects", at("metrics"), at(better), "--metric", "rmse", "--better", better], spark)
        effect[better] = spark.read.parquet(at(better)).first()["effect"]
    assert effect["add__c"] > 1.0 and abs(effect["add__d"]) < 0.05
