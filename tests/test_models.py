"""Models from Gram matrices and kept models, against plain numpy on the rows."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from gustflow.operators import gram as G
from gustflow.plans import models as K
from gustflow.plans.study import LegacyArtifact, UnsupportedResolution

NAMES = ["a", "b", "c", "d"]


def rows_of(n=400, seed=3):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 4)) * [1, 5, 0.1, 2] + [0, 100, 3, -7]
    x[:, 3] = x[:, 0] * 2 + rng.normal(size=n) * 0.5  # correlated with the first
    y = 3 * x[:, 0] - 0.5 * x[:, 1] + 20 * x[:, 2] + rng.normal(size=n) + 40
    return x, y, np.arange(n) % 3, np.where(np.arange(n) % 7 < 5, "train", "val")


@pytest.fixture(scope="module")
def table(spark):
    x, y, g, part = rows_of()
    rows = [(int(g[i]), str(part[i]), *map(float, x[i]), float(y[i])) for i in range(len(y))]
    rows += [(0, "train", None, 1.0, 1.0, 1.0, 1.0), (1, "train", 1.0, float("nan"), 1.0, 1.0, 1.0), (2, "train", 1.0, 1.0, 1.0, 1.0, None), (9, "train", None, None, None, None, None)]
    return spark.createDataFrame(rows, "g int, part string, a double, b double, c double, d double, y double")


def standard(x, y):
    scale = x.std(axis=0)
    return (x - x.mean(axis=0)) / scale, y - y.mean(), scale


def test_matrices_add_subtract_and_are_the_same_by_either_way(spark, table, monkeypatch):
    x, y, g, part = rows_of()
    made = {(r["g"], r["part"]): np.array(r["gram"]) for r in G.gram_matrices(table, ["g", "part"], NAMES, "y").collect()}
    z = np.column_stack([np.ones(len(y)), x, y])
    for key, found in made.items():
        some = z[(g == key[0]) & (part == key[1])]
        assert np.allclose(G.full(found), some.T @ some, rtol=1e-12)
    assert set(made) == {(k, p) for k in range(3) for p in ("train", "val")}
    rest = G.without_own(G.gram_matrices(table.filter("part = 'train'"), ["part", "g"], NAMES, "y"), ["part"], "g", G.gram_size(NAMES)).collect()
    for r in rest:
        some = z[(g != r["g"]) & (part == "train")]
        assert np.allclose(G.full(np.array(r["gram"])), some.T @ some, rtol=1e-9)
    monkeypatch.setattr(G, "NATIVE", 2)
    wide = {(r["g"], r["part"]): np.array(r["gram"]) for r in G.gram_matrices(table, ["g", "part"], NAMES, "y").collect()}
    assert set(wide) == set(made) and all(np.allclose(wide[k], made[k], rtol=1e-12) for k in made)
    assert np.allclose(G.gram_matrices(table, [], NAMES, "y").first()["gram"], sum(made.values()), rtol=1e-12)
    assert G.gram_matrices(table.filter("false"), ["g"], NAMES, "y").count() == 0


def test_fits_are_those_of_the_rows(spark, table):
    x, y, g, part = rows_of()
    grams = G.side_by_side(G.gram_matrices(table, ["g", "part"], NAMES, "y"), ["g"], "part", {"train": "gram", "val": "val"})
    arms = {"all": NAMES, "two": ["c", "a"]}
    fits = G.errors_of(G.fitted(grams, ["g", "val"], NAMES, arms), "val", NAMES)
    assert "val" not in fits.columns
    got = {(r["g"], r["arm"], r["model"]): r for r in fits.collect()}
    assert len(got) == 3 * 2 * len(G.MODELS)
    for (k, arm, model), r in got.items():
        columns = [NAMES.index(c) for c in arms[arm]]
        own, other = (g == k) & (part == "train"), (g == k) & (part == "val")
        z, t, scale = standard(x[own][:, columns], y[own])
        n, p = z.shape
        b = np.array(r["coefficients"]) * scale
        left = z.T @ (t - z @ b) / n
        if model == "least_squares":
            assert np.allclose(b, np.linalg.lstsq(z, t, rcond=None)[0], rtol=1e-8)
        elif model == "ridge":
            assert np.allclose(b, np.linalg.solve(z.T @ z + np.eye(p), z.T @ t), rtol=1e-8)
        elif model in ("lasso", "elastic_net"):  # the conditions of the optimum
            ratio = 1.0 if model == "lasso" else 0.5
            grad = left - (1 - ratio) * b
            assert np.allclose(grad[b != 0], ratio * np.sign(b[b != 0]), atol=1e-6) and np.all(np.abs(grad[b == 0]) <= ratio + 1e-6)
        elif model == "matching_pursuit":
            one = np.abs(z.T @ t).argmax()
            assert np.flatnonzero(b).tolist() == [one] and b[one] == pytest.approx(z[:, one] @ t / n)
        elif model == "bayesian_ridge":  # a ridge with the penalty that its own evidence asks for
            noise, weight = 1 / np.var(t), 1.0
            for _ in range(300):
                new = np.linalg.solve(z.T @ z + weight / noise * np.eye(p), z.T @ t)
                values = noise * np.linalg.eigvalsh(z.T @ z)
                used = np.sum(values / (values + weight))
                weight = (used + 2e-6) / (new @ new + 2e-6)
                noise = (n - used + 2e-6) / (np.sum((t - z @ new) ** 2) + 2e-6)
            assert np.allclose(b, new, rtol=1e-3)
        error = r["intercept"] + x[other][:, columns] @ np.array(r["coefficients"]) - y[other]
        assert r["n"] == own.sum() and r["n_eval"] == other.sum()
        assert r["rmse"] == pytest.approx(np.sqrt(np.mean(error**2)), rel=1e-6) and r["bias"] == pytest.approx(error.mean(), abs=1e-8)
        assert r["r2"] == pytest.approx(1 - np.mean(error**2) / np.var(y[other]), abs=1e-8)


def test_what_does_not_vary_takes_no_part(spark):
    df = spark.createDataFrame([(0.1, float(k), 2.0 * k + 1) for k in range(30)] , "a double, b double, y double")
    for r in G.fitted(G.gram_matrices(df, [], ["a", "b"], "y"), [], ["a", "b"], {"x": ["a", "b"], "flat": ["a"]}).collect():
        assert r["coefficients"][0] == 0.0 and np.isfinite(r["intercept"])
    assert G.fitted(G.gram_matrices(df.limit(19), [], ["a", "b"], "y"), [], ["a", "b"], {"x": ["a"]}).count() == 0


def test_correlations_of_all_pairs(spark, table):
    x, y, g, part = rows_of()
    got = {(r["a"], r["b"]): r["corr"] for r in G.correlation_matrix(table.withColumn("flat", F.lit(0.1)), [*NAMES, "flat"], ["g"]).collect()}
    # rows that lack y count here: these have all four
    z = np.vstack([x, [[1.0, 1.0, 1.0, 1.0]]])
    of = np.append(g, 2)
    z = z - np.array([z[of == k].mean(axis=0) for k in of])
    wanted = np.corrcoef(z.T)
    assert got[("a", "flat")] is None and len(got) == 10
    assert all(got[NAMES[i], NAMES[j]] == pytest.approx(wanted[i, j]) for i in range(4) for j in range(i + 1, 4))
    best = {r["variable"]: (r["hour"], r["corr"]) for r in G.best_hour_correlation(table, {"v": {6: "a", 3: "b"}, "w": {1: "y"}}, "y").collect()}
    assert best["w"] == (1, pytest.approx(1.0)) and best["v"][0] in (3, 6)


def test_models_are_kept_read_and_used(spark, table, tmp_path):
    by = ["cluster", "season"]
    rows = table.filter("part = 'train'").withColumns({"cluster": F.col("g"), "season": F.when(F.col("a") > 0, "DJF").otherwise("MAM")})
    grams = G.seasonal_and_pooled(G.gram_matrices(rows, by, NAMES, "y"), "season", ["cluster"], G.gram_size(NAMES))
    scored = G.errors_of(G.fitted(grams.withColumn("own", F.col("gram")), [*by, "own"], NAMES, {"all": NAMES, "one": ["a"]}), "own", NAMES)
    best = K.champions(scored.filter("season <> 'MAM'"), by)
    assert best.count() == 6 and {r["arm"] for r in best.collect()} == {"all"}
    kept = K.model_table(best, by, "months")
    path = str(tmp_path / "models")
    K.keep_models(kept.filter("cluster < 2"), path)
    back = K.read_models(spark, path, by)
    plain = lambda df: sorted(map(str, df.collect()))
    assert plain(back) == plain(kept.filter("cluster < 2"))
    grid = rows.select(*by, *NAMES).unionByName(spark.createDataFrame([(0, "MAM", None, 1.0, 1.0, 1.0), (0, "DJF", 1e9, 1.0, 1.0, 1.0)], "cluster int, season string, a double, b double, c double, d double"))
    out = K.score_grid(grid, back, NAMES, clip=(-1e6, 1e6)).collect()
    of = {(r["cluster"], r["season"]): r for r in back.collect()}
    for r in out:
        m = of.get((r["cluster"], r["season"]), of.get((r["cluster"], "ALL")))
        assert r["model_season"] == (m["season"] if m else None)
        if m is None or any(r[c] is None or r[c] != r[c] for c in m["features"]):
            assert r["y_pred"] is None
        else:
            v = m["intercept"] + sum(b * r[c] for c, b in zip(m["features"], m["coefficients"], strict=True))
            assert r["y_pred"] == pytest.approx(min(max(v, -1e6), 1e6))
    ratio = K.model_table(best, by, "months", target_kind="ratio").filter("cluster = 0")
    a, b = (K.score_grid(grid.filter("cluster = 0 AND a IS NOT NULL").withColumn("p", F.lit(0.01)), t, NAMES, proxy="p", clip=(-1e12, 1e12)).agg(F.sum("y_pred")).first()[0] for t in (ratio, kept))
    assert a == pytest.approx(0.1 * b)
    with pytest.raises(ValueError):
        K.model_table(best, by, "months", target_kind="other")
    with pytest.raises(UnsupportedResolution):
        K.read_models(spark, path, by, resolution="hourly")
    with pytest.raises(ValueError, match="derived"):
        K.read_models(spark, path, by, banned=["a"])
    K.keep_models(kept.withColumn("schema_version", F.lit(1)), path)
    with pytest.raises(LegacyArtifact):
        K.read_models(spark, path, by)
    best.write.parquet(str(tmp_path / "old"))
    with pytest.raises(LegacyArtifact):
        K.read_models(spark, str(tmp_path / "old"), by)
