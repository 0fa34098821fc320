"""Scaling, mapping, oversampling, models, importances."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import losses
from ..functions.columns import huber, pinball
from ..functions.sql import register_sql
from ..operators import explain as E
from ..operators import features as X
from ..operators import gram as G
from ..operators import learning as L
from ..operators import metrics as M
from ..plans import models as K
from .tables import PANEL, panel, register, rounded, table

REGISTRY: dict = {}


@register(REGISTRY, f"""WITH {PANEL}, s AS (SELECT median(y) AS m, quantile_cont(y, 0.75) - quantile_cont(y, 0.25) AS r FROM panel WHERE month(day) NOT IN (1, 4, 7, 10))
SELECT station, day, round((y - m) / CASE WHEN r = 0 THEN 1 ELSE r END, 6) AS y FROM panel CROSS JOIN s WHERE month(day) IN (1, 4, 7, 10)""")
def x12_robust_scaling(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = panel(spark, sf_dir).select("station", "day", "y")
    test = F.month("day").isin(1, 4, 7, 10)
    return rounded(X.robust_scaled(p.filter(test), X.robust_scaling(p.filter(~test), ["y"]), ["y"]), "y", places=6)


_CUTS = [k / 99 for k in range(100)]


@register(REGISTRY, f"""WITH {PANEL}, f AS (SELECT quantile_cont(proxy, {_CUTS}) AS xs, quantile_cont(y, {_CUTS}) AS ys FROM panel WHERE month(day) NOT IN (1, 4, 7, 10)),
t AS (SELECT station, day, y, proxy, xs, ys, least(greatest(len(list_filter(xs, lambda v: v <= proxy)), 1), 99) AS i FROM panel CROSS JOIN f WHERE month(day) IN (1, 4, 7, 10)),
d AS (SELECT *, ys[i] - xs[i] AS d0, ys[i + 1] - xs[i + 1] AS d1, CASE WHEN xs[i + 1] > xs[i] THEN least(greatest((proxy - xs[i]) / (xs[i + 1] - xs[i]), 0), 1) ELSE 0 END AS share FROM t)
SELECT station, day, y, round(proxy, 4) AS proxy, round(proxy + d0 + share * (d1 - d0), 4) AS mapped FROM d""")
def x13_quantile_delta_mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = panel(spark, sf_dir).select("station", "day", "y", "proxy")
    test = F.month("day").isin(1, 4, 7, 10)
    return rounded(X.quantile_delta_mapping(p.filter(~test), p.filter(test), "proxy", "y"), "proxy", "mapped")


@register(REGISTRY, """WITH w AS (SELECT o_orderkey, (o_totalprice / (SELECT max(o_totalprice) FROM orders)) ** 2 AS w FROM orders), t AS (SELECT o_orderkey, greatest(round_even(w / (SELECT avg(w) FROM w), 0)::INT, 1) AS t FROM w)
SELECT o_orderkey, t::BIGINT AS copies FROM t""")
def x22_oversampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    return X.oversampled(o, "o_totalprice").groupBy("o_orderkey").agg(F.count("*").alias("copies"))


@register(REGISTRY, f"""WITH {PANEL} SELECT season, round(avg((y - pred) * (y - pred)), 1) AS mse, round(avg(abs(y - pred)), 4) AS mae, round(avg(CASE WHEN abs(y - pred) <= 1000 THEN 0.5 * (y - pred) * (y - pred) ELSE 1000 * (abs(y - pred) - 500) END), 1) AS huber,
 round(avg(greatest(0.9 * (y - pred), -0.1 * (y - pred))), 4) AS pinball FROM panel GROUP BY 1""")
def x25_losses(spark: SparkSession, sf_dir: str) -> DataFrame:
    y, p = F.col("y"), F.col("pred")
    out = panel(spark, sf_dir).groupBy("season").agg(F.avg((y - p) * (y - p)).alias("mse"), F.avg(F.abs(y - p)).alias("mae"), F.avg(huber(y, p, 1000.0)).alias("huber"), F.avg(pinball(y, p, 0.9)).alias("pinball"))
    return rounded(rounded(out, "mse", "huber", places=1), "mae", "pinball")


@register(REGISTRY, f"WITH {PANEL} SELECT cluster, round(regr_slope(y, proxy), 6) AS slope, round(regr_intercept(y, proxy), 3) AS intercept, regr_count(y, proxy)::BIGINT AS n FROM panel WHERE month(day) NOT IN (1, 4, 7, 10) GROUP BY 1")
def x21_group_regressions(spark: SparkSession, sf_dir: str) -> DataFrame:
    train = panel(spark, sf_dir).filter(~F.month("day").isin(1, 4, 7, 10))
    return rounded(rounded(L.simple_regressions(train, ["cluster"], "proxy", "y"), "slope", places=6), "intercept", places=3)


@register(REGISTRY, f"""WITH {PANEL}, t AS (SELECT * FROM panel WHERE month(day) NOT IN (1, 4, 7, 10)), f AS (SELECT cluster, season, regr_slope(y, proxy) AS s, regr_intercept(y, proxy) AS i FROM t GROUP BY 1, 2 HAVING regr_count(y, proxy) >= 400),
g AS (SELECT cluster, regr_slope(y, proxy) AS s, regr_intercept(y, proxy) AS i FROM t GROUP BY 1)
SELECT p.station, p.day, round(coalesce(f.s, g.s) * proxy + coalesce(f.i, g.i), 3) AS y_pred FROM panel p LEFT JOIN f USING (cluster, season) LEFT JOIN g USING (cluster) WHERE month(p.day) IN (1, 4, 7, 10)""")
def x26_x27_season_else_pooled(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = panel(spark, sf_dir)
    test = F.month("day").isin(1, 4, 7, 10)
    fine = L.simple_regressions(p.filter(~test), ["cluster", "season"], "proxy", "y")
    pooled = L.simple_regressions(p.filter(~test), ["cluster"], "proxy", "y").withColumn("season", F.lit(None).cast("string"))
    out = L.scored_by_group(p.filter(test), fine.unionByName(pooled), ["cluster", "season"], ["cluster"], "proxy", least=400)
    return rounded(out.select("station", "day", "y_pred"), "y_pred", places=3)


@register(REGISTRY)
def x21_model_zoo(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = panel(spark, sf_dir).withColumn("doy", F.dayofyear("day").cast("double")).select("station", "day", "y", "proxy", "doy", "season")
    test = F.month("day").isin(1, 4, 7, 10)
    scored = L.screened(p.filter(~test), p.filter(test), ["proxy", "doy"], "y", ["linear", "ridge", "lasso", "tree"])
    return M.core_metrics(scored, ["model", "season"], "y", "y_pred")


def _predict(c: dict) -> object:
    return 0.8 * c["proxy"] + 20.0 * c["doy"] + 500.0


@register(REGISTRY, f"""WITH {PANEL}, p AS (SELECT y, proxy, dayofyear(day)::DOUBLE AS doy FROM panel), m AS (SELECT avg(proxy) AS mp, avg(doy) AS md FROM p),
e AS (SELECT sqrt(avg((0.8 * proxy + 20 * doy + 500 - y) ** 2)) AS b, sqrt(avg((0.8 * mp + 20 * doy + 500 - y) ** 2)) AS a1, sqrt(avg((0.8 * proxy + 20 * md + 500 - y) ** 2)) AS a2 FROM p CROSS JOIN m)
SELECT 'proxy' AS feature, round(a1 - b, 3) AS delta_rmse FROM e UNION ALL SELECT 'doy', round(a2 - b, 3) FROM e""")
def x30_ablation_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = panel(spark, sf_dir).withColumn("doy", F.dayofyear("day").cast("double"))
    return rounded(L.ablation_importance(p, _predict, ["proxy", "doy"], "y"), "delta_rmse", places=3)


@register(REGISTRY)
def x28_x39_permutation_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = panel(spark, sf_dir).withColumn("doy", F.dayofyear("day").cast("double"))
    return L.permutation_importance(p, _predict, {"proxy": ["proxy"], "doy": ["doy"]}, ["station", "day"], "y")


@register(REGISTRY, f"""WITH {PANEL}, p AS (SELECT proxy, dayofyear(day)::DOUBLE AS doy FROM panel), m AS (SELECT avg(proxy) AS mp, avg(doy) AS md FROM p), s AS (SELECT avg(abs(0.8 * (proxy - mp))) AS a, avg(abs(20.0 * (doy - md))) AS b FROM p CROSS JOIN m)
SELECT 'wind' AS "group", round(a / (a + b), 6) AS share FROM s UNION ALL SELECT 'season', round(b / (a + b), 6) FROM s""")
def x31_x42_linear_shap_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = panel(spark, sf_dir).withColumn("doy", F.dayofyear("day").cast("double"))
    return rounded(L.linear_shap_shares(p, {"proxy": 0.8, "doy": 20.0}, {"proxy": "wind", "doy": "season"}), "share", places=6)


@register(REGISTRY, f"""WITH {PANEL}, p AS (SELECT proxy, dayofyear(day)::DOUBLE AS doy FROM panel), m AS (SELECT median(doy) AS md, min(proxy) AS lo, max(proxy) AS hi FROM p)
SELECT k AS step, round(0.8 * (lo + k * (hi - lo) / 199) + 20 * md + 500, 3) AS y_pred FROM m CROSS JOIN (SELECT unnest(range(200))::INT AS k)""")
def x38_partial_dependence(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = panel(spark, sf_dir).withColumn("doy", F.dayofyear("day").cast("double"))
    return rounded(L.partial_dependence(p, _predict, ["proxy", "doy"], "proxy").select("step", "y_pred"), "y_pred", places=3)


@register(REGISTRY)
def a34_regimes(spark: SparkSession, sf_dir: str) -> DataFrame:
    daily = panel(spark, sf_dir).groupBy("day").agg(F.avg("y").alias("y"), F.avg("proxy").alias("proxy"))
    return L.regimes(daily, ["y", "proxy"], "proxy")


@register(REGISTRY, f"WITH {PANEL}, s AS (SELECT cluster, y, CASE WHEN station % 10 = 3 AND day = DATE '1997-01-08' THEN NULL ELSE pred END AS p FROM panel) SELECT cluster, count(*) FILTER (p IS NULL) AS n_nonfinite, round(CASE WHEN count(*) FILTER (p IS NULL) = 0 THEN sqrt(avg((p - y) * (p - y))) END, 4) AS rmse FROM s GROUP BY 1")
def x34_safe_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    odd = (F.col("station") % 10 == 3) & (F.col("day") == F.lit("1997-01-08").cast("date"))
    p = panel(spark, sf_dir).withColumn("p", F.when(odd, float("nan")).otherwise(F.col("pred")))
    return rounded(M.safe_metrics(p, ["cluster"], "y", "p").select("cluster", "n_nonfinite", "rmse"), "rmse")


#: Parts of the year as the study parts it, and the arms that are screened.
_PARTS = "CASE WHEN month(day) IN (1, 4, 7, 10) THEN 'test' WHEN month(day) IN (2, 8) THEN 'val' ELSE 'train' END"
_ARMS = {"wind": ["proxy"], "wind_and_day": ["proxy", "doy"]}
_FEATURES = ["proxy", "doy"]


def _parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = panel(spark, sf_dir).withColumn("doy", F.dayofyear("day").cast("double"))
    return p.withColumn("part", F.when(F.month("day").isin(1, 4, 7, 10), "test").when(F.month("day").isin(2, 8), "val").otherwise("train"))


def _grams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Training and validation matrices of each cluster and season, and of all seasons: one read of the panel."""
    made = G.gram_matrices(_parts(spark, sf_dir).filter("part <> 'test'"), ["cluster", "part", "season"], _FEATURES, "y")
    every = G.seasonal_and_pooled(made, "season", ["cluster", "part"], G.gram_size(_FEATURES))
    return G.side_by_side(every, ["cluster", "season"], "part", {"train": "gram", "val": "val"})


#: Moments of each cluster, part and season, and of all seasons; least squares and ridge (1 on standardised features) by their closed forms.
_MOMENTS = f"""{PANEL}, parts AS (SELECT *, dayofyear(day)::DOUBLE AS doy, {_PARTS} AS part FROM panel),
grouped AS (SELECT cluster, part, season, y, proxy, doy FROM parts UNION ALL SELECT cluster, part, 'ALL', y, proxy, doy FROM parts),
mom AS (SELECT cluster, part, season, count(*) AS n, avg(y) AS my, avg(proxy) AS m1, avg(doy) AS m2, stddev_pop(proxy) AS s1, stddev_pop(doy) AS s2, var_pop(y) AS vy,
 covar_pop(proxy, doy) AS c12, covar_pop(proxy, y) AS c1, covar_pop(doy, y) AS c2 FROM grouped GROUP BY 1, 2, 3),
solved AS (SELECT cluster, season, n, my, m1, m2, arm, model, c1 / s1 AS r1, c2 / s2 AS r2, s1, s2, 1 + k / n AS d, CASE WHEN arm = 'wind' THEN 0 ELSE c12 / (s1 * s2) END AS r12
 FROM mom CROSS JOIN (VALUES ('wind'), ('wind_and_day')) a(arm) CROSS JOIN (VALUES ('least_squares', 0.0), ('ridge', 1.0)) b(model, k) WHERE part = 'train' AND n >= 20),
lines AS (SELECT cluster, season, arm, model, n, CASE WHEN arm = 'wind' THEN r1 / d ELSE (r1 * d - r2 * r12) / (d * d - r12 * r12) END / s1 AS b1,
 CASE WHEN arm = 'wind' THEN 0 ELSE (r2 * d - r1 * r12) / (d * d - r12 * r12) / s2 END AS b2, my, m1, m2 FROM solved),
fits AS (SELECT *, my - b1 * m1 - b2 * m2 AS b0 FROM lines),
evaluated AS (SELECT f.cluster, f.season, f.arm, f.model, f.n, count(*) AS n_eval, sqrt(avg((b0 + b1 * proxy + b2 * doy - y) ** 2)) AS rmse, avg(b0 + b1 * proxy + b2 * doy - y) AS bias,
 CASE WHEN var_pop(y) > 1e-9 THEN 1 - avg((b0 + b1 * proxy + b2 * doy - y) ** 2) / var_pop(y) END AS r2 FROM fits f JOIN grouped g ON g.cluster = f.cluster AND g.season = f.season AND g.part = 'val' GROUP BY ALL)"""


@register(REGISTRY, f"WITH {_MOMENTS} SELECT cluster, season, arm, model, n, round(b1, 7) AS proxy, round(b2, 5) AS doy, round(b0, 3) AS intercept FROM fits")
def x21_x26_fits_by_cluster_and_season(spark: SparkSession, sf_dir: str) -> DataFrame:
    fits = G.fitted(_grams(spark, sf_dir), ["cluster", "season"], _FEATURES, _ARMS, ["least_squares", "ridge"])
    b = lambda c: F.coalesce(F.try_element_at(F.map_from_arrays("features", "coefficients"), F.lit(c)), F.lit(0.0))
    return fits.select("cluster", "season", "arm", "model", "n", F.round(b("proxy"), 7).alias("proxy"), F.round(b("doy"), 5).alias("doy"), F.round("intercept", 3).alias("intercept"))


@register(REGISTRY, f"WITH {_MOMENTS} SELECT cluster, season, arm, model, n, n_eval, round(rmse, 2) AS rmse, round(bias, 2) AS bias, round(r2, 5) AS r2 FROM evaluated")
def x21_screening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Models x arms in each cluster and {ALL, four seasons}, with their errors on the validation rows."""
    fits = G.fitted(_grams(spark, sf_dir), ["cluster", "season", "val"], _FEATURES, _ARMS, ["least_squares", "ridge"])
    found = G.errors_of(fits, "val", _FEATURES)
    return rounded(rounded(found.select("cluster", "season", "arm", "model", "n", "n_eval", "rmse", "bias", "r2"), "rmse", "bias", places=2), "r2", places=5)


@register(REGISTRY, f"""WITH {_MOMENTS}, best AS (SELECT *, row_number() OVER (PARTITION BY cluster, season ORDER BY round(r2, 9) DESC, arm, model) AS k FROM evaluated WHERE r2 IS NOT NULL AND (season = 'ALL' OR n >= 60)),
kept AS (SELECT f.* FROM best b JOIN fits f USING (cluster, season, arm, model) WHERE k = 1)
SELECT p.station, p.day, CASE WHEN o.cluster IS NOT NULL THEN p.season WHEN a.cluster IS NOT NULL THEN 'ALL' END AS model_season,
 round(least(greatest(coalesce(o.b0 + o.b1 * proxy + o.b2 * doy, a.b0 + a.b1 * proxy + a.b2 * doy), 0), 80000), 2) AS y_pred
FROM parts p LEFT JOIN kept o ON o.cluster = p.cluster AND o.season = p.season LEFT JOIN kept a ON a.cluster = p.cluster AND a.season = 'ALL' WHERE part = 'test'""")
def k12_x27_grid_by_kept_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The champion of each cluster and season with enough rows, else of its cluster, on the test rows."""
    fits = G.fitted(_grams(spark, sf_dir), ["cluster", "season", "val"], _FEATURES, _ARMS, ["least_squares", "ridge"])
    scored = G.errors_of(fits, "val", _FEATURES).withColumn("r2", F.round("r2", 9))
    best = K.champions(scored.filter("season = 'ALL' OR n >= 60"), ["cluster", "season"])
    table_of = K.model_table(best, ["cluster", "season"], "months 1, 4, 7, 10 test; 2, 8 val")
    grid = _parts(spark, sf_dir).filter("part = 'test'").select("station", "day", "cluster", "season", "proxy", "doy")
    out = K.score_grid(grid, table_of, _FEATURES, clip=(0.0, 80000.0))
    return rounded(out.select("station", "day", "model_season", "y_pred"), "y_pred", places=2)


_NUMBERS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@register(REGISTRY, f"""WITH c AS (SELECT {', '.join(f'{c} - avg({c}) OVER (PARTITION BY l_suppkey) AS {c}' for c in _NUMBERS)} FROM lineitem),
w AS (SELECT {', '.join(f"corr({a}, {b}) AS {a}__{b}" for k, a in enumerate(_NUMBERS) for b in _NUMBERS[k + 1:])} FROM c)
{' UNION ALL '.join(f"SELECT '{a}' AS a, '{b}' AS b, round({a}__{b}, 8) AS corr FROM w" for k, a in enumerate(_NUMBERS) for b in _NUMBERS[k + 1:])}""")
def a27_correlation_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pairs of lineitem's numbers, within suppliers."""
    return rounded(G.correlation_matrix(table(spark, sf_dir, "lineitem"), _NUMBERS, ["l_suppkey"]), "corr", places=8)


@register(REGISTRY, """WITH h AS (SELECT CAST(ts AS DATE) AS day, user_id % 50 AS s, max(value) AS y, """ + ", ".join(f"avg(value) FILTER (hour(ts) // 4 = {k}) AS v{k}, count(*) FILTER (hour(ts) // 4 = {k})::DOUBLE AS n{k}" for k in range(6)) + """ FROM events GROUP BY 1, 2),
c AS (""" + " UNION ALL ".join(f"SELECT '{v}' AS variable, {k} AS hour, corr({x}{k}, y) AS corr FROM h" for v, x in (("mean", "v"), ("count", "n")) for k in range(6)) + """)
SELECT variable, hour, round(corr, 6) AS corr FROM (SELECT *, row_number() OVER (PARTITION BY variable ORDER BY abs(corr) DESC, hour) AS k FROM c) WHERE k = 1""")
def a27_best_hour_correlation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of four-hour stretches the one whose mean or number of events goes best with the day's greatest value."""
    at = lambda k: (F.hour("ts") / 4).cast("int") == k
    h = table(spark, sf_dir, "events").groupBy(F.to_date("ts").alias("day"), (F.col("user_id") % 50).alias("s")).agg(
        F.max("value").alias("y"), *(F.avg(F.when(at(k), F.col("value"))).alias(f"v{k}") for k in range(6)), *(F.count_if(at(k)).cast("double").alias(f"n{k}") for k in range(6))
    )
    return rounded(G.best_hour_correlation(h, {"mean": {k: f"v{k}" for k in range(6)}, "count": {k: f"n{k}" for k in range(6)}}, "y"), "corr", places=6)


@register(REGISTRY, f"""WITH {PANEL} SELECT season, round(avg(0.7 * greatest(0.9 * (y - pred), -0.1 * (y - pred)) + 0.3 * abs(y - pred) + 1e-6 * (y - pred) * (y - pred)), 3) AS combined FROM panel GROUP BY 1""")
def x25_combined_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = losses.build("combined", components=[{"name": "pinball", "tau": 0.9, "weight": 0.7}, {"name": "mae", "weight": 0.3}, {"name": "mse", "weight": 1e-6}])
    out = panel(spark, sf_dir).groupBy("season").agg(F.avg(mixed(F.col("y"), F.col("pred"))).alias("combined"))
    return rounded(out, "combined", places=3)


@register(REGISTRY, f"""WITH {PANEL}, r AS (SELECT station, day, season, y, proxy, sum(g) OVER (PARTITION BY station ORDER BY day) AS run FROM (SELECT *, CASE WHEN day - lag(day) OVER (PARTITION BY station ORDER BY day) > 1 THEN 1 ELSE 0 END AS g FROM panel))
SELECT station, run::BIGINT AS run, min(season) AS season, count(*) AS days, round(sum(greatest(0.9 * (y - proxy), -0.1 * (y - proxy))), 6) AS loss FROM r GROUP BY 1, 2 HAVING count(*) > 1""")
def f12_functions_in_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of days by a table function and losses by scalar ones, in one SQL statement."""
    register_sql(spark)
    panel(spark, sf_dir).select(F.col("station").cast("string").alias("station"), "day", "y", "proxy").createOrReplaceTempView("gustflow_panel")
    return spark.sql(
        """WITH r AS (SELECT * FROM day_runs(TABLE(SELECT station, day FROM gustflow_panel) PARTITION BY station ORDER BY day))
        SELECT CAST(station AS BIGINT) AS station, run, min(season_of(p.day)) AS season, count(*) AS days, round(sum(pinball_loss(y, proxy, 0.9D)), 6) AS loss
        FROM r JOIN gustflow_panel p ON p.station = r.key AND p.day = r.day GROUP BY 1, 2 HAVING count(*) > 1"""
    )


_TREE_FEATURES = ["proxy", "doy", "cluster"]


@register(REGISTRY)
def x31_x42_tree_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Least and greatest share of each group of features over the seasons, of boosted trees' exact contributions."""
    rows = _parts(spark, sf_dir).filter("cluster IS NOT NULL").withColumn("cluster", F.col("cluster").cast("double"))
    x = L.assembled(rows.filter("part = 'train'"), _TREE_FEATURES)
    model = L.ZOO["boosted"]().setLabelCol("y").setPredictionCol("y_pred").fit(x)
    test = model.transform(L.assembled(rows.filter("part = 'test'"), _TREE_FEATURES)).select("season", *_TREE_FEATURES, "y_pred")
    sound = E.checked_additive(E.tree_contributions(test, model, _TREE_FEATURES), "y_pred")
    return E.share_ranges(E.group_shares(sound, _TREE_FEATURES, {"proxy": "wind", "doy": "time", "cluster": "place"}, ["season"]))
