"""Queries of the feature study: effects by season, rankings, redundancy, audits, pseudo-arms."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import metrics as M
from ..operators import features as X
from ..operators import gram as G
from ..operators import relations as R
from ..operators.quantiles import quantile
from ..operators.windows import longest_run
from .inference import _RESID, residuals
from .tables import HOURLY, PANEL, hourly, panel, register, rounded, table

REGISTRY: dict = {}


@register(REGISTRY, f"""WITH {_RESID}, s AS (SELECT model, CASE WHEN month(day) = 1 THEN 'DJF' WHEN month(day) = 4 THEN 'MAM' WHEN month(day) = 7 THEN 'JJA' ELSE 'SON' END AS season, arm, sqrt(avg(e * e)) AS rmse FROM resid GROUP BY 1, 2, 3)
SELECT season, round(avg(b.rmse - f.rmse), 5) AS gain, count(*) AS units FROM s b JOIN s f USING (season, model) WHERE b.arm = 'base' AND f.arm = 'full' GROUP BY 1""")
def a20_effects_by_season(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..functions.columns import season

    r = residuals(spark, sf_dir).withColumn("season", season(F.col("day")))
    rmse = lambda a: F.sqrt(F.avg(F.when(F.col("arm") == a, F.col("e") * F.col("e"))))
    s = r.groupBy("season", "model").agg((rmse("base") - rmse("full")).alias("d"))
    return rounded(s.filter("d IS NOT NULL").groupBy("season").agg(F.avg("d").alias("gain"), F.count("*").alias("units")), "gain", places=5)


@register(REGISTRY, f"WITH {PANEL} SELECT DISTINCT year(day) AS year, month(day) AS month FROM panel WHERE (year(day), month(day)) IN ((1996, 2), (1997, 5), (1999, 11), (2000, 8))")
def a41_split_from_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.windows import month_block_label

    label = month_block_label(F.col("day"), (1, 4, 7, 10), [(1996, 2), (1997, 5), (1999, 11), (2000, 8)])
    return panel(spark, sf_dir).filter(label == "val").select(F.year("day").cast("long").alias("year"), F.month("day").cast("long").alias("month")).distinct()


@register(REGISTRY, f"""WITH {_RESID}, a AS (SELECT arm, model, y, e FROM resid UNION ALL SELECT 'proxy', model, y, proxy - y FROM (SELECT y, proxy FROM panel WHERE month(day) IN (1, 4, 7, 10)) CROSS JOIN (VALUES ('m1'), ('m2')) t(model)),
m AS (SELECT arm, model, avg(CASE WHEN y >= cut THEN e END) AS bias, sqrt(avg(CASE WHEN y >= cut THEN e * e END)) AS rmse FROM a CROSS JOIN (SELECT quantile_cont(y, 0.9) AS cut FROM resid) GROUP BY 1, 2)
SELECT arm, round(avg(bias), 4) AS bias_p90, round(avg(rmse), 4) AS rmse_p90, count(*) AS units FROM m GROUP BY 1""")
def a42_x11_tail_table_with_proxy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tail performance of each arm, with the raw proxy as an arm of the same rows and models."""
    r = residuals(spark, sf_dir).select("arm", "model", "y", "e")
    raw = panel(spark, sf_dir).filter(F.month("day").isin(1, 4, 7, 10)).select(
        F.lit("proxy").alias("arm"), F.explode(F.array(F.lit("m1"), F.lit("m2"))).alias("model"), "y", (F.col("proxy") - F.col("y")).alias("e")
    )
    everything = r.unionByName(raw)
    cut = quantile(r, [], "y", 0.9, "cut")
    tail = F.col("y") >= F.col("cut")
    m = everything.crossJoin(F.broadcast(cut)).groupBy("arm", "model").agg(  # one row
        F.avg(F.when(tail, F.col("e"))).alias("bias"), F.sqrt(F.avg(F.when(tail, F.col("e") * F.col("e")))).alias("rmse")
    )
    return rounded(m.groupBy("arm").agg(F.avg("bias").alias("bias_p90"), F.avg("rmse").alias("rmse_p90"), F.count("*").alias("units")), "bias_p90", "rmse_p90")


_EFFECTS = "effects AS (SELECT 'f' || (l_suppkey % 10) AS subject, CASE WHEN l_linestatus = 'O' THEN 'add' ELSE 'drop' END AS kind, avg(l_tax - l_discount) AS effect FROM lineitem GROUP BY 1, 2)"


def _effects(spark: SparkSession, sf_dir: str) -> DataFrame:
    subject = F.concat(F.lit("f"), (F.col("l_suppkey") % 10).cast("string"))
    kind = F.when(F.col("l_linestatus") == "O", "add").otherwise("drop")
    return table(spark, sf_dir, "lineitem").groupBy(subject.alias("subject"), kind.alias("kind")).agg(F.avg(F.col("l_tax") - F.col("l_discount")).alias("effect"))


@register(REGISTRY, f"WITH {_EFFECTS} SELECT subject, round(max(effect) FILTER (kind = 'add'), 6) AS alone, round(max(effect) FILTER (kind = 'drop'), 6) AS removed, row_number() OVER (ORDER BY max(effect) FILTER (kind = 'drop') DESC, subject) AS place FROM effects GROUP BY 1")
def a43_feature_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    side = lambda k: F.max(F.when(F.col("kind") == k, F.col("effect")))
    r = _effects(spark, sf_dir).groupBy("subject").agg(side("add").alias("alone"), side("drop").alias("removed"))
    at = Window.orderBy(F.desc("removed"), "subject")  # a row per feature
    return rounded(r.withColumn("place", F.row_number().over(at).cast("long")), "alone", "removed", places=6)


@register(REGISTRY, f"WITH {_EFFECTS}, g AS (SELECT CASE WHEN subject < 'f5' THEN 'g1' ELSE 'g2' END AS grp, kind, effect FROM effects) SELECT grp, round(max(effect) FILTER (kind = 'drop') - sum(effect) FILTER (kind = 'add'), 6) AS redundancy FROM g GROUP BY 1")
def a47_redundancy(spark: SparkSession, sf_dir: str) -> DataFrame:
    grp = F.when(F.col("subject") < "f5", "g1").otherwise("g2")
    whole = F.max(F.when(F.col("kind") == "drop", F.col("effect")))
    parts = F.sum(F.when(F.col("kind") == "add", F.col("effect")))
    return rounded(_effects(spark, sf_dir).groupBy(grp.alias("grp")).agg((whole - parts).alias("redundancy")), "redundancy", places=6)


@register(REGISTRY, "SELECT event_type AS grp, count(*) FILTER (value > 100) AS used, count(*) FILTER (value <= 100) AS excluded FROM events GROUP BY 1")
def a49_usage_crosstab(spark: SparkSession, sf_dir: str) -> DataFrame:
    use = F.when(F.col("value") > 100, "used").otherwise("excluded")
    out = table(spark, sf_dir, "events").withColumn("use", use).groupBy(F.col("event_type").alias("grp")).pivot("use", ["used", "excluded"])
    return out.agg(F.count(F.lit(1))).fillna(0, ["used", "excluded"])


@register(REGISTRY, f"""WITH {PANEL}, g AS (SELECT station, day, day - (row_number() OVER (PARTITION BY station ORDER BY day))::INT AS k FROM panel), r AS (SELECT station, min(day) AS a, max(day) AS b, count(*) AS n FROM g GROUP BY station, k),
l AS (SELECT station, a, b FROM (SELECT *, row_number() OVER (PARTITION BY station ORDER BY n DESC, a) AS q FROM r) WHERE q = 1),
s AS (SELECT p.*, row_number() OVER (PARTITION BY p.station ORDER BY p.day DESC) AS k FROM panel p JOIN l ON l.station = p.station AND p.day BETWEEN a AND b)
SELECT station, count(*) AS days, round(sqrt(avg((pred - y) ** 2)), 4) AS rmse, round(sqrt(avg((proxy - y) ** 2)), 4) AS rmse_ref FROM s WHERE k <= 5 GROUP BY 1""")
def a52_station_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = panel(spark, sf_dir)
    run = longest_run(p, ["station"], "day").select("station", "first_day", "last_day")
    inside = p.join(run, "station").filter(F.col("day").between(F.col("first_day"), F.col("last_day")))
    k = F.row_number().over(Window.partitionBy("station").orderBy(F.desc("day")))
    rmse = lambda c: F.sqrt(F.avg(F.pow(F.col(c) - F.col("y"), 2)))
    out = inside.withColumn("k", k).filter("k <= 5").groupBy("station").agg(F.count("*").alias("days"), rmse("pred").alias("rmse"), rmse("proxy").alias("rmse_ref"))
    return rounded(out, "rmse", "rmse_ref")


@register(REGISTRY, f"""WITH {HOURLY}, p AS (SELECT station, CAST(ts AS DATE) AS day, hour(ts) AS peak FROM (SELECT *, row_number() OVER (PARTITION BY station, CAST(ts AS DATE) ORDER BY value DESC, ts) AS k FROM hourly) WHERE k = 1)
SELECT h.station, CAST(h.ts AS DATE) AS day, count(*) AS n, any_value(peak) AS peak FROM hourly h LEFT JOIN p ON p.station = h.station AND p.day = CAST(h.ts AS DATE) GROUP BY 1, 2""")
def j13_peak_hour_attach(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.features import peak_rows

    h = hourly(spark, sf_dir)
    peaks = peak_rows(h, ["station"], "ts", "value").select("station", "day", F.hour("ts").cast("long").alias("peak"))
    days = h.groupBy("station", F.to_date("ts").alias("day")).agg(F.count("*").alias("n"))
    return R.validated_join(days, peaks, ["station", "day"], "left", "many_to_one")


_BASIN = """b AS (SELECT l_suppkey AS station, CAST(l_shipdate AS DATE) AS day, avg(l_quantity) AS ws_mean_basin, max(l_quantity) AS ws_max_basin, stddev_pop(l_quantity) AS ws_std_basin,
 avg(sin(l_linenumber)) AS sin_dir_mean_basin, avg(cos(l_linenumber)) AS cos_dir_mean_basin, avg(l_extendedprice) AS t2m_mean_basin, max(l_tax) - min(l_tax) AS t2m_range_basin, avg(l_tax) AS td_dep_mean_basin,
 avg(l_discount) AS rh_mean_basin, max(l_extendedprice) AS msl_mean_basin, min(l_discount) AS d_msl_basin, sum(l_tax) AS tp_sum_basin FROM lineitem GROUP BY 1, 2)"""


@register(REGISTRY, f"""WITH {_BASIN}, l AS (SELECT a.*, {', '.join(f'l{k}.ws_max_basin AS lag{k}' for k in (1, 2, 3, 7))}, l1.d_msl_basin AS lag1_d FROM b a
 {' '.join(f'LEFT JOIN b l{k} ON l{k}.station = a.station AND l{k}.day = a.day - {k}' for k in (1, 2, 3, 7))}),
r AS (SELECT *, CASE WHEN count(*) OVER w7 >= 3 THEN avg(ws_max_basin) OVER w7 END AS r7, CASE WHEN count(*) OVER w3 >= 2 THEN avg(ws_max_basin) OVER w3 END AS r3 FROM l
 WINDOW w7 AS (PARTITION BY station ORDER BY day RANGE BETWEEN INTERVAL 6 DAYS PRECEDING AND CURRENT ROW), w3 AS (PARTITION BY station ORDER BY day RANGE BETWEEN INTERVAL 2 DAYS PRECEDING AND CURRENT ROW))
SELECT station, day, round(ws_mean_basin, 4) AS wind_mag, ws_max_basin AS wind_mag_max, round(ws_std_basin, 4) AS wind_mag_std, round(sin_dir_mean_basin, 6) AS wind_dir_sin, round(cos_dir_mean_basin, 6) AS wind_dir_cos,
 round(t2m_mean_basin, 6) AS "2m_temperature", round(t2m_range_basin, 6) AS t2m_range, round(rh_mean_basin, 6) AS relative_humidity, msl_mean_basin AS surface_pressure, d_msl_basin AS pressure_tendency, round(tp_sum_basin, 6) AS total_precipitation,
 round(t2m_mean_basin - td_dep_mean_basin, 6) AS "2m_dewpoint_temperature", round(ws_mean_basin * cos_dir_mean_basin, 6) AS "10m_u_component_of_wind", round(ws_mean_basin * sin_dir_mean_basin, 6) AS "10m_v_component_of_wind",
 round(ws_max_basin / greatest(ws_mean_basin, 0.1), 6) AS gust_factor, lag1 AS lag1_wind_mag_max, lag2 AS lag2_wind_mag_max, lag3 AS lag3_wind_mag_max, lag7 AS lag7_wind_mag_max, round(r7, 4) AS rolling7d_wind_mag_max, round(r3, 4) AS rolling3d_wind_mag_max,
 round(ws_max_basin - r7, 4) AS wind_mag_max_anom, lag1_d AS lag1_pressure_tendency FROM r""")
def p08_rebuilt_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items stand for the grid: a column of theirs for each of the twelve that are required."""
    q, tax, part, price = F.col("l_quantity"), F.col("l_tax"), F.col("l_discount"), F.col("l_extendedprice")
    b = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("station"), F.to_date("l_shipdate").alias("day")).agg(
        F.avg(q).alias("ws_mean_basin"), F.max(q).alias("ws_max_basin"), F.stddev_pop(q).alias("ws_std_basin"),
        F.avg(F.sin("l_linenumber")).alias("sin_dir_mean_basin"), F.avg(F.cos("l_linenumber")).alias("cos_dir_mean_basin"),
        F.avg(price).alias("t2m_mean_basin"), (F.max(tax) - F.min(tax)).alias("t2m_range_basin"), F.avg(tax).alias("td_dep_mean_basin"),
        F.avg(part).alias("rh_mean_basin"), F.max(price).alias("msl_mean_basin"), F.min(part).alias("d_msl_basin"), F.sum(tax).alias("tp_sum_basin"),
    )
    out = X.rebuilt_features(b, "station", "day").drop(*X.REQUIRED_BASIN)
    four = ("wind_mag", "wind_mag_std", "rolling7d_wind_mag_max", "rolling3d_wind_mag_max", "wind_mag_max_anom")
    six = ("2m_temperature", "2m_dewpoint_temperature", "wind_dir_sin", "wind_dir_cos", "t2m_range", "relative_humidity", "total_precipitation", "10m_u_component_of_wind", "10m_v_component_of_wind", "gust_factor")
    return rounded(rounded(out, *four), *six, places=6)


@register(REGISTRY, "SELECT vec_id, label * 0.25::DOUBLE AS lat, CASE WHEN label BETWEEN 2 AND 7 THEN embedding[1]::DOUBLE END AS v FROM embeddings")
def p21_p22_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings stand for grid nodes: labels are steps of an axis that is off the reference by less than 1e-6."""
    near = F.col("label") * 0.25 + F.when(F.col("vec_id") % 2 == 0, 4e-7).otherwise(-4e-7)
    e = table(spark, sf_dir, "embeddings").select("vec_id", near.alias("lat"), F.get("embedding", F.lit(0)).cast("double").alias("v"))
    axis = spark.range(-40, 400).select((F.col("id") * 0.25).alias("lat"))
    inside = axis.withColumn("inside", F.col("lat").between(0.5, 1.75))
    return R.masked(R.snapped(e, "lat", axis), inside, ["lat"], ["v"]).select("vec_id", "lat", "v")


@register(REGISTRY, "SELECT p_name AS name, CASE WHEN p_name = 'ctrl_noise' THEN 'noise' WHEN p_name LIKE 'perm\\_%' ESCAPE '\\' THEN 'permuted' WHEN p_name = 'gust' THEN 'core' WHEN p_name = 'nf_cape' THEN 'discovered' ELSE 'unknown' END AS grp FROM (SELECT DISTINCT CASE p_size % 5 WHEN 0 THEN 'ctrl_noise' WHEN 1 THEN 'perm_' || p_brand WHEN 2 THEN 'nf_cape' WHEN 3 THEN 'gust' ELSE p_brand END AS p_name FROM part)")
def p29_column_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..functions.columns import column_group

    k, brand = F.col("p_size") % 5, F.col("p_brand")
    name = F.when(k == 0, "ctrl_noise").when(k == 1, F.concat(F.lit("perm_"), brand)).when(k == 2, "nf_cape").when(k == 3, "gust").otherwise(brand)
    names = table(spark, sf_dir, "part").select(name.alias("name")).distinct()
    return names.withColumn("grp", column_group(F.col("name"), {"gust": "core", "nf_cape": "discovered"}))


_HELD = f"{PANEL}, held AS (SELECT *, station % 5 AS fold, CASE WHEN month(day) IN (1, 4, 7, 10) THEN 'test' ELSE 'train' END AS label FROM panel)"


def _held(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.month("day").isin(1, 4, 7, 10), "test").otherwise("train")
    return panel(spark, sf_dir).withColumns({"fold": F.col("station") % 5, "label": label})


@register(REGISTRY, f"""WITH {_HELD}, f AS (SELECT fold, count(DISTINCT station) AS stations, count(*) FILTER (label = 'train') AS t, count(*) FILTER (label = 'test') AS n_eval, sqrt(avg((pred - y) ** 2) FILTER (label = 'test')) AS rmse FROM held GROUP BY 1),
a AS (SELECT fold, stations, (sum(t) OVER () - t)::BIGINT AS n_train, n_eval, round(rmse, 4) AS rmse FROM f) SELECT * FROM a WHERE n_train >= 20 AND n_eval > 0""")
def x15_station_holdout(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = _held(spark, sf_dir)
    sizes = X.holdout_sizes(held, "station", "fold", "label")
    m = M.core_metrics(held.filter("label = 'test'"), ["fold"], "y", "pred").select("fold", "rmse")
    return rounded(sizes.join(m, "fold"), "rmse")


@register(REGISTRY)
def x15_holdout_climatology(spark: SparkSession, sf_dir: str) -> DataFrame:
    """fold, rmse of the climatology that each fold's held-out test rows get from the other stations' training rows."""
    held = _held(spark, sf_dir)
    clim = X.holdout_climatology(held, "fold", "label", "day", "y")
    rows = held.filter("label = 'test'").withColumn("doy", F.dayofyear("day")).join(clim, ["fold", "doy"])
    return rows.groupBy("fold").agg(F.count("*").alias("n_eval"), F.sqrt(F.avg(F.pow(F.col("clim") - F.col("y"), 2))).alias("rmse"))


@register(REGISTRY, f"""WITH {_HELD}, folds AS (SELECT DISTINCT cluster, fold FROM held),
fits AS (SELECT f.cluster, f.fold, count(*) AS n_train, regr_slope(y, proxy) AS b, regr_intercept(y, proxy) AS a FROM folds f JOIN held h ON h.cluster = f.cluster AND h.fold <> f.fold AND label = 'train' GROUP BY 1, 2 HAVING count(*) >= 20)
SELECT cluster, fold, n_train, count(*) AS n_eval, round(sqrt(avg((a + b * proxy - y) ** 2)), 2) AS rmse FROM fits JOIN held USING (cluster, fold) WHERE label = 'test' GROUP BY 1, 2, 3""")
def x15_refitted_holdout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each cluster's model refitted without the fold's stations, on the fold's test rows: one read, matrices subtracted."""
    held = _held(spark, sf_dir)
    size, both = G.gram_size(["proxy"]), {"train": "gram", "test": "test"}
    grams = G.side_by_side(G.gram_matrices(held, ["cluster", "fold", "label"], ["proxy"], "y"), ["cluster", "fold"], "label", both)
    none = F.array_repeat(F.lit(0.0), size)  # a fold without training rows has nothing to take away
    rest = G.without_own(grams.withColumn("gram", F.coalesce("gram", none)), ["cluster"], "fold", size, keep=["test"])
    fits = G.fitted(rest, ["cluster", "fold", "test"], ["proxy"], {"wind": ["proxy"]}, ["least_squares"])
    found = G.errors_of(fits, "test", ["proxy"])
    return rounded(found.select("cluster", "fold", F.col("n").alias("n_train"), "n_eval", "rmse"), "rmse", places=2)


@register(REGISTRY, f"WITH {PANEL}, f AS (SELECT cluster, season, count(*) AS n FROM panel GROUP BY 1, 2) SELECT cluster, season, n FROM f WHERE n >= 500")
def x35_least_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return panel(spark, sf_dir).groupBy("cluster", "season").agg(F.count("*").alias("n")).filter("n >= 500")
