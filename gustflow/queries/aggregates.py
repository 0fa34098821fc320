"""Aggregations and metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import features as X
from ..operators import metrics as M
from ..operators import selection as S
from ..operators.quantiles import quantiles
from ..operators.windows import longest_run
from .tables import HOURLY, PANEL, hourly, panel, register, rounded, table

REGISTRY: dict = {}

_CORE = """count(*) AS n, round(1 - sum((pred - y) * (pred - y)) / nullif(count(*) * var_pop(y), 0), 4) AS r2,
  round(sqrt(avg((pred - y) * (pred - y))), 4) AS rmse, round(avg(pred - y), 4) AS bias,
  round(avg(CASE WHEN y >= cut THEN pred - y END), 4) AS bias_p90,
  round(sqrt(avg(CASE WHEN y >= cut THEN (pred - y) * (pred - y) END)), 4) AS rmse_p90"""


@register(REGISTRY, f"""WITH {PANEL}, cuts AS (SELECT cluster, season, quantile_cont(y, 0.9) AS cut FROM panel GROUP BY 1, 2)
SELECT cluster, season, {_CORE} FROM panel JOIN cuts USING (cluster, season) GROUP BY 1, 2""")
def a09_core_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How biased the prediction is per cluster and season, overall and in the top decile."""
    return rounded(M.core_metrics(panel(spark, sf_dir), ["cluster", "season"], "y", "pred"), *M.METRICS)


@register(REGISTRY, f"""WITH {HOURLY} SELECT station, CAST(ts AS DATE) AS day, count(value) AS n, round(avg(value), 4) AS mean, max(value) AS max,
 min(value) AS min, round(stddev_pop(value), 4) AS std, round(max(value) - min(value), 4) AS range FROM hourly GROUP BY 1, 2""")
def a01_daily_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(X.daily_statistics(hourly(spark, sf_dir), ["station"], "ts", "value"), "mean", "std", "range")


@register(REGISTRY, f"""WITH {HOURLY} SELECT station, CAST(ts AS DATE) AS day FROM hourly GROUP BY 1, 2
 HAVING count(DISTINCT hour(ts)) >= 3 AND count(*) FILTER (value IS NULL) = 0""")
def a02_complete_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.complete_days(hourly(spark, sf_dir), ["station"], "ts", "value", hours=3)


@register(REGISTRY, f"""WITH {HOURLY}, held AS (SELECT DISTINCT kind, CAST(ts AS DATE) AS day FROM hourly)
SELECT kind FROM held GROUP BY 1 HAVING count(*) = (SELECT count(DISTINCT day) FROM held)""")
def a03_complete_variables(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.complete_variables(hourly(spark, sf_dir).withColumn("day", F.to_date("ts")), "kind", "day")


@register(REGISTRY, f"""WITH {HOURLY}, r AS (SELECT station, CAST(ts AS DATE) AS day, hour(ts) AS hour, value,
 row_number() OVER (PARTITION BY station, CAST(ts AS DATE) ORDER BY value DESC, ts) AS k FROM hourly)
SELECT station, day, hour, value FROM r WHERE k = 1""")
def a04_peak_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.peak_rows(hourly(spark, sf_dir), ["station"], "ts", "value").select("station", "day", F.hour("ts").cast("long").alias("hour"), "value")


@register(REGISTRY, f"WITH {PANEL} SELECT station, dayofyear(day) AS doy, round(avg(y), 4) AS clim FROM panel WHERE day < DATE '2000-01-01' GROUP BY 1, 2")
def a05_climatology(spark: SparkSession, sf_dir: str) -> DataFrame:
    train = panel(spark, sf_dir).filter(F.col("day") < F.lit("2000-01-01").cast("date"))
    return rounded(X.climatology(train, "station", "day", "y").withColumn("doy", F.col("doy").cast("long")), "clim")


@register(REGISTRY)
def a06_harmonic_climatology(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.harmonic_climatology(panel(spark, sf_dir), "station", "day", "y")


@register(REGISTRY, f"""WITH {PANEL}, t AS (SELECT station, y, cos(2 * pi() * (dayofyear(day) - 1) / 365.25) AS c, sin(2 * pi() * (dayofyear(day) - 1) / 365.25) AS s FROM panel),
m AS (SELECT station, count(*)::DOUBLE AS n, sum(c) AS sc, sum(s) AS ss, sum(c*c) AS cc, sum(c*s) AS cs, sum(s*s) AS s2, sum(y) AS sy, sum(c*y) AS cy, sum(s*y) AS sny FROM t GROUP BY 1),
d AS (SELECT *, n*(cc*s2-cs*cs) - sc*(sc*s2-cs*ss) + ss*(sc*cs-cc*ss) AS w FROM m)
SELECT station, round((sy*(cc*s2-cs*cs) - sc*(cy*s2-cs*sny) + ss*(cy*cs-cc*sny)) / nullif(w, 0), 3) AS c0,
 round((n*(cy*s2-cs*sny) - sy*(sc*s2-cs*ss) + ss*(sc*sny-cy*ss)) / nullif(w, 0), 3) AS c1,
 round((n*(cc*sny-cy*cs) - sc*(sc*sny-cy*ss) + sy*(sc*cs-cc*ss)) / nullif(w, 0), 3) AS s1 FROM d""")
def a06_first_harmonic(spark: SparkSession, sf_dir: str) -> DataFrame:
    theta = 2 * F.pi() * (F.dayofyear("day") - 1) / 365.25
    return rounded(X.first_harmonic(panel(spark, sf_dir), "station", theta, "y"), "c0", "c1", "s1", places=3)


@register(REGISTRY)
def a07_population_climatology(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each of five folds, from the stations of the other four."""
    train = panel(spark, sf_dir).withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(4)))).filter(F.col("station") % 5 != F.col("fold"))
    return X.population_climatology(train, "fold", "day", "y")


@register(REGISTRY, f"""WITH {PANEL}, q AS (SELECT station, quantile_cont(y, 0.1) AS p10, quantile_cont(y, 0.5) AS p50, quantile_cont(y, 0.9) AS p90 FROM panel GROUP BY 1)
SELECT station, round(p10, 4) AS p10, round(p50, 4) AS p50, round(p90, 4) AS p90, round((p10 - avg(p10) OVER ()) / nullif(stddev_pop(p10) OVER (), 0), 4) AS z_p10,
 round((p50 - avg(p50) OVER ()) / nullif(stddev_pop(p50) OVER (), 0), 4) AS z_p50, round((p90 - avg(p90) OVER ()) / nullif(stddev_pop(p90) OVER (), 0), 4) AS z_p90 FROM q""")
def a08_station_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(X.station_statistics(panel(spark, sf_dir), "station", "y"), "p10", "p50", "p90", "z_p10", "z_p50", "z_p90")


@register(REGISTRY, f"WITH {PANEL} SELECT cluster, season, round(corr(y, pred), 6) AS corr FROM panel GROUP BY 1, 2")
def a10_correlation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(panel(spark, sf_dir).groupBy("cluster", "season").agg(F.corr("y", "pred").alias("corr")), "corr", places=6)


@register(REGISTRY, f"""WITH {PANEL}, m AS (SELECT cluster, season, count(*) AS n, sqrt(avg((pred - y) * (pred - y))) AS rmse, avg(pred - y) AS bias FROM panel GROUP BY 1, 2)
SELECT cluster, sum(n)::BIGINT AS weight, round(sum(n * rmse) / sum(n), 4) AS rmse, round(sum(n * bias) / sum(n), 4) AS bias FROM m GROUP BY 1""")
def a11_weighted_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = M.core_metrics(panel(spark, sf_dir), ["cluster", "season"], "y", "pred")
    return rounded(M.weighted_means(m, ["cluster"], ["rmse", "bias"], "n"), "rmse", "bias")


@register(REGISTRY, f"""WITH {PANEL}, w AS (SELECT cluster, strftime(day, '%Y-%m') || CASE WHEN day(day) <= 15 THEN '-Q1' ELSE '-Q2' END AS period,
 1 - sum((pred - y) * (pred - y)) / nullif(count(*) * var_pop(y), 0) AS r2 FROM panel GROUP BY 1, 2 HAVING count(*) >= 5)
SELECT cluster, count(*) AS windows, round(avg(r2), 4) AS mean, round(stddev_samp(r2), 4) AS std, round(min(r2), 4) AS least FROM w GROUP BY 1""")
def a12_deploy_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    half = F.concat(F.date_format("day", "yyyy-MM"), F.when(F.dayofmonth("day") <= 15, "-Q1").otherwise("-Q2"))
    w = M.core_metrics(panel(spark, sf_dir).withColumn("period", half), ["cluster", "period"], "y", "pred").filter("n >= 5")
    out = w.groupBy("cluster").agg(F.count("*").alias("windows"), F.avg("r2").alias("mean"), F.stddev_samp("r2").alias("std"), F.min("r2").alias("least"))
    return rounded(out, "mean", "std", "least")


@register(REGISTRY, f"""WITH {PANEL}, s AS (SELECT *, CASE WHEN month(day) IN (1, 4, 7, 10) THEN 'test' ELSE 'train' END AS split FROM panel),
cuts AS (SELECT cluster, season, split, quantile_cont(y, 0.9) AS cut FROM s GROUP BY 1, 2, 3)
SELECT cluster, season, split, {_CORE} FROM s JOIN cuts USING (cluster, season, split) GROUP BY 1, 2, 3 HAVING count(*) >= 2""")
def a13_quarterly_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = panel(spark, sf_dir).withColumn("split", F.when(F.month("day").isin(1, 4, 7, 10), "test").otherwise("train"))
    return rounded(M.core_metrics(p, ["cluster", "season", "split"], "y", "pred").filter("n >= 2"), *M.METRICS)


@register(REGISTRY, f"""WITH {PANEL}, a AS (SELECT cluster::VARCHAR AS cluster, 'ALL' AS season, y, pred FROM panel UNION ALL SELECT cluster::VARCHAR, season, y, pred FROM panel),
cuts AS (SELECT cluster, season, quantile_cont(y, 0.9) AS cut FROM a GROUP BY 1, 2) SELECT cluster, season, {_CORE} FROM a JOIN cuts USING (cluster, season) GROUP BY 1, 2""")
def a14_grouping_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(M.grouping_metrics(panel(spark, sf_dir), [["cluster"], ["cluster", "season"]], "y", "pred"), *M.METRICS)


@register(REGISTRY, "SELECT s_nationkey AS cluster, min_by(s_name, s_suppkey) AS first_name, min(s_suppkey) AS station FROM supplier GROUP BY 1")
def a15_first_per_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("cluster")).agg(F.min_by("s_name", "s_suppkey").alias("first_name"), F.min("s_suppkey").alias("station"))


_RUNS = """runs AS (SELECT l_returnflag AS arm, l_linestatus AS model, year(l_shipdate) AS seed, sqrt(avg((l_tax - l_discount) * (l_tax - l_discount))) AS rmse,
 avg(l_tax - l_discount) AS bias, count(*) AS n FROM lineitem GROUP BY 1, 2, 3)"""


def _runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("l_tax") - F.col("l_discount")
    return (
        table(spark, sf_dir, "lineitem")
        .groupBy(F.col("l_returnflag").alias("arm"), F.col("l_linestatus").alias("model"), F.year("l_shipdate").alias("seed"))
        .agg(F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(e).alias("bias"), F.count("*").alias("n"))
    )


@register(REGISTRY, f"WITH {_RUNS} SELECT arm, model, round(avg(rmse), 6) AS rmse, round(avg(bias), 6) AS bias, sum(n)::BIGINT AS n, count(*) AS seeds FROM runs GROUP BY 1, 2")
def a16_leaderboard(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _runs(spark, sf_dir).groupBy("arm", "model").agg(F.avg("rmse").alias("rmse"), F.avg("bias").alias("bias"), F.sum("n").alias("n"), F.count("*").alias("seeds"))
    return rounded(out, "rmse", "bias", places=6)


@register(REGISTRY, f"""WITH {_RUNS}, s AS (SELECT arm, model, stddev_samp(rmse) AS sd FROM runs GROUP BY 1, 2)
SELECT model, round(avg(sd), 6) AS mean_sd, round(max(sd), 6) AS max_sd, max(sd) > 1e-9 AS stochastic FROM s GROUP BY 1""")
def a17_seed_sensitivity(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _runs(spark, sf_dir).groupBy("arm", "model").agg(F.stddev_samp("rmse").alias("sd"))
    return rounded(s.groupBy("model").agg(F.avg("sd").alias("mean_sd"), F.max("sd").alias("max_sd"), (F.max("sd") > 1e-9).alias("stochastic")), "mean_sd", "max_sd", places=6)


@register(REGISTRY, f"""WITH {PANEL} SELECT day, count(*) AS n, round(sum(pred - y), 6) AS se, round(sum((pred - y) * (pred - y)), 1) AS see, round(sum(y), 6) AS sy, round(sum(y * y), 0) AS syy,
 count(*) FILTER (y >= 80000) AS n_high, round(sum(CASE WHEN y >= 80000 THEN pred - y ELSE 0 END), 6) AS se_high, round(sum(CASE WHEN y >= 80000 THEN (pred - y) * (pred - y) ELSE 0 END), 1) AS see_high,
 round(sum(greatest(0.9 * (y - pred), -0.1 * (y - pred))), 8) AS pin_90 FROM panel GROUP BY 1""")
def a19_day_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = panel(spark, sf_dir).withColumn("e", F.col("pred") - F.col("y"))
    out = M.tail_sums(p, ["day"], "y", "e", {"high": 80000.0}, [0.9])
    return rounded(rounded(rounded(out, "se", "sy", "se_high", places=6), "see", "see_high", places=1), "syy", places=0).withColumn("pin_90", F.round("pin_90", 8))


@register(REGISTRY, f"""WITH {PANEL}, c AS (SELECT season, count(*) FILTER (y >= 60000 AND pred >= 60000) AS hits, count(*) FILTER (y >= 60000 AND pred < 60000) AS misses,
 count(*) FILTER (y < 60000 AND pred >= 60000) AS false_alarms FROM panel GROUP BY 1)
SELECT *, hits::DOUBLE / nullif(hits + misses, 0) AS pod, false_alarms::DOUBLE / nullif(hits + false_alarms, 0) AS far, hits::DOUBLE / nullif(hits + misses + false_alarms, 0) AS csi,
 (hits + false_alarms)::DOUBLE / nullif(hits + misses, 0) AS freq_bias FROM c""")
def a21_contingency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.contingency(panel(spark, sf_dir), ["season"], "y", "pred", 60000.0)


@register(REGISTRY, f"""WITH {PANEL}
SELECT least(greatest((len(list_filter([{', '.join(f'q{k}' for k in range(11))}], lambda x: x <= pred)) - 1), 0), 9) AS bin, count(*) AS n, round(avg(pred), 4) AS mean_pred, round(avg(y), 4) AS mean_obs
FROM panel CROSS JOIN (SELECT {', '.join(f'quantile_cont(pred, {k}.0 / 10) AS q{k}' for k in range(11))} FROM panel) GROUP BY 1""")
def a22_reliability(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(M.reliability(panel(spark, sf_dir), "y", "pred", 10).withColumn("bin", F.col("bin").cast("long")), "mean_pred", "mean_obs")


@register(REGISTRY, f"""WITH {PANEL}, s AS (SELECT 'season' AS kind, season AS value, y, pred - y AS e FROM panel UNION ALL SELECT 'station', station::VARCHAR, y, pred - y FROM panel), c AS (SELECT quantile_cont(y, 0.9) AS cut FROM panel)
SELECT kind, value, count(*) AS n, round(avg(e), 4) AS bias, round(sqrt(avg(e * e)), 4) AS rmse, count(*) FILTER (y >= cut) AS n_tail, CASE WHEN count(*) FILTER (y >= cut) >= 10 THEN round(avg(e) FILTER (y >= cut), 4) END AS bias_p90,
 CASE WHEN count(*) FILTER (y >= cut) >= 10 THEN round(sqrt(avg(e * e) FILTER (y >= cut)), 4) END AS rmse_p90 FROM s CROSS JOIN c GROUP BY 1, 2 HAVING count(*) >= 30""")
def a23_stratified(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(M.stratified(panel(spark, sf_dir), ["season", "station"], "y", "pred"), "bias", "rmse", "bias_p90", "rmse_p90")


@register(REGISTRY, f"""WITH {PANEL} SELECT cluster, {', '.join(f"round(avg(pred - y) FILTER (season = '{s}'), 4) AS {s}" for s in ('DJF', 'MAM', 'JJA', 'SON'))} FROM panel GROUP BY 1""")
def a24_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = panel(spark, sf_dir).groupBy("cluster").pivot("season", ["DJF", "MAM", "JJA", "SON"]).agg(F.avg(F.col("pred") - F.col("y")))
    return rounded(out, "DJF", "MAM", "JJA", "SON")


@register(REGISTRY, f"""WITH {PANEL}, g AS (SELECT station, day, day - (row_number() OVER (PARTITION BY station ORDER BY day))::INT AS k FROM panel),
r AS (SELECT station, min(day) AS first_day, max(day) AS last_day, count(*) AS days FROM g GROUP BY station, k)
SELECT station, first_day, last_day, days FROM (SELECT *, row_number() OVER (PARTITION BY station ORDER BY days DESC, first_day) AS q FROM r) WHERE q = 1""")
def a25_longest_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    return longest_run(panel(spark, sf_dir), ["station"], "day")


@register(REGISTRY, f"""WITH {PANEL}, w AS (SELECT station, season, year(day) AS year, count(*) AS n, sqrt(avg((pred - y) * (pred - y))) AS rmse, sqrt(avg((proxy - y) * (proxy - y))) AS rmse_ref, max(y) AS obs_max
 FROM panel GROUP BY 1, 2, 3 HAVING count(*) >= 8)
SELECT station, season, year, n, round(rmse, 4) AS rmse, round(rmse_ref, 4) AS rmse_ref, obs_max, k AS place FROM (SELECT *, row_number() OVER (PARTITION BY season ORDER BY rmse_ref - rmse DESC, station, year) AS k FROM w) WHERE k <= 5""")
def a26_scorecards(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, r = F.col("pred") - F.col("y"), F.col("proxy") - F.col("y")
    w = panel(spark, sf_dir).groupBy("station", "season", F.year("day").cast("long").alias("year")).agg(
        F.count("*").alias("n"), F.sqrt(F.avg(e * e)).alias("rmse"), F.sqrt(F.avg(r * r)).alias("rmse_ref"), F.max("y").alias("obs_max")
    ).filter("n >= 8")
    at = Window.partitionBy("season").orderBy((F.col("rmse_ref") - F.col("rmse")).desc(), "station", "year")
    return rounded(w.withColumn("place", F.row_number().over(at).cast("long")).filter("place <= 5"), "rmse", "rmse_ref")


@register(REGISTRY, f"WITH {PANEL}, c AS (SELECT y - avg(y) OVER (PARTITION BY station) AS a, proxy - avg(proxy) OVER (PARTITION BY station) AS b FROM panel) SELECT round(corr(a, b), 6) AS corr FROM c")
def a27_within_group_correlation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(X.within_group_correlation(panel(spark, sf_dir), "station", "y", "proxy"), "corr", places=6)


@register(REGISTRY, f"WITH {PANEL} SELECT station, strftime(day, '%Y-%m') AS month, count(y) AS days, min(day) FILTER (y IS NOT NULL) AS first_day FROM panel GROUP BY 1, 2")
def a28_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return panel(spark, sf_dir).groupBy("station", F.date_format("day", "yyyy-MM").alias("month")).agg(F.count("y").alias("days"), F.min(F.when(F.col("y").isNotNull(), F.col("day"))).alias("first_day"))


@register(REGISTRY, """WITH v AS (SELECT generate_subscripts(embedding, 1) AS k, unnest(embedding)::DOUBLE AS x, label FROM embeddings),
g AS (SELECT k, avg(abs(x)) FILTER (label < 5) AS a, avg(abs(x)) FILTER (label >= 5) AS b FROM v GROUP BY 1), r AS (SELECT k, rank() OVER (ORDER BY a) AS ra, rank() OVER (ORDER BY b) AS rb FROM g)
SELECT round(corr(ra, rb), 6) AS spearman, count(*) FILTER (ra > 44 AND rb > 44) AS overlap FROM r""")
def a29_rank_correlation(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "embeddings").select("label", F.posexplode("embedding").alias("k", "x"))
    size = F.abs(F.col("x").cast("double"))
    g = v.groupBy("k").agg(F.avg(F.when(F.col("label") < 5, size)).alias("a"), F.avg(F.when(F.col("label") >= 5, size)).alias("b"))
    r = g.withColumns({"ra": F.rank().over(Window.orderBy("a")), "rb": F.rank().over(Window.orderBy("b"))})  # 64 rows
    return rounded(r.agg(F.corr("ra", "rb").alias("spearman"), F.count_if((F.col("ra") > 44) & (F.col("rb") > 44)).alias("overlap")), "spearman", places=6)


@register(REGISTRY, f"""WITH {PANEL}, f AS (SELECT *, station % 5 AS fold FROM panel), cuts AS (SELECT cluster, quantile_cont(y, 0.9) AS cut FROM f GROUP BY 1),
m AS (SELECT cluster, {_CORE} FROM f JOIN cuts USING (cluster) GROUP BY 1)
SELECT m.*, folds, stations FROM m JOIN (SELECT cluster, count(DISTINCT fold) AS folds, count(DISTINCT station) AS stations FROM f GROUP BY 1) USING (cluster)""")
def a30_holdout_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = panel(spark, sf_dir).withColumn("fold", F.col("station") % 5)
    counts = p.groupBy("cluster").agg(F.count_distinct("fold").alias("folds"), F.count_distinct("station").alias("stations"))
    return rounded(M.core_metrics(p, ["cluster"], "y", "pred").join(counts, "cluster"), *M.METRICS)


@register(REGISTRY, f"""WITH {PANEL} SELECT CASE WHEN y < 20000 THEN '0-20k' WHEN y < 40000 THEN '20-40k' WHEN y < 60000 THEN '40-60k' ELSE '60k-' END AS bin, count(*) AS n, round(avg(pred - y), 4) AS bias FROM panel GROUP BY 1""")
def a31_value_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    y = F.col("y")
    b = F.when(y < 20000, "0-20k").when(y < 40000, "20-40k").when(y < 60000, "40-60k").otherwise("60k-")
    return rounded(panel(spark, sf_dir).groupBy(b.alias("bin")).agg(F.count("*").alias("n"), F.avg(F.col("pred") - y).alias("bias")), "bias")


@register(REGISTRY, f"""WITH {PANEL}, g AS (SELECT cluster, season, avg(proxy - pred + 150) AS g FROM panel GROUP BY 1, 2), f AS (SELECT max(g) AS floor FROM g WHERE cluster = 0),
s AS (SELECT cluster, avg(g) AS mean_gain, count(*) FILTER (g > 0) AS seasons_up FROM g WHERE cluster <> 0 GROUP BY 1)
SELECT cluster, round(mean_gain, 4) AS mean_gain, seasons_up, CASE WHEN mean_gain > floor AND seasons_up >= 3 THEN 'keep' WHEN mean_gain > floor THEN 'open' ELSE 'discard' END AS decision FROM s CROSS JOIN f""")
def a32_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = panel(spark, sf_dir).withColumn("gain", F.col("proxy") - F.col("pred") + 150)
    return rounded(S.decision(p.withColumn("cluster", F.col("cluster")), "cluster", "season", "gain", 0), "mean_gain")


@register(REGISTRY, f"""WITH {PANEL}, m AS (SELECT strftime(day, '%Y-%m') AS event, max(y) AS y, max_by(station, (y, -station)) AS station FROM panel GROUP BY 1) SELECT event, y, station FROM m ORDER BY y DESC, event LIMIT 15""")
def a33_extreme_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = panel(spark, sf_dir).groupBy(F.date_format("day", "yyyy-MM").alias("event")).agg(F.max("y").alias("y"), F.max_by("station", F.struct(F.col("y"), -F.col("station"))).alias("station"))
    return m.orderBy(F.desc("y"), "event").limit(15)


@register(REGISTRY, f"""WITH {PANEL}, u AS (SELECT 'ALL' AS season, 'ALL' AS cluster, y, pred FROM panel UNION ALL SELECT season, 'ALL', y, pred FROM panel UNION ALL SELECT 'ALL', cluster::VARCHAR, y, pred FROM panel),
cuts AS (SELECT season, cluster, quantile_cont(y, 0.9) AS cut FROM u GROUP BY 1, 2) SELECT season, cluster, {_CORE} FROM u JOIN cuts USING (season, cluster) GROUP BY 1, 2""")
def a35_multi_level_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(M.grouping_metrics(panel(spark, sf_dir), [[], ["season"], ["cluster"]], "y", "pred"), *M.METRICS)


@register(REGISTRY, """WITH m AS (SELECT l_suppkey AS node, l_returnflag AS pipeline, max(l_extendedprice) AS top FROM lineitem GROUP BY 1, 2)
SELECT a.node, a.pipeline, round(a.top - b.top, 4) AS difference FROM m a JOIN m b ON a.node = b.node AND b.pipeline = 'N' AND a.pipeline <> 'N'""")
def a36_difference_to_reference(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("node"), F.col("l_returnflag").alias("pipeline")).agg(F.max("l_extendedprice").alias("top"))
    ref = m.filter("pipeline = 'N'").select("node", F.col("top").alias("_ref"))
    return rounded(m.filter("pipeline <> 'N'").join(ref, "node").select("node", "pipeline", (F.col("top") - F.col("_ref")).alias("difference")), "difference")


@register(REGISTRY, f"""WITH {PANEL}, m AS (SELECT cluster, sqrt(avg((pred - y) * (pred - y))) AS rmse FROM panel GROUP BY 1)
SELECT cluster, round(CASE WHEN max(rmse) OVER () - min(rmse) OVER () < 1e-12 THEN 0.5 ELSE 1 - (rmse - min(rmse) OVER ()) / (max(rmse) OVER () - min(rmse) OVER ()) END, 6) AS score FROM m""")
def a37_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = M.core_metrics(panel(spark, sf_dir), ["cluster"], "y", "pred")
    return rounded(m.withColumn("score", M.direction_scores(m, "rmse", False)).select("cluster", "score"), "score", places=6)


@register(REGISTRY, f"""WITH {PANEL}, u AS (SELECT cluster, 'model' AS kind, y, pred FROM panel UNION ALL SELECT cluster, 'proxy', y, proxy FROM panel),
cuts AS (SELECT cluster, kind, quantile_cont(y, 0.9) AS cut FROM u GROUP BY 1, 2) SELECT cluster, kind, {_CORE} FROM u JOIN cuts USING (cluster, kind) GROUP BY 1, 2""")
def a38_model_and_proxy(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = panel(spark, sf_dir)
    both = p.select("cluster", "y", F.explode(F.create_map(F.lit("model"), "pred", F.lit("proxy"), "proxy")).alias("kind", "pred"))
    return rounded(M.core_metrics(both, ["cluster", "kind"], "y", "pred"), *M.METRICS)


@register(REGISTRY, f"""WITH {PANEL} SELECT cluster, round(quantile_cont(pred - y, 0.05), 4) AS q05, round(quantile_cont(pred - y, 0.25), 4) AS q25, round(quantile_cont(pred - y, 0.5), 4) AS q50,
 round(quantile_cont(pred - y, 0.75), 4) AS q75, round(quantile_cont(pred - y, 0.95), 4) AS q95 FROM panel GROUP BY 1""")
def a39_residual_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    off = panel(spark, sf_dir).select("cluster", (F.col("pred") - F.col("y")).alias("q"))
    out = quantiles(off, ["cluster"], ["q"], (0.05, 0.25, 0.5, 0.75, 0.95))
    names = ("q05", "q25", "q50", "q75", "q95")
    return rounded(out.select("cluster", *(F.get("q", F.lit(i)).alias(n) for i, n in enumerate(names))), *names)


@register(REGISTRY, f"WITH {HOURLY} SELECT kind, hour(ts)::BIGINT AS hour, count(*) AS n, round(avg(value), 6) AS mean, round(quantile_cont(value, 0.1), 4) AS p10, round(quantile_cont(value, 0.9), 4) AS p90 FROM hourly GROUP BY 1, 2")
def a44_hour_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = F.percentile("value", F.array(F.lit(0.1), F.lit(0.9)))
    out = hourly(spark, sf_dir).groupBy("kind", F.hour("ts").cast("long").alias("hour")).agg(F.count("*").alias("n"), F.avg("value").alias("mean"), q.alias("q"))
    profile = out.select("kind", "hour", "n", "mean", F.get("q", F.lit(0)).alias("p10"), F.get("q", F.lit(1)).alias("p90"))
    return rounded(rounded(profile, "mean", places=6), "p10", "p90")


@register(REGISTRY, f"""WITH {HOURLY}, d AS (SELECT station, CAST(ts AS DATE) AS day, avg(value) AS m, stddev_pop(value) AS s FROM hourly GROUP BY 1, 2), w AS (SELECT s, m - avg(m) OVER (PARTITION BY station) AS c FROM d),
g AS (SELECT avg(value) AS g, var_pop(value) AS v, count(value) AS n FROM hourly), b AS (SELECT sum(n * (m - g) * (m - g)) AS b FROM (SELECT avg(value) AS m, count(value) AS n FROM hourly GROUP BY station) CROSS JOIN (SELECT g FROM g))
SELECT round(avg(s), 4) AS within_day, round(stddev_pop(c), 4) AS between_days, round((SELECT b FROM b) / (SELECT n FROM g) / (SELECT v FROM g), 6) AS station_share FROM w""")
def a45_variance_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = X.variance_parts(hourly(spark, sf_dir).withColumn("day", F.to_date("ts")), "station", "day", "value")
    return rounded(rounded(out, "within_day", "between_days"), "station_share", places=6)


@register(REGISTRY, "SELECT s_suppkey AS station, round((s_acctbal - avg(s_acctbal) OVER ()) / stddev_samp(s_acctbal) OVER (), 6) AS z FROM supplier")
def a46_cross_station_z(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier")
    m = s.agg(F.avg("s_acctbal").alias("m"), F.stddev_samp("s_acctbal").alias("sd"))
    return rounded(s.crossJoin(F.broadcast(m)).select(F.col("s_suppkey").alias("station"), ((F.col("s_acctbal") - F.col("m")) / F.col("sd")).alias("z")), "z", places=6)  # one row


@register(REGISTRY, f"""WITH {PANEL} SELECT season, round(avg(y), 4) AS mean, max(y) AS top, max_by(station, (y, -station)) AS top_station, count(*) FILTER (y > 60000) AS above FROM panel GROUP BY 1""")
def a48_concentration(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = panel(spark, sf_dir).groupBy("season").agg(
        F.avg("y").alias("mean"), F.max("y").alias("top"), F.max_by("station", F.struct(F.col("y"), -F.col("station"))).alias("top_station"), F.count_if(F.col("y") > 60000).alias("above")
    )
    return rounded(out, "mean")


@register(REGISTRY, f"""WITH {_RUNS}, m AS (SELECT arm, model, avg(rmse) AS v FROM runs GROUP BY 1, 2), a AS (SELECT arm, avg(v) AS v FROM m GROUP BY 1) SELECT arm, round(v, 6) AS mean, round(100 * v / sum(v) OVER (), 4) AS share FROM a""")
def a50_mean_of_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = _runs(spark, sf_dir).groupBy("arm", "model").agg(F.avg("rmse").alias("v")).groupBy("arm").agg(F.avg("v").alias("mean"))
    return rounded(rounded(a.withColumn("share", 100 * F.col("mean") / F.sum("mean").over(Window.partitionBy())), "share"), "mean", places=6)


@register(REGISTRY, f"""WITH {_RUNS}, e AS (SELECT arm, avg(bias) AS effect, 1.96 * stddev_samp(bias) / sqrt(count(*)) AS half FROM runs GROUP BY 1)
SELECT arm, round(effect / max(abs(effect)) OVER (), 6) AS scaled, CASE WHEN effect - half > 0 OR effect + half < 0 THEN '*' ELSE '' END AS star FROM e""")
def a51_effect_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _runs(spark, sf_dir).groupBy("arm").agg(F.avg("bias").alias("effect"), (1.96 * F.stddev_samp("bias") / F.sqrt(F.count("*"))).alias("half"))
    star = F.when((F.col("effect") - F.col("half") > 0) | (F.col("effect") + F.col("half") < 0), "*").otherwise("")
    return rounded(e.select("arm", (F.col("effect") / F.max(F.abs("effect")).over(Window.partitionBy())).alias("scaled"), star.alias("star")), "scaled", places=6)


@register(REGISTRY, f"""WITH {PANEL} SELECT CASE WHEN month(day) IN (1, 4, 7, 10) THEN 'test' ELSE 'train' END AS split, count(*) AS n, count(*) FILTER (y > 30000) AS after_filter FROM panel GROUP BY 1""")
def a40_row_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    split = F.when(F.month("day").isin(1, 4, 7, 10), "test").otherwise("train")
    return panel(spark, sf_dir).groupBy(split.alias("split")).agg(F.count("*").alias("n"), F.count_if(F.col("y") > 30000).alias("after_filter"))
