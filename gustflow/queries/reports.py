"""The tables that the study's reports draw."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import features as X
from ..operators import metrics as M
from ..operators import reports as R
from ..operators.windows import purge_boundaries
from .tables import PANEL, panel, register, rounded, table
from .windows import _label, _label_sql

REGISTRY: dict = {}

_E, _R = "(pred - y) * (pred - y)", "(proxy - y) * (proxy - y)"
_LONG = "long AS (SELECT cluster, 'model' AS model, day, y, pred FROM panel UNION ALL SELECT cluster, 'proxy', day, y, proxy FROM panel)"


def _models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """cluster, day, y, model (model, proxy), pred."""
    return panel(spark, sf_dir).select("cluster", "day", "y", F.explode(F.create_map(F.lit("model"), "pred", F.lit("proxy"), "proxy")).alias("model", "pred"))


def _deploy_sql(period: str) -> str:
    return f"""WITH {PANEL}, {_LONG}, w AS (SELECT cluster, model, {period} AS period, round(1 - sum({_E}) / nullif(count(*) * var_pop(y), 0), 4) AS r2 FROM long GROUP BY 1, 2, 3 HAVING count(*) >= 5)
SELECT cluster, model, count(*) AS windows, round(avg(r2), 3) AS mean, round(stddev_samp(r2), 3) AS std, round(min(r2), 4) AS least FROM w GROUP BY 1, 2"""


@register(REGISTRY, f"""WITH {PANEL}, w AS (SELECT station, season, year(day) AS year, count(*) AS n, sqrt(avg({_E})) AS rmse, sqrt(avg({_R})) AS rmse_ref,
 1 - sum({_E}) / nullif(count(*) * var_pop(y), 0) AS r2, avg(pred - y) AS bias, max(y) AS obs_max FROM panel GROUP BY 1, 2, 3 HAVING count(*) >= 4),
r AS (SELECT *, row_number() OVER (ORDER BY rmse, station, season, year) AS p, count(*) OVER () AS m FROM w),
s AS (SELECT *, 'best' AS slice, p AS place FROM r WHERE p <= 10 UNION ALL SELECT *, 'worst', m - p + 1 FROM r WHERE m - p < 10
 UNION ALL SELECT *, 'median', p - greatest(m // 2 - 5, 0) FROM r WHERE p > greatest(m // 2 - 5, 0) AND p <= m // 2 + 5)
SELECT slice, place, station, season, year, n, round(rmse, 4) AS rmse, round(rmse_ref, 4) AS rmse_ref, round(r2, 4) AS r2, round(bias, 4) AS bias, obs_max, round(rmse_ref - rmse, 4) AS gain FROM s""")
def a26_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best, middle and worst windows (station, season, year) of four days or more by their error."""
    p = panel(spark, sf_dir).withColumn("year", F.year("day").cast("long"))
    cards = R.scorecards(p, ["station", "season", "year"], "y", "pred", "proxy", least=4)
    return rounded(R.slices(cards, "rmse", ["station", "season", "year"]), "rmse", "rmse_ref", "r2", "bias", "gain")


@register(REGISTRY, _deploy_sql("strftime(day, '%Y-%m')"))
def a12_deploy_months(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How steady each model is from month to month, per cluster."""
    out = R.deploy_windows(_models(spark, sf_dir), ["cluster", "model"], "day", "y", "pred")
    return rounded(rounded(out, "mean", "std", places=3), "least")


@register(REGISTRY, _deploy_sql("strftime(day, '%Y-%m') || CASE WHEN day(day) <= 15 THEN '-Q1' ELSE '-Q2' END"))
def a12_deploy_half_months(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = R.deploy_windows(_models(spark, sf_dir), ["cluster", "model"], "day", "y", "pred", "biweekly")
    return rounded(rounded(out, "mean", "std", places=3), "least")


_TOPS = """top AS (SELECT l_suppkey AS node, l_returnflag || l_linestatus AS pipeline, max(l_extendedprice) AS greatest FROM lineitem GROUP BY 1, 2),
d AS (SELECT a.*, a.greatest - b.greatest AS difference FROM top a LEFT JOIN top b ON a.node = b.node AND b.pipeline = 'RF' AND a.pipeline <> 'RF')"""


def _differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("node"), F.concat("l_returnflag", "l_linestatus").alias("pipeline"), "l_extendedprice")
    return R.pipeline_differences(lines, ["node"], "pipeline", "l_extendedprice", "RF")


@register(REGISTRY, f"WITH {_TOPS} SELECT node, pipeline, greatest, round(difference, 4) AS difference FROM d")
def a36_pipeline_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_differences(spark, sf_dir), "difference")


@register(REGISTRY, f"""WITH {_TOPS} SELECT min(greatest) AS least, max(greatest) AS greatest, round(CASE WHEN max(abs(difference)) > 0 THEN max(abs(difference)) ELSE 1 END, 4) AS widest_difference FROM d""")
def a36_colour_scales(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(R.colour_scales(_differences(spark, sf_dir)), "widest_difference")


@register(REGISTRY, f"""WITH {PANEL}, e AS (SELECT cluster, season, pred - y AS e FROM panel),
q AS (SELECT cluster, season, count(*) AS n, quantile_cont(e, 0.25) AS q1, quantile_cont(e, 0.5) AS median, quantile_cont(e, 0.75) AS q3 FROM e GROUP BY 1, 2),
w AS (SELECT cluster, season, e, e BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) AS inside FROM e JOIN q USING (cluster, season)),
b AS (SELECT cluster, season, min(e) FILTER (inside) AS low, max(e) FILTER (inside) AS high, count(*) FILTER (NOT inside) AS outside FROM w GROUP BY 1, 2)
SELECT cluster, season, n, round(q1, 4) AS q1, round(median, 4) AS median, round(q3, 4) AS q3, round(least(q1, low), 4) AS low, round(greatest(q3, high), 4) AS high, outside FROM q JOIN b USING (cluster, season)""")
def a39_residual_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = panel(spark, sf_dir).withColumn("e", F.col("pred") - F.col("y"))
    return rounded(R.boxes(p, ["cluster", "season"], "e"), "q1", "median", "q3", "low", "high")


@register(REGISTRY, f"""WITH {PANEL}, s AS (SELECT cluster, min(y) AS a, max(y) AS z, count(*) AS m, quantile_cont(y, 0.9) AS marker, (max(y) - min(y)) / 39 AS w FROM panel GROUP BY 1),
c AS (SELECT cluster, CASE WHEN w > 0 THEN least(floor((y - a) / w), 38) ELSE 0 END::INTEGER AS bin, count(*) AS n FROM panel JOIN s USING (cluster) GROUP BY 1, 2),
b AS (SELECT s.*, unnest(CASE WHEN w > 0 THEN range(39) ELSE range(1) END)::INTEGER AS bin FROM s)
SELECT cluster, bin, round(a + bin * w, 4) AS begins, round(a + (bin + 1) * w, 4) AS ends, coalesce(n, 0)::BIGINT AS n, round(coalesce(n, 0) / nullif(m * w, 0), 9) AS density, round(marker, 4) AS marker
FROM b LEFT JOIN c USING (cluster, bin)""")
def a39_target_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where the observed values of a cluster lie, with their upper tenth marked."""
    return rounded(rounded(R.histogram(panel(spark, sf_dir), ["cluster"], "y"), "begins", "ends", "marker"), "density", places=9)


_GAPPY = f"""g AS (SELECT station, cluster, season, day, {_label_sql('day')} AS split, CASE WHEN station % 9 <> 0 THEN proxy END AS nf, CASE WHEN day(day) <> 13 THEN pred END AS pred FROM panel),
c AS (SELECT * FROM g WHERE cluster IN (SELECT cluster FROM (SELECT cluster, station, count(nf) > 0 AS has FROM g GROUP BY 1, 2) GROUP BY 1 HAVING bool_and(has)) AND nf IS NOT NULL AND pred IS NOT NULL),
k AS (SELECT * FROM c WHERE {' AND '.join(f"{_label_sql(f'(day - {n})')} = split" for n in (1, 2, 3))})"""


@register(REGISTRY, f"""WITH {PANEL}, {_GAPPY}, u AS (SELECT split, season, 1 AS a, 0 AS b, 0 AS c FROM g UNION ALL SELECT split, season, 0, 1, 0 FROM c UNION ALL SELECT split, season, 0, 0, 1 FROM k)
SELECT split, season, sum(a)::BIGINT AS before, sum(b)::BIGINT AS complete, sum(c)::BIGINT AS purged FROM u GROUP BY 1, 2""")
def a40_population_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of each split and season before the rule of complete rows, after it, and after the purge at borders of splits."""
    p = panel(spark, sf_dir)
    given = p.select("station", "cluster", "season", "day", _label("day").alias("split"), F.when(F.col("station") % 9 != 0, F.col("proxy")).alias("nf"), F.when(F.dayofmonth("day") != 13, F.col("pred")).alias("pred"))
    complete = X.complete_rows(given, ["pred"], "cluster", "station", ["nf"])
    return R.row_audit({"before": given, "complete": complete, "purged": purge_boundaries(complete, "day", _label, 3)}, ["split", "season"])


@register(REGISTRY, f"""WITH {PANEL}, s AS (SELECT *, {_label_sql('day')} AS split FROM panel), u AS (SELECT cluster, split, 'model' AS kind, y, pred FROM s UNION ALL SELECT cluster, split, 'proxy', y, proxy FROM s),
cuts AS (SELECT cluster, split, kind, quantile_cont(y, 0.9) AS cut FROM u GROUP BY 1, 2, 3),
m AS (SELECT cluster, split, kind, count(*) AS n, round(1 - sum({_E}) / nullif(count(*) * var_pop(y), 0), 4) AS r2, round(sqrt(avg({_E})), 4) AS rmse, round(avg(pred - y), 4) AS bias,
 round(avg(CASE WHEN y >= cut THEN pred - y END), 4) AS bias_p90, round(sqrt(avg(CASE WHEN y >= cut THEN {_E} END)), 4) AS rmse_p90 FROM u JOIN cuts USING (cluster, split, kind) WHERE split IN ('val', 'test') GROUP BY 1, 2, 3)
SELECT m.*, n_stations, n_train, n_val, n_test FROM m JOIN (SELECT cluster, count(DISTINCT station) AS n_stations, count(*) FILTER (split = 'train') AS n_train, count(*) FILTER (split = 'val') AS n_val, count(*) FILTER (split = 'test') AS n_test FROM s GROUP BY 1) USING (cluster)""")
def a38_model_and_proxy_by_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The model beside the raw proxy over the same validation and test rows, with the sizes of the splits."""
    p = panel(spark, sf_dir).withColumn("split", _label("day"))
    both = p.filter("split IN ('val', 'test')").select("cluster", "split", "y", F.explode(F.create_map(F.lit("model"), "pred", F.lit("proxy"), "proxy")).alias("kind", "pred"))
    return rounded(M.core_metrics(both, ["cluster", "split", "kind"], "y", "pred").join(R.split_sizes(p, ["cluster"], "split", "station"), "cluster"), *M.METRICS)


@register(REGISTRY, f"""WITH {PANEL}, g AS (SELECT season, cluster, unnest(['gain', 'bias']) AS metric, unnest([abs(proxy - y) - abs(pred - y), pred - y]) AS v FROM panel),
e AS (SELECT season, metric, avg(v) AS effect, 1.96 * stddev_samp(v) / sqrt(count(*)) AS half FROM g GROUP BY 1, 2)
SELECT season, metric, round(effect, 4) AS effect, round(effect / max(abs(effect)) OVER (PARTITION BY metric), 6) AS scaled, CASE WHEN effect - half > 0 OR effect + half < 0 THEN '*' ELSE '' END AS star FROM e""")
def a51_effects_by_metric(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, y = panel(spark, sf_dir), F.col("y")
    gain = F.abs(F.col("proxy") - y) - F.abs(F.col("pred") - y)
    g = p.select("season", F.explode(F.create_map(F.lit("gain"), gain, F.lit("bias"), F.col("pred") - y)).alias("metric", "v"))
    half = 1.96 * F.stddev_samp("v") / F.sqrt(F.count("*"))
    e = g.groupBy("season", "metric").agg(F.avg("v").alias("effect"), (F.avg("v") - half).alias("lo"), (F.avg("v") + half).alias("hi"))
    return rounded(rounded(R.effect_matrix(e, "metric", "effect", "lo", "hi").drop("lo", "hi"), "effect"), "scaled", places=6)
