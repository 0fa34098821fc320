"""Calendars, lags, rolling statistics, purges, lookback windows, events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.columns import lookback_hours, purge_days, variable_of
from ..operators import selection as S
from ..operators import windows as W
from .tables import HOURLY, PANEL, hourly, panel, register, rounded, table

REGISTRY: dict = {}

_DENSE = f"""{PANEL}, span AS (SELECT station, min(day) AS a, max(day) AS b FROM panel GROUP BY 1),
axis AS (SELECT station, CAST(unnest(generate_series(a, b, INTERVAL 1 DAY)) AS DATE) AS day FROM span),
dense AS (SELECT station, day, y, proxy FROM axis LEFT JOIN panel USING (station, day))"""

_VAL = [(1996, 2), (1997, 5), (1999, 11), (2000, 8)]
_TEST = (1, 4, 7, 10)


def _label_sql(day: str) -> str:
    units = ", ".join(str(y * 100 + m) for y, m in _VAL)
    return f"""CASE WHEN {day} > DATE '2001-06-30' THEN 'out' WHEN month({day}) IN (1, 4, 7, 10) THEN 'test'
      WHEN year({day}) * 100 + month({day}) IN ({units}) THEN 'val' ELSE 'train' END"""


def _label(day):
    return W.month_block_label(F.col(day) if isinstance(day, str) else day, _TEST, _VAL, last="2001-06-30")


def _dense(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.densify(panel(spark, sf_dir).select("station", "day", "y", "proxy"), "station", "day")


@register(REGISTRY, f"WITH {_DENSE}, l AS (SELECT station, day, y, lag(y, 1) OVER w AS lag1, lag(y, 3) OVER w AS lag3, round(y - lag(y, 1) OVER w, 4) AS diff FROM dense WINDOW w AS (PARTITION BY station ORDER BY day)) SELECT * FROM l WHERE y IS NOT NULL")
def w01_lags(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _dense(spark, sf_dir)
    lag = lambda k: W.lagged("y", k, "station", "day")
    return rounded(d.select("station", "day", "y", lag(1).alias("lag1"), lag(3).alias("lag3"), (F.col("y") - lag(1)).alias("diff")).filter("y IS NOT NULL"), "diff")


@register(REGISTRY, f"""WITH {_DENSE} SELECT station, day, round(CASE WHEN count(y) OVER w7 >= 3 THEN avg(y) OVER w7 END, 4) AS mean7, round(CASE WHEN count(y) OVER w3 >= 2 THEN avg(y) OVER w3 END, 4) AS mean3
FROM dense WINDOW w7 AS (PARTITION BY station ORDER BY day ROWS 6 PRECEDING), w3 AS (PARTITION BY station ORDER BY day ROWS 2 PRECEDING)""")
def w02_rolling_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    roll = lambda n, k: W.rolling_mean("y", n, k, "station", "day")
    return rounded(_dense(spark, sf_dir).select("station", "day", roll(7, 3).alias("mean7"), roll(3, 2).alias("mean3")), "mean7", "mean3")


@register(REGISTRY, f"WITH {_DENSE} SELECT station, day, round(y - avg(y) OVER (PARTITION BY station ORDER BY day ROWS 6 PRECEDING), 4) AS anomaly FROM dense")
def w03_anomaly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_dense(spark, sf_dir).select("station", "day", (F.col("y") - W.rolling_mean("y", 7, 0, "station", "day")).alias("anomaly")), "anomaly")


@register(REGISTRY, f"WITH {_DENSE} SELECT station, day, CASE WHEN y IS NULL THEN 'out' ELSE {_label_sql('day')} END AS label FROM dense")
def w04_calendar(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _dense(spark, sf_dir).select("station", "day", F.when(F.col("y").isNull(), "out").otherwise(_label("day")).alias("label"))


@register(REGISTRY, f"WITH {PANEL}, g AS (SELECT station, day, day - lag(day) OVER (PARTITION BY station ORDER BY day) AS gap FROM panel) SELECT station, day FROM g WHERE gap <> 1")
def w05_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.with_gaps(panel(spark, sf_dir).select("station", "day"), "station", "day")


@register(REGISTRY, f"""WITH {_DENSE} SELECT station, day, n, round(s, 4) AS total FROM (SELECT station, day, count(*) OVER w AS n, sum(coalesce(y, 0)) OVER w AS s FROM dense
WINDOW w AS (PARTITION BY station ORDER BY day ROWS 6 PRECEDING)) WHERE n = 7""")
def w06_lookback(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = W.lookback(_dense(spark, sf_dir), "station", "day", ["day", "y"], 7)
    total = F.aggregate("window", F.lit(0.0), lambda acc, x: acc + F.coalesce(x["y"], F.lit(0.0)))
    return rounded(rows.select("station", "day", F.size("window").cast("long").alias("n"), total.alias("total")), "total")


@register(REGISTRY, f"""WITH {HOURLY}, full_hours AS (SELECT station % 2 AS station, date_trunc('hour', ts) AS ts, max(value) AS value FROM hourly GROUP BY 1, 2),
days AS (SELECT station, CAST(ts - INTERVAL 3 HOURS AS DATE) AS day, count(*) AS hours, max(value) FILTER (hour(ts) = 3) AS first, max(value) FILTER (hour(ts) = 2) AS last FROM full_hours GROUP BY 1, 2)
SELECT station, day, hours, round(first, 4) AS first, round(last, 4) AS last FROM days WHERE hours = 24""")
def w07_hourly_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    full_hours = hourly(spark, sf_dir).groupBy((F.col("station") % 2).alias("station"), F.date_trunc("hour", "ts").alias("ts")).agg(F.max("value").alias("value"))
    made = W.hourly_day_windows(full_hours, "station", "ts", ["value"], offset_hours=3)
    out = made.select("station", "day", F.size("window").cast("long").alias("hours"), F.col("window")[0]["value"].alias("first"), F.col("window")[23]["value"].alias("last"))
    return rounded(out, "first", "last")


@register(REGISTRY, f"""WITH {_DENSE}, l AS (SELECT station, day, CASE WHEN y IS NULL THEN 'out' ELSE {_label_sql('day')} END AS label FROM dense),
w AS (SELECT *, count(*) OVER w AS n, min(label) OVER w AS a, max(label) OVER w AS b FROM l WINDOW w AS (PARTITION BY station ORDER BY day ROWS 1 PRECEDING))
SELECT station, day, label FROM w WHERE n = 2 AND a = b AND label <> 'out'""")
def w08_strict_purge(spark: SparkSession, sf_dir: str) -> DataFrame:
    labelled = _dense(spark, sf_dir).withColumn("label", F.when(F.col("y").isNull(), "out").otherwise(_label("day")))
    return W.lookback(labelled, "station", "day", ["day"], 2, label="label").select("station", "day", "label")


@register(REGISTRY, f"""WITH {PANEL} SELECT station, day, {_label_sql('day')} AS label FROM panel WHERE {' AND '.join(f"{_label_sql(f'(day - {k})')} = {_label_sql('day')}" for k in (1, 2, 3))}""")
def w09_boundary_purge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.purge_boundaries(panel(spark, sf_dir), "day", _label, 3).select("station", "day", _label("day").alias("label"))


@register(REGISTRY, f"WITH {PANEL} SELECT {_label_sql('day')} AS label, count(*) AS n, min(day) AS first_day, max(day) AS last_day FROM panel GROUP BY 1")
def w10_split_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return panel(spark, sf_dir).groupBy(_label("day").alias("label")).agg(F.count("*").alias("n"), F.min("day").alias("first_day"), F.max("day").alias("last_day"))


@register(REGISTRY, f"""WITH {HOURLY}, d AS (SELECT station % 20 AS st, CAST(ts AS DATE) AS day, max(value) AS v FROM hourly GROUP BY 1, 2), q AS (SELECT st, quantile_cont(v, 0.9) AS q FROM d GROUP BY 1),
a AS (SELECT day, count(*) FILTER (v >= q) >= 3 AS active FROM d JOIN q USING (st) GROUP BY 1),
r AS (SELECT *, sum(n) OVER (ORDER BY day) AS run FROM (SELECT *, CASE WHEN day - lag(day) OVER (ORDER BY day) > 1 THEN 1 ELSE 0 END AS n FROM a)),
b AS (SELECT *, max(CASE WHEN active THEN day END) OVER (PARTITION BY run ORDER BY day) AS p, min(CASE WHEN active THEN day END) OVER (PARTITION BY run ORDER BY day ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS f FROM r),
i AS (SELECT *, active OR coalesce(f - p <= 2, false) AS inside FROM b),
g AS (SELECT *, sum(nw) OVER (PARTITION BY run ORDER BY day) AS part FROM (SELECT *, CASE WHEN lag(inside) OVER (PARTITION BY run ORDER BY day) = inside THEN 0 ELSE 1 END AS nw FROM i)),
c AS (SELECT *, CASE WHEN inside THEN 0 ELSE (row_number() OVER (PARTITION BY run, part ORDER BY day) - 1) // 7 END AS chunk FROM g)
SELECT day, active, CASE WHEN inside THEN 'event ' ELSE 'quiet ' END || strftime(min(day) OVER (PARTITION BY run, part, chunk), '%Y-%m-%d') AS event FROM c""")
def w11_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = hourly(spark, sf_dir).groupBy((F.col("station") % 20).alias("st"), F.to_date("ts").alias("day")).agg(F.max("value").alias("v"))
    return W.event_days(d, "st", "day", "v", k=3)


@register(REGISTRY, f"WITH {PANEL}, g AS (SELECT station, day, CASE WHEN day - lag(day) OVER w > 1 THEN 1 ELSE 0 END AS b FROM panel WINDOW w AS (PARTITION BY station ORDER BY day)) SELECT station, day, (sum(b) OVER (PARTITION BY station ORDER BY day))::BIGINT AS run FROM g")
def w12_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.runs(panel(spark, sf_dir).select("station", "day"), ["station"], "day")


_SCORES = """scores AS (SELECT l_returnflag AS pipeline, l_linestatus AS arm, s_nationkey AS cluster, sqrt(avg((l_tax - l_discount) * (l_tax - l_discount))) AS rmse, avg(l_tax - l_discount) AS bias_p90, count(*) AS n
 FROM lineitem JOIN supplier ON s_suppkey = l_suppkey GROUP BY 1, 2, 3)"""


def _scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("l_tax") - F.col("l_discount")
    supplier = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("cluster"))
    return table(spark, sf_dir, "lineitem").join(supplier, "l_suppkey").groupBy(F.col("l_returnflag").alias("pipeline"), F.col("l_linestatus").alias("arm"), "cluster").agg(
        F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(e).alias("bias_p90"), F.count("*").alias("n")
    )


@register(REGISTRY, f"WITH {_SCORES} SELECT pipeline, arm, cluster, row_number() OVER (PARTITION BY pipeline ORDER BY abs(bias_p90), arm, cluster) AS rank FROM scores")
def w13_rank_in_pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.ranked(_scores(spark, sf_dir), ["pipeline"], "bias_p90", ["arm", "cluster"]).select("pipeline", "arm", "cluster", F.col("rank").cast("long").alias("rank"))


@register(REGISTRY, f"WITH {_SCORES} SELECT cluster, pipeline, arm, round(rmse, 6) AS rmse FROM (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY rmse, pipeline, arm) AS k FROM scores) WHERE k = 1")
def w14_winners(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(S.winners(_scores(spark, sf_dir), ["cluster"], "rmse", ["pipeline", "arm"]).select("cluster", "pipeline", "arm", "rmse"), "rmse", places=6)


@register(REGISTRY, f"""WITH {_SCORES}, r AS (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY rmse, pipeline, arm) AS k FROM scores),
u AS (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY k) AS j FROM r WHERE NOT (pipeline = 'N' AND arm = 'O')),
b AS (SELECT cluster, pipeline || '/' || arm AS best FROM r WHERE k = 1)
SELECT cluster, pipeline, arm, CASE WHEN pipeline || '/' || arm <> best THEN best END AS fallback_from FROM u JOIN b USING (cluster) WHERE j = 1""")
def w15_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _scores(spark, sf_dir)
    usable = s.filter("NOT (pipeline = 'N' AND arm = 'O')").select("pipeline", "arm")
    return S.winners_with_fallback(s, usable, ["cluster"], "rmse", ["pipeline", "arm"]).select("cluster", "pipeline", "arm", "fallback_from")


@register(REGISTRY, """WITH models AS (SELECT l_returnflag AS arm, 'm' || (l_suppkey % 7) AS model, corr(l_quantity, l_extendedprice) AS r2, stddev_pop(l_tax) * 10 AS rmse_p90 FROM lineitem GROUP BY 1, 2),
c AS (SELECT *, max(r2) OVER (PARTITION BY arm) AS b FROM models)
SELECT arm, model FROM (SELECT *, row_number() OVER (PARTITION BY arm ORDER BY rmse_p90, model) AS k FROM c WHERE r2 >= b - 0.05) WHERE k = 1""")
def w16_champion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.champion(_models(spark, sf_dir), ["arm"]).select("arm", "model")


_SPLIT_SCORES = """scores AS (SELECT l_returnflag AS arm, 'm' || (l_suppkey % 7) AS model, CASE WHEN l_linestatus = 'O' THEN 'val' ELSE 'test' END AS split, corr(l_quantity, l_extendedprice) AS r2, stddev_pop(l_tax) * 10 AS rmse_p90 FROM lineitem GROUP BY 1, 2, 3),
val AS (SELECT *, r2 >= max(r2) OVER (PARTITION BY arm) - 0.05 AS near FROM scores WHERE split = 'val'),
r AS (SELECT *, row_number() OVER (PARTITION BY arm ORDER BY r2 DESC, model) AS k1, row_number() OVER (PARTITION BY arm ORDER BY rmse_p90, model) AS k2, row_number() OVER (PARTITION BY arm ORDER BY near DESC, rmse_p90, model) AS k3 FROM val),
picks AS (SELECT arm, rule, c.model, t.r2 AS test_r2, t.rmse_p90 AS test_rmse_p90 FROM (SELECT arm, model, 'r2' AS rule FROM r WHERE k1 = 1 UNION ALL SELECT arm, model, 'rmse_p90' FROM r WHERE k2 = 1 UNION ALL SELECT arm, model, 'r2_slack_then_rmse_p90' FROM r WHERE k3 = 1) c JOIN scores t USING (arm, model) WHERE t.split = 'test')"""


def _picks(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = F.concat(F.lit("m"), (F.col("l_suppkey") % 7).cast("string"))
    split = F.when(F.col("l_linestatus") == "O", "val").otherwise("test")
    scores = table(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("arm"), model.alias("model"), split.alias("split")).agg(
        F.corr("l_quantity", "l_extendedprice").alias("r2"), (F.stddev_pop("l_tax") * 10).alias("rmse_p90")
    )
    return S.champion_rules(scores, ["arm"])


@register(REGISTRY, f"WITH {_SPLIT_SCORES} SELECT arm, rule, model, round(test_r2, 6) AS test_r2, round(test_rmse_p90, 6) AS test_rmse_p90 FROM picks")
def w16_champion_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_picks(spark, sf_dir), "test_r2", "test_rmse_p90", places=6)


@register(REGISTRY, f"WITH {_SPLIT_SCORES} SELECT rule, count(*) AS n, count(DISTINCT model) AS n_models, round(avg(test_r2), 6) AS test_r2, round(avg(test_rmse_p90), 6) AS test_rmse_p90 FROM picks GROUP BY 1")
def w16_rule_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(S.rule_summary(_picks(spark, sf_dir)), "test_r2", "test_rmse_p90", places=6)


def _models(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = F.concat(F.lit("m"), (F.col("l_suppkey") % 7).cast("string"))
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("arm"), model.alias("model")).agg(
        F.corr("l_quantity", "l_extendedprice").alias("r2"), (F.stddev_pop("l_tax") * 10).alias("rmse_p90")
    )


#: Scores of arms, seasons, models and splits in two runs; some are unknown, some models diverge, some lack a test row.
_SCORES = """scores AS (SELECT l_returnflag AS arm, quarter(l_shipdate) AS season, 'm' || l_suppkey % 13 AS model, CASE WHEN month(l_shipdate) % 3 = 0 THEN 'test' ELSE 'val' END AS split, l_linenumber % 2 AS tag,
 round(sum(l_discount) * 100, 0) / count(*) / 100 AS r2, round(sum(l_tax) * 100, 0) / count(*) / 10 AS rmse_p90, sum(l_quantity) / count(*) AS rmse, count(*) FILTER (l_orderkey % 997 = 3) AS n_nonfinite FROM lineitem GROUP BY ALL),
board AS (SELECT arm, season, model, split, CASE WHEN model = 'm4' THEN NULL ELSE avg(r2) END AS r2, avg(rmse_p90) AS rmse_p90, avg(rmse) AS rmse, sum(n_nonfinite)::BIGINT AS n_nonfinite FROM scores WHERE NOT (model = 'm2' AND split = 'test') GROUP BY 1, 2, 3, 4)"""


def _board(spark: SparkSession, sf_dir: str) -> DataFrame:
    l, n = table(spark, sf_dir, "lineitem"), F.count("*")  # hundredths summed as whole numbers: the same doubles in any order
    split = F.when(F.month("l_shipdate") % 3 == 0, "test").otherwise("val")
    model = F.concat(F.lit("m"), (F.col("l_suppkey") % 13).cast("string"))
    by_tag = l.groupBy(
        F.col("l_returnflag").alias("arm"), F.quarter("l_shipdate").cast("long").alias("season"), model.alias("model"), split.alias("split"), (F.col("l_linenumber") % 2).alias("tag")
    ).agg(
        (F.round(F.sum("l_discount") * 100, 0) / n / 100).alias("r2"), (F.round(F.sum("l_tax") * 100, 0) / n / 10).alias("rmse_p90"), (F.sum("l_quantity") / n).alias("rmse"),
        F.count_if(F.col("l_orderkey") % 997 == 3).alias("n_nonfinite"),
    )
    board = by_tag.filter("NOT (model = 'm2' AND split = 'test')").groupBy("arm", "season", "model", "split").agg(
        *(F.avg(c).alias(c) for c in ("r2", "rmse_p90", "rmse")), F.sum("n_nonfinite").alias("n_nonfinite")
    )
    return board.withColumn("r2", F.when(F.col("model") != "m4", F.col("r2")))


@register(REGISTRY, f"""WITH RECURSIVE {_SCORES}, sound AS (SELECT *, r2 >= max(r2) OVER (PARTITION BY arm, season) - 0.003 AS near FROM board WHERE split = 'val' AND r2 IS NOT NULL AND rmse_p90 IS NOT NULL AND n_nonfinite = 0),
queue AS (SELECT *, row_number() OVER (PARTITION BY arm, season ORDER BY near DESC, CASE WHEN near THEN rmse_p90 ELSE -r2 END, model) AS pos FROM sound),
step AS (SELECT arm, season, 0::BIGINT AS pos, []::STRUCT(model VARCHAR, r2 DOUBLE, p90 DOUBLE, omitted VARCHAR[])[] AS taken FROM (SELECT DISTINCT arm, season FROM queue)
 UNION ALL SELECT arm, season, s.pos + 1, CASE WHEN len(twins) = 0 THEN list_append(taken, {{'model': model, 'r2': r2, 'p90': rmse_p90, 'omitted': []::VARCHAR[]}})
   ELSE list_transform(taken, lambda e: CASE WHEN e.model = twins[1].model THEN {{'model': e.model, 'r2': e.r2, 'p90': e.p90, 'omitted': list_append(e.omitted, model)}} ELSE e END) END
 FROM (SELECT s.*, q.model, q.r2, q.rmse_p90, list_filter(taken, lambda e: abs(e.r2 - q.r2) <= 0.0004 AND abs(e.p90 - q.rmse_p90) <= 0.004) AS twins FROM step s JOIN queue q ON q.arm = s.arm AND q.season = s.season AND q.pos = s.pos + 1 WHERE len(taken) < 4) s),
done AS (SELECT arm, season, unnest(taken) AS e, generate_subscripts(taken, 1) AS rank FROM (SELECT arm, season, first(taken ORDER BY pos DESC) AS taken FROM step GROUP BY 1, 2))
SELECT d.arm, d.season, d.rank::BIGINT AS rank, e.model AS model, e.r2 AS r2_val, e.p90 AS rmse_p90_val, t.r2 AS r2_test, t.rmse AS rmse_test, t.rmse_p90 AS rmse_p90_test, round(e.r2 - t.r2, 8) AS gap_r2, array_to_string(e.omitted, ', ') AS omitted
FROM done d LEFT JOIN board t ON t.arm = d.arm AND t.season = d.season AND t.model = e.model AND t.split = 'test'""")
def w17_top_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    top = S.top_models(_board(spark, sf_dir), ["arm", "season"], 4, slack=0.003, same_r2=0.0004, same_p90=0.004)
    return rounded(top.withColumn("rank", F.col("rank").cast("long")), "gap_r2", places=8)


@register(REGISTRY, f"WITH {HOURLY} SELECT station, kind, ts, value FROM (SELECT *, row_number() OVER (PARTITION BY station, kind ORDER BY ts DESC, value) AS k FROM hourly) WHERE k = 1")
def w18_keep_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("station", "kind").orderBy(F.desc("ts"), "value")
    return hourly(spark, sf_dir).withColumn("k", F.row_number().over(w)).filter("k = 1").drop("k")


@register(REGISTRY, """WITH s AS (SELECT o_custkey AS pipeline, CASE o_orderstatus WHEN 'O' THEN 'test' WHEN 'F' THEN 'common_test' ELSE 'val' END AS split, count(*) AS n FROM orders GROUP BY 1, 2),
p AS (SELECT *, CASE split WHEN 'common_test' THEN '0' WHEN 'test' THEN '1' ELSE '2' || split END AS o FROM s) SELECT pipeline, split, n FROM (SELECT *, min(o) OVER (PARTITION BY pipeline) AS m FROM p) WHERE o = m""")
def w19_preferred_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    split = F.when(F.col("o_orderstatus") == "O", "test").when(F.col("o_orderstatus") == "F", "common_test").otherwise("val")
    s = o.groupBy(F.col("o_custkey").alias("pipeline"), split.alias("split")).agg(F.count("*").alias("n"))
    return S.preferred_split(s, ["pipeline"])


@register(REGISTRY, f"WITH {PANEL} SELECT station, day, y = max(y) OVER (PARTITION BY cluster, day) AS best FROM panel")
def w20_best_in_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    return panel(spark, sf_dir).select("station", "day", (F.col("y") == F.max("y").over(Window.partitionBy("cluster", "day"))).alias("best"))


@register(REGISTRY, f"WITH {PANEL}, q AS (SELECT station, quantile_cont(y, 0.9) AS q FROM panel GROUP BY 1) SELECT station, day, y >= q AS extreme FROM panel JOIN q USING (station)")
def w21_station_quantile(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = panel(spark, sf_dir)
    return p.join(p.groupBy("station").agg(F.percentile("y", F.lit(0.9)).alias("q")), "station").select("station", "day", (F.col("y") >= F.col("q")).alias("extreme"))


@register(REGISTRY, """SELECT name, regexp_replace(name, '(_(lag[0-9]+[hd]?|max_prev[0-9]+h|roll[0-9]+[hd]?|mean|max|min|std|diff|range))+$', '') AS variable,
 coalesce(try_cast(regexp_extract(name, '(lag|prev|delta|tend_?)([0-9]+)h$', 2) AS INT), 0) AS hours, ceil(max(coalesce(try_cast(regexp_extract(name, '(lag|prev|delta|tend_?)([0-9]+)h$', 2) AS INT), 0)) OVER (PARTITION BY event_type) / 24)::INT AS purge_days
FROM (SELECT event_type, event_type || suffix AS name FROM (SELECT DISTINCT event_type FROM events) CROSS JOIN (VALUES ('_max'), ('_lag3h'), ('_max_prev6h'), ('_roll24h_mean'), ('_lag2'), ('_tend_30h'), ('_delta3h'), ('')) t(suffix))""")
def p17_p18_column_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = table(spark, sf_dir, "events").select("event_type").distinct()
    suffix = F.explode(F.array(*map(F.lit, ("_max", "_lag3h", "_max_prev6h", "_roll24h_mean", "_lag2", "_tend_30h", "_delta3h", ""))))
    names = kinds.withColumn("s", suffix).select("event_type", F.concat("event_type", "s").alias("name"))
    named = names.select("event_type", "name", variable_of(F.col("name")).alias("variable"), lookback_hours(F.col("name")).alias("hours"))
    gaps = named.groupBy("event_type").agg(purge_days(F.col("hours")).alias("purge_days"))
    return named.join(gaps, "event_type").drop("event_type")
