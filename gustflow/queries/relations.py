"""Joins, projections, set operations, sorts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import features as X
from ..operators import relations as R
from ..operators import selection as S
from .tables import HOURLY, PANEL, hourly, panel, register, rounded, table

REGISTRY: dict = {}

_CLIM = "clim AS (SELECT station, dayofyear(day) AS doy, avg(y) AS clim FROM panel GROUP BY 1, 2)"


@register(REGISTRY, f"WITH {PANEL}, f AS (SELECT l_suppkey AS station, CAST(l_shipdate AS DATE) AS day, sum(l_quantity) AS quantity FROM lineitem GROUP BY 1, 2) SELECT station, day, y, quantity FROM panel JOIN f USING (station, day)")
def j04_one_to_one_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("station"), F.to_date("l_shipdate").alias("day")).agg(F.sum("l_quantity").alias("quantity"))
    return R.validated_join(panel(spark, sf_dir).select("station", "day", "y"), f, ["station", "day"])


@register(REGISTRY, f"WITH {PANEL}, {_CLIM} SELECT p.station, p.day, round(p.y - c.clim, 4) AS anomaly FROM panel p LEFT JOIN clim c ON c.station = p.station AND c.doy = dayofyear(p.day)")
def j05_many_to_one_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = panel(spark, sf_dir).withColumn("doy", F.dayofyear("day"))
    joined = R.validated_join(p, X.climatology(p, "station", "day", "y"), ["station", "doy"], "left", "many_to_one")
    return rounded(joined.select("station", "day", (F.col("y") - F.col("clim")).alias("anomaly")), "anomaly")


_TWO = """a AS (SELECT user_id AS station, CAST(ts AS DATE) AS day, max(value) AS v FROM events WHERE event_type IN ('view', 'click') GROUP BY 1, 2),
b AS (SELECT user_id AS station, CAST(ts AS DATE) AS day, min(value) AS v FROM events WHERE event_type NOT IN ('view', 'click') GROUP BY 1, 2)"""


def _two(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    e = table(spark, sf_dir, "events").withColumn("day", F.to_date("ts"))
    key = [F.col("user_id").alias("station"), "day"]
    a = e.filter("event_type IN ('view', 'click')").groupBy(*key).agg(F.max("value").alias("v"))
    b = e.filter("event_type NOT IN ('view', 'click')").groupBy(*key).agg(F.min("value").alias("v"))
    return a, b


@register(REGISTRY, f"WITH {_TWO}, d AS (SELECT day FROM a INTERSECT SELECT day FROM b) SELECT coalesce(a.station, b.station) AS station, coalesce(a.day, b.day) AS day, coalesce(a.v, b.v) AS v FROM a FULL JOIN b ON a.station = b.station AND a.day = b.day WHERE coalesce(a.day, b.day) IN (SELECT day FROM d)")
def j06_override_on_common_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.override_on_common(*_two(spark, sf_dir), ["station", "day"], ["day"], ["v"])


@register(REGISTRY, f"WITH {_TWO} SELECT coalesce(a.station, b.station) AS station, coalesce(a.day, b.day) AS day, coalesce(a.v, b.v) AS v FROM a FULL JOIN b ON a.station = b.station AND a.day = b.day")
def j07_combine_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.combine_first(*_two(spark, sf_dir), ["station", "day"], ["v"])


@register(REGISTRY, f"WITH {PANEL} SELECT station, day, y, n_name FROM panel LEFT JOIN nation ON n_nationkey = cluster")
def j08_static_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("cluster"), "n_name")
    return panel(spark, sf_dir).join(names, "cluster", "left").select("station", "day", "y", "n_name")


@register(REGISTRY, "SELECT c_custkey AS station, EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey) AS observed FROM customer")
def j09_semi_and_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("station"))
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("station"))
    return c.join(o, "station", "left_semi").withColumn("observed", F.lit(True)).unionByName(c.join(o, "station", "left_anti").withColumn("observed", F.lit(False)))


@register(REGISTRY, "SELECT o_orderkey AS station, round(c_acctbal, 2) AS latitude, c_nationkey AS longitude FROM orders LEFT JOIN customer ON c_custkey = o_custkey")
def j10_coordinate_backfill(spark: SparkSession, sf_dir: str) -> DataFrame:
    dim = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), F.round("c_acctbal", 2).alias("latitude"), F.col("c_nationkey").alias("longitude"))
    return table(spark, sf_dir, "orders").join(dim, "o_custkey", "left").select(F.col("o_orderkey").alias("station"), "latitude", "longitude")


@register(REGISTRY, f"""WITH {HOURLY}, p AS (SELECT station, ts, row_number() OVER (PARTITION BY station, CAST(ts AS DATE) ORDER BY value DESC, ts) AS k FROM hourly)
SELECT h.station, h.ts, h.kind, h.value FROM hourly h JOIN p ON p.k = 1 AND p.station = h.station AND p.ts = h.ts""")
def j11_peak_row_fetch(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = hourly(spark, sf_dir)
    return R.fetched_rows(h, X.peak_rows(h, ["station"], "ts", "value").select("station", "ts"), ["station", "ts"])


_HOURS = "g AS (SELECT user_id % 5 AS station, date_trunc('hour', ts) AS ts, max(value) AS value FROM events GROUP BY 1, 2)"


@register(REGISTRY, f"""WITH {_HOURS}, k AS (SELECT station, ts FROM g WHERE hour(ts) = 12), s AS (SELECT k.station, k.ts, g.value FROM k LEFT JOIN g ON g.station = k.station AND g.ts BETWEEN k.ts - INTERVAL 5 HOURS AND k.ts)
SELECT station, ts, count(value) AS known, round(sum(value), 4) AS total FROM s GROUP BY 1, 2""")
def j12_sequence_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = table(spark, sf_dir, "events").groupBy((F.col("user_id") % 5).alias("station"), F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("ts")).agg(F.max("value").alias("value"))
    w = R.sequences_at(g, g.filter(F.hour("ts") == 12), "station", "ts", "value", 6)
    known = F.filter("window", lambda v: v.isNotNull())
    return rounded(w.select("station", "ts", F.size(known).cast("long").alias("known"), F.aggregate(known, F.lit(0.0), lambda a, v: a + v).alias("total")), "total")


@register(REGISTRY, """WITH n AS (SELECT a.s_nationkey AS cluster, (a.s_nationkey + 1) % 25 AS other FROM (SELECT DISTINCT s_nationkey FROM supplier) a),
r AS (SELECT l_suppkey % 25 AS cluster, CASE WHEN month(l_shipdate) IN (1, 4, 7, 10) THEN 'test' ELSE 'train' END AS split, l_quantity AS q FROM lineitem),
u AS (SELECT cluster AS for_cluster, split, q FROM r UNION ALL SELECT n.cluster, split, q FROM r JOIN n ON n.other = r.cluster WHERE split = 'train')
SELECT for_cluster, split, count(*) AS n, sum(q) AS total FROM u GROUP BY 1, 2""")
def j15_neighbour_training(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").cast("long").alias("cluster")).distinct().withColumn("other", (F.col("cluster") + 1) % 25)
    split = F.when(F.month("l_shipdate").isin(1, 4, 7, 10), "test").otherwise("train")
    r = table(spark, sf_dir, "lineitem").select((F.col("l_suppkey") % 25).alias("cluster"), split.alias("split"), F.col("l_quantity").alias("q"))
    return R.with_neighbour_training(r, n, "cluster", "split").groupBy("for_cluster", "split").agg(F.count("*").alias("n"), F.sum("q").alias("total"))


@register(REGISTRY, f"""WITH {PANEL}, p AS (SELECT station % 3 AS arm, cluster, season, station, day, y, pred FROM panel), m AS (SELECT arm, cluster, season, avg((pred - y) * (pred - y)) AS mse FROM p GROUP BY 1, 2, 3),
w AS (SELECT arm, cluster, season FROM (SELECT *, row_number() OVER (PARTITION BY cluster, season ORDER BY mse, arm) AS k FROM m) WHERE k = 1)
SELECT station, day, season, round(pred - y, 8) AS residual FROM p JOIN w USING (arm, cluster, season)""")
def j16_winner_stitching(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = panel(spark, sf_dir).withColumn("arm", F.col("station") % 3)
    e = F.col("pred") - F.col("y")
    m = p.groupBy("arm", "cluster", "season").agg(F.avg(e * e).alias("rmse"))
    w = S.winners(m, ["cluster", "season"], "rmse", ["arm"]).select("arm", "cluster", "season")
    return rounded(p.join(w, ["arm", "cluster", "season"]).select("station", "day", "season", e.alias("residual")), "residual", places=8)


@register(REGISTRY, """WITH r AS (SELECT s_nationkey AS cluster, l_returnflag AS arm, CAST(l_shipdate AS DATE) AS day, l_quantity AS q FROM lineitem JOIN supplier ON s_suppkey = l_suppkey),
n AS (SELECT cluster, count(DISTINCT arm) AS c FROM r GROUP BY 1), d AS (SELECT cluster, day FROM r GROUP BY 1, 2 HAVING count(DISTINCT arm) = any_value((SELECT c FROM n WHERE n.cluster = r.cluster)))
SELECT cluster, arm, count(*) AS n, sum(q) AS total FROM r SEMI JOIN d USING (cluster, day) GROUP BY 1, 2""")
def j17_common_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("cluster"))
    r = table(spark, sf_dir, "lineitem").join(s, "l_suppkey").select("cluster", F.col("l_returnflag").alias("arm"), F.to_date("l_shipdate").alias("day"), F.col("l_quantity").alias("q"))
    return S.common_dates(r, ["cluster"], ["arm"], "day").groupBy("cluster", "arm").agg(F.count("*").alias("n"), F.sum("q").alias("total"))


@register(REGISTRY, f"WITH {PANEL}, f AS (SELECT station, dense_rank() OVER (PARTITION BY cluster ORDER BY station) - 1 AS fold FROM (SELECT DISTINCT station, cluster FROM panel)) SELECT fold, count(*) FILTER (station % 5 <> 0) AS train, count(*) FILTER (station % 5 = 0) AS held FROM panel JOIN f USING (station) GROUP BY 1")
def j19_x14_leave_one_out_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = panel(spark, sf_dir)
    folds = p.select("station", "cluster").distinct().withColumn("fold", (F.dense_rank().over(Window.partitionBy("cluster").orderBy("station")) - 1).cast("long")).select("station", "fold")
    return p.join(folds, "station").groupBy("fold").agg(F.count_if(F.col("station") % 5 != 0).alias("train"), F.count_if(F.col("station") % 5 == 0).alias("held"))


@register(REGISTRY, "SELECT a.s_suppkey AS station, a.s_acctbal AS static, b.s_acctbal AS perm_static FROM supplier a JOIN supplier b ON b.s_suppkey = CASE WHEN EXISTS (SELECT 1 FROM supplier c WHERE c.s_suppkey = a.s_suppkey + 1) THEN a.s_suppkey + 1 ELSE (SELECT min(s_suppkey) FROM supplier) END")
def j20_donor_mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("station"), F.col("s_acctbal").alias("static"))
    w = Window.orderBy("station")
    donors = s.select("station", F.coalesce(F.lead("station").over(w), F.first("station").over(w)).alias("donor"))
    return R.with_donors(s, donors, "station", ["static"])


@register(REGISTRY, """WITH v AS (SELECT l_suppkey AS model, avg(l_tax) AS a FROM lineitem WHERE l_returnflag = 'A' GROUP BY 1), t AS (SELECT l_suppkey AS model, avg(l_tax) AS b FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1)
SELECT model, round(a, 6) AS val, round(b, 6) AS test, round(100 * (b - a) / nullif(a, 0), 4) AS gap FROM v LEFT JOIN t USING (model)""")
def j21_j22_leaderboard_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    mean = lambda f, n: table(spark, sf_dir, "lineitem").filter(f).groupBy(F.col("l_suppkey").alias("model")).agg(F.avg("l_tax").alias(n))
    j = mean("l_returnflag = 'A'", "val").join(mean("l_returnflag = 'R'", "test"), "model", "left")
    gap = 100 * (F.col("test") - F.col("val")) / F.nullif(F.col("val"), F.lit(0.0))
    return rounded(rounded(j.withColumn("gap", gap), "val", "test", places=6), "gap")


@register(REGISTRY, f"WITH {PANEL} SELECT station, count(*) AS n FROM panel WHERE day BETWEEN DATE '1997-03-01' AND DATE '1998-02-28' GROUP BY 1")
def j23_time_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return panel(spark, sf_dir).filter(F.col("day").between(F.lit("1997-03-01").cast("date"), F.lit("1998-02-28").cast("date"))).groupBy("station").agg(F.count("*").alias("n"))


@register(REGISTRY, "SELECT l_suppkey AS station FROM lineitem INTERSECT SELECT s_suppkey FROM supplier INTERSECT SELECT user_id FROM events")
def j24_u02_station_intersection(spark: SparkSession, sf_dir: str) -> DataFrame:
    pick = lambda t, c: table(spark, sf_dir, t).select(F.col(c).alias("station"))
    return pick("lineitem", "l_suppkey").intersect(pick("supplier", "s_suppkey")).intersect(pick("events", "user_id"))


@register(REGISTRY, f"WITH {PANEL} SELECT count(*) AS pairs, round(max(abs(y - pred)), 4) AS greatest FROM panel")
def j25_greatest_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = panel(spark, sf_dir)
    return rounded(R.greatest_difference(p.select("station", "day", F.col("y").alias("v")), p.select("station", "day", F.col("pred").alias("v")), ["station", "day"], "v"), "greatest")


@register(REGISTRY, f"""WITH {PANEL}, c AS (SELECT station, day AS centre FROM (SELECT *, row_number() OVER (PARTITION BY station ORDER BY y DESC, day) AS k FROM panel) WHERE k <= 2)
SELECT p.station, c.centre, p.day, p.y FROM panel p JOIN c ON c.station = p.station AND p.day BETWEEN c.centre - 10 AND c.centre + 10""")
def j26_range_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = panel(spark, sf_dir)
    w = Window.partitionBy("station").orderBy(F.desc("y"), "day")
    top = p.withColumn("k", F.row_number().over(w)).filter("k <= 2").select("station", "day")
    return R.within_days(p, top, "station", "day", 10).select("station", "centre", "day", "y")


@register(REGISTRY, "SELECT 'lineitem' AS name, true AS same UNION ALL SELECT 'shifted', false")
def j27_u07_same_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber")
    b = a.repartition("l_linenumber", "l_orderkey").withColumn("l_linenumber", F.col("l_linenumber") + 1)
    named = lambda name, other: R.compared_rows(a, other).select(F.lit(name).alias("name"), "same")
    return named("lineitem", a.repartition("l_orderkey")).unionByName(named("shifted", b))


@register(REGISTRY, """SELECT vec_id, round(sqrt(u * u + v * v), 6) AS speed, round(sqrt((a - u) * (a - u) + (b - v) * (b - v)), 6) AS shear, round(sin(atan2(v, u)), 6) AS sin_dir, round(cos(atan2(v, u)), 6) AS cos_dir
FROM (SELECT vec_id, embedding[1]::DOUBLE AS u, embedding[2]::DOUBLE AS v, embedding[3]::DOUBLE AS a, embedding[4]::DOUBLE AS b FROM embeddings)""")
def p01_p02_p06_wind_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    u, v, a, b = (F.get("embedding", F.lit(k)).cast("double") for k in range(4))
    s, c = C.direction_parts(u, v)
    out = table(spark, sf_dir, "embeddings").select("vec_id", C.wind_speed(u, v).alias("speed"), C.wind_shear(a, b, u, v).alias("shear"), s.alias("sin_dir"), c.alias("cos_dir"))
    return rounded(out, "speed", "shear", "sin_dir", "cos_dir", places=6)


@register(REGISTRY, """SELECT l_orderkey, l_linenumber, round(l_quantity / greatest(l_tax, 0.1), 6) AS factor, round(least(greatest(l_extendedprice / 1000, 0), 80), 6) AS clipped,
 round(l_extendedprice / 9.80665, 6) AS height, round(l_quantity / greatest(l_discount, 0.1) * greatest(l_discount, 0.1), 6) AS back,
 round(least(greatest(100 * exp(17.625 * l_tax * 100 / (l_tax * 100 + 243.04)) / exp(17.625 * l_quantity / (l_quantity + 243.04)), 0), 100), 4) AS humidity FROM lineitem""")
def p03_p04_p09_p15_p16_physics(spark: SparkSession, sf_dir: str) -> DataFrame:
    q, tax, d = F.col("l_quantity"), F.col("l_tax"), F.col("l_discount")
    out = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", C.gust_factor(q, tax).alias("factor"), C.clipped(F.col("l_extendedprice") / 1000).alias("clipped"),
        C.geopotential_height(F.col("l_extendedprice")).alias("height"), C.from_ratio(C.ratio_target(q, d), d).alias("back"),
        C.relative_humidity(q + 273.15, tax * 100 + 273.15).alias("humidity"),
    )
    return rounded(rounded(out, "factor", "clipped", "height", "back", places=6), "humidity")


@register(REGISTRY, f"WITH {PANEL} SELECT DISTINCT day, season, round(sin(2 * pi() * dayofyear(day) / 365.25), 6) AS sin_doy, round(cos(2 * pi() * month(day) / 12), 6) AS cos_month FROM panel")
def p07_p10_seasonality(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, _ = C.day_of_year_parts(F.col("day"))
    _, c = C.month_parts(F.col("day"))
    return rounded(panel(spark, sf_dir).select("day", "season", s.alias("sin_doy"), c.alias("cos_month")).distinct(), "sin_doy", "cos_month", places=6)


@register(REGISTRY, """WITH r AS (SELECT user_id % 7 AS cluster, user_id AS station, event_id, CASE WHEN event_id % 17 = 0 THEN NULL ELSE value END AS a, CASE WHEN user_id = 8 THEN NULL ELSE value END AS nf_b FROM events),
g AS (SELECT cluster FROM (SELECT cluster, station, count(nf_b) > 0 AS has FROM r GROUP BY 1, 2) GROUP BY 1 HAVING bool_and(has)) SELECT cluster, count(*) AS n FROM r SEMI JOIN g USING (cluster) WHERE a IS NOT NULL AND nf_b IS NOT NULL GROUP BY 1""")
def p12_p13_complete_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    r = e.select((F.col("user_id") % 7).alias("cluster"), F.col("user_id").alias("station"), F.when(F.col("event_id") % 17 != 0, F.col("value")).alias("a"), F.when(F.col("user_id") != 8, F.col("value")).alias("nf_b"))
    return X.complete_rows(r, ["a"], "cluster", "station", ["nf_b"]).groupBy("cluster").agg(F.count("*").alias("n"))


@register(REGISTRY, "SELECT s_suppkey, CASE WHEN s_nationkey IN (1, 2, 3) THEN '1-2-3' WHEN s_nationkey IN (5, 6) THEN '5-6' ELSE s_nationkey::VARCHAR END AS label FROM supplier")
def p14_cluster_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").select("s_suppkey", R.merged_label(F.col("s_nationkey"), R.parse_merges("1-2-3,5-6")).alias("label"))


@register(REGISTRY, "SELECT 'a' AS \"column\", avg(CASE WHEN event_id % 17 = 0 THEN 1.0 ELSE 0.0 END)::DOUBLE AS share FROM events UNION ALL SELECT 'value', avg(CASE WHEN value IS NULL THEN 1.0 ELSE 0.0 END)::DOUBLE FROM events")
def p19_null_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").withColumn("a", F.when(F.col("event_id") % 17 != 0, F.col("value")))
    return X.null_shares(e, ["a", "value"])


@register(REGISTRY, """SELECT label, TRY_CAST(TRY_CAST(label AS DOUBLE) AS INT) AS cluster FROM (SELECT DISTINCT CASE s_nationkey % 3 WHEN 0 THEN s_nationkey || '.0' WHEN 1 THEN s_nationkey || '-2' ELSE s_nationkey::VARCHAR END AS label FROM supplier)""")
def p24_cluster_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("s_nationkey").cast("string")
    label = F.when(F.col("s_nationkey") % 3 == 0, F.concat(n, F.lit(".0"))).when(F.col("s_nationkey") % 3 == 1, F.concat(n, F.lit("-2"))).otherwise(n)
    return table(spark, sf_dir, "supplier").select(label.alias("label")).distinct().withColumn("cluster", C.cluster_number(F.col("label")))


@register(REGISTRY, "SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN p_size::VARCHAR ELSE replace((p_size + 0.5)::DOUBLE::VARCHAR, '.', 'p') END AS level FROM part")
def p25_level_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    level = F.when(F.col("p_size") % 2 == 0, F.col("p_size").cast("double")).otherwise(F.col("p_size") + 0.5)
    return table(spark, sf_dir, "part").select("p_partkey", C.level_label(level).alias("level"))


@register(REGISTRY, """SELECT k, round(((degrees(atan2(-u, -v)) + 360) % 360), 6) AS degrees FROM (SELECT event_id AS k, -sin(radians(value)) AS u, -cos(radians(value)) AS v FROM events)""")
def p26_circular(spark: SparkSession, sf_dir: str) -> DataFrame:
    u, v = C.vector_from_direction(F.col("value"))
    return rounded(table(spark, sf_dir, "events").select(F.col("event_id").alias("k"), C.direction_from_vector(u, v).alias("degrees")), "degrees", places=6)


@register(REGISTRY, "SELECT event_id, CASE WHEN isnan(x) OR isinf(x) THEN NULL ELSE x END AS value FROM (SELECT event_id, CASE WHEN event_id % 11 = 0 THEN 'NaN'::DOUBLE WHEN event_id % 13 = 0 THEN 'Infinity'::DOUBLE ELSE value END AS x FROM events)")
def s12_missing_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = F.when(F.col("event_id") % 11 == 0, float("nan")).when(F.col("event_id") % 13 == 0, float("inf")).otherwise(F.col("value"))
    return table(spark, sf_dir, "events").select("event_id", C.present(x).alias("value"))


@register(REGISTRY, "SELECT l_orderkey, l_quantity FROM lineitem WHERE l_suppkey IN (1, 3, 5)")
def s08_projected_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").filter(F.col("l_suppkey").isin(1, 3, 5)).select("l_orderkey", "l_quantity")


@register(REGISTRY, "SELECT o_custkey AS name, max_by(o_orderkey, (o_orderdate, o_orderkey)) AS latest FROM orders GROUP BY 1")
def s20_latest_experiment(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").withColumn("at", F.struct("o_orderdate", "o_orderkey")).select(F.col("o_custkey").alias("name"), F.col("o_orderkey").alias("latest"), "at")
    return R.latest(o, ["name"], "latest", "at")


@register(REGISTRY, "SELECT event_id, value AS pred FROM events")
def s21_column_synonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.first_present(table(spark, sf_dir, "events"), ["y_pred", "prediction", "value"], "pred").select("event_id", "pred")


@register(REGISTRY, "SELECT 'a' AS kind, s_suppkey AS k, s_name AS name, NULL::DOUBLE AS balance FROM supplier UNION ALL SELECT 'b', c_custkey, NULL, c_acctbal FROM customer")
def u01_union_by_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "supplier").select(F.lit("a").alias("kind"), F.col("s_suppkey").alias("k"), F.col("s_name").alias("name"))
    b = table(spark, sf_dir, "customer").select(F.lit("b").alias("kind"), F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("balance"))
    return a.unionByName(b, allowMissingColumns=True)


@register(REGISTRY, "SELECT user_id AS station FROM events EXCEPT SELECT s_suppkey FROM supplier")
def u04_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("station")).subtract(table(spark, sf_dir, "supplier").select("s_suppkey"))


@register(REGISTRY, "SELECT CAST(ts AS DATE) AS day FROM events UNION SELECT CAST(o_orderdate AS DATE) FROM orders")
def u03_union_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.to_date("ts").alias("day")).union(table(spark, sf_dir, "orders").select(F.to_date("o_orderdate"))).distinct()


@register(REGISTRY, "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 5")
def t02_top_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A top-k report."""
    return table(spark, sf_dir, "orders").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(5).select("o_orderkey", "o_totalprice")


@register(REGISTRY, "SELECT c_nationkey AS cluster, max_by(c_custkey, (c_acctbal, -c_custkey)) AS best, min_by(c_custkey, (c_acctbal, c_custkey)) AS worst FROM customer GROUP BY 1")
def t03_t04_best_and_worst(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    return c.groupBy(F.col("c_nationkey").alias("cluster")).agg(
        F.max_by("c_custkey", F.struct(F.col("c_acctbal"), -F.col("c_custkey"))).alias("best"), F.min_by("c_custkey", F.struct("c_acctbal", "c_custkey")).alias("worst")
    )


@register(REGISTRY, "SELECT c_custkey, place FROM (SELECT c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal, c_custkey) AS place FROM customer) WHERE place BETWEEN 5 AND 8")
def t06_middle_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("c_nationkey").orderBy("c_acctbal", "c_custkey")
    return table(spark, sf_dir, "customer").withColumn("place", F.row_number().over(w).cast("long")).filter("place BETWEEN 5 AND 8").select("c_custkey", "place")


@register(REGISTRY)
def p28_control_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.noise_columns(panel(spark, sf_dir).select("station", "day"), ["station", "day"], 42)
