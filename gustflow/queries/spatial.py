"""Points, polygons, grids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import spatial as G
from ..plans.study import station_clusters
from .tables import register, rounded, table

REGISTRY: dict = {}

#: Regular axes of the made-up grid: first value, step, number of nodes.
LAT, LON = (-20.0, -0.5, 9), (-48.0, 0.5, 11)

_POINTS = "points AS (SELECT c_custkey AS id, -20.0::DOUBLE - (c_custkey % 41) * 0.11::DOUBLE AS lat, -48.0::DOUBLE + (c_custkey % 53) * 0.1::DOUBLE AS lon FROM customer)"
_GRID = "grid AS (SELECT i, j, (-20.0 - 0.5 * i)::DOUBLE AS lat, (-48.0 + 0.5 * j)::DOUBLE AS lon, CASE WHEN i = 4 AND j = 5 THEN NULL ELSE (10.0 * i + j + 0.25 * i * j)::DOUBLE END AS v FROM (SELECT unnest(range(9)) AS i) CROSS JOIN (SELECT unnest(range(11)) AS j))"
_STATIONS = "stations AS (SELECT s_suppkey AS id, -20.0::DOUBLE - (s_suppkey % 13) / 3.0::DOUBLE AS lat, -48.0::DOUBLE + (s_suppkey % 17) / 3.0::DOUBLE AS lon, s_nationkey AS cluster FROM supplier)"


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(k.alias("id"), (-20.0 - (k % 41) * 0.11).alias("lat"), (-48.0 + (k % 53) * 0.1).alias("lon"))


def grid(spark: SparkSession) -> DataFrame:
    i, j = F.col("i"), F.col("j")
    value = F.when(~((i == 4) & (j == 5)), 10.0 * i + j + 0.25 * i * j)
    return spark.range(99).select((F.col("id") / 11).cast("int").alias("i"), (F.col("id") % 11).cast("int").alias("j")).select("i", "j", value.alias("v"))


def stations(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    return table(spark, sf_dir, "supplier").select(k.alias("id"), (-20.0 - (k % 13) / 3.0).alias("lat"), (-48.0 + (k % 17) / 3.0).alias("lon"), F.col("s_nationkey").alias("cluster"))


def station_days(spark: SparkSession, sf_dir: str, where: str = "true") -> DataFrame:
    """id, day, v: the greatest quantity of a station's lines (null: none fits); a month's first day stands for it."""
    fits = F.when(F.expr(where), F.col("l_quantity"))
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("id"), F.trunc("l_shipdate", "month").alias("day")).agg(F.max(fits).alias("v"))


_DAYS = "days AS (SELECT l_suppkey AS id, CAST(date_trunc('month', l_shipdate) AS DATE) AS day, max(l_quantity) AS v FROM lineitem GROUP BY 1, 2)"
_FLAGGED = "l_returnflag = 'R' AND l_linenumber = 1"


@register(REGISTRY, f"WITH {_POINTS} SELECT id, CASE WHEN lon > -47.0 AND lon < -45.0 AND lat > -22.0 AND lat < -21.0 THEN 1 WHEN lon > -45.0 AND lon < -44.0 AND lat > -24.0 AND lat < -22.0 THEN 2 ELSE -1 END AS cluster FROM points")
def j01_point_in_polygon(spark: SparkSession, sf_dir: str) -> DataFrame:
    box = lambda a, b, c, d: [(a, c), (b, c), (b, d), (a, d), (a, c)]
    shapes = [(1, box(-47.0, -45.0, -22.0, -21.0)), (2, box(-45.0, -44.0, -24.0, -22.0))]
    polygons = spark.createDataFrame(shapes, "id int, ring array<struct<x: double, y: double>>")
    return G.assign_polygon(points(spark, sf_dir), polygons, "lon", "lat").select("id", "cluster")


def nation_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, parts, cluster: a square with a square hole and a second square in it for each nation; neighbours overlap."""
    n = F.col("n_nationkey")
    x0, y0 = -48.0 + (n % 5) * 1.0, -24.5 + F.floor(n / 5) * 0.75

    def square(a: float, b: float) -> Column:
        at = lambda dx, dy: F.struct((x0 + dx).alias("x"), (y0 + dy).alias("y"))
        return F.array(at(a, a), at(b, a), at(b, b), at(a, b), at(a, a))

    label = F.when(n % 7 != 3, F.format_string("%02d", n)).otherwise(F.concat(n.cast("string"), F.lit("-x")))
    return table(spark, sf_dir, "nation").select(n.cast("long").alias("shape_id"), F.array(square(0.0, 1.25), square(0.25, 1.0), square(0.5, 0.75)).alias("parts"), label.alias("cluster"))


@register(REGISTRY, f"""WITH {_POINTS}, shapes AS (SELECT n_nationkey AS n, -48.0::DOUBLE + (n_nationkey % 5) AS x, -24.5::DOUBLE + 0.75::DOUBLE * (n_nationkey // 5) AS y FROM nation),
within AS (SELECT id, min(n) AS n FROM points JOIN shapes
  ON (lon > x AND lon < x + 1.25 AND lat > y AND lat < y + 1.25 AND NOT (lon >= x + 0.25 AND lon <= x + 1.0 AND lat >= y + 0.25 AND lat <= y + 1.0))
  OR (lon > x + 0.5 AND lon < x + 0.75 AND lat > y + 0.5 AND lat < y + 0.75) GROUP BY id)
SELECT id, CAST(CASE WHEN n IS NULL OR n % 7 = 3 THEN -1 ELSE n END AS INTEGER) AS cluster_id FROM points LEFT JOIN within USING (id)""")
def j01_parts_and_holes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return station_clusters(points(spark, sf_dir), nation_shapes(spark, sf_dir), "id")


@register(REGISTRY, f"WITH {_POINTS}, {_GRID}, p AS (SELECT *, (lat + 20.0::DOUBLE) / -0.5::DOUBLE AS a, (lon + 48.0::DOUBLE) / 0.5::DOUBLE AS b FROM points) SELECT id, v FROM p LEFT JOIN grid ON i = floor(a + 0.5) AND j = floor(b + 0.5) AND a BETWEEN 0 AND 8 AND b BETWEEN 0 AND 10")
def j02_nearest_node(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.nearest_values(points(spark, sf_dir), grid(spark), LAT, LON, ["v"]).select("id", "v")


@register(REGISTRY, f"""WITH {_POINTS}, {_GRID}, p AS (SELECT *, (lat + 20.0::DOUBLE) / -0.5::DOUBLE AS a, (lon + 48.0::DOUBLE) / 0.5::DOUBLE AS b FROM points),
q AS (SELECT *, least(floor(a), 7) AS i0, least(floor(b), 9) AS j0 FROM p), c AS (SELECT id, a BETWEEN 0 AND 8 AND b BETWEEN 0 AND 10 AS ok, k, i0 + di AS i, j0 + dj AS j,
 (CASE WHEN di = 1 THEN a - i0 ELSE 1 - (a - i0) END) * (CASE WHEN dj = 1 THEN b - j0 ELSE 1 - (b - j0) END) AS w FROM q CROSS JOIN (VALUES (0, 0, 0), (1, 0, 1), (2, 1, 0), (3, 1, 1)) t(k, di, dj)),
m AS (SELECT c.id, c.ok, c.k, c.w, g.v FROM c LEFT JOIN grid g ON g.i = c.i AND g.j = c.j),
f AS (SELECT id, first(v ORDER BY w DESC, k) AS heaviest, sum(w * v) AS s, count(v) AS n, bool_and(ok) AS ok FROM m GROUP BY 1)
SELECT id, round(CASE WHEN NOT ok THEN NULL WHEN n = 4 THEN s ELSE heaviest END, 6) AS v FROM f""")
def j03_bilinear(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(G.bilinear_values(points(spark, sf_dir), grid(spark), "id", LAT, LON, "v"), "v", places=6)


@register(REGISTRY, f"""WITH {_STATIONS}, c AS (SELECT cluster, avg(lat) + cluster * 0.0137::DOUBLE AS lat, avg(lon) AS lon FROM stations GROUP BY 1),
d AS (SELECT a.cluster, b.cluster AS other, row_number() OVER (PARTITION BY a.cluster ORDER BY round(sqrt((a.lat - b.lat) ** 2 + (a.lon - b.lon) ** 2), 9), b.cluster) AS rank FROM c a JOIN c b ON a.cluster <> b.cluster)
SELECT cluster, other, rank FROM d WHERE rank <= 3""")
def j14_neighbour_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = stations(spark, sf_dir).groupBy("cluster").agg((F.avg("lat") + F.col("cluster") * 0.0137).alias("lat"), F.avg("lon").alias("lon"))
    return G.neighbour_clusters(c, 3).select("cluster", "other", F.col("rank").cast("long").alias("rank"))


_NEAR = """near AS (SELECT p.id AS point, s.id, sqrt((s.lat - p.lat) ** 2 + (s.lon - p.lon) ** 2) AS d, row_number() OVER (PARTITION BY p.id ORDER BY sqrt((s.lat - p.lat) ** 2 + (s.lon - p.lon) ** 2), s.id) AS k
 FROM points p CROSS JOIN stations s)"""


def _near(spark: SparkSession, sf_dir: str, k: int = 5) -> DataFrame:
    p = points(spark, sf_dir).withColumnRenamed("id", "point")
    return G.k_nearest(p, stations(spark, sf_dir), k)


def _weights(spark: SparkSession, sf_dir: str, k: int = 5) -> DataFrame:
    return G.idw_weights(_near(spark, sf_dir, k), "point")


@register(REGISTRY, f"WITH {_POINTS}, {_STATIONS}, {_NEAR} SELECT point, id, round(1 / greatest(d, 1e-10) ** 2, 6) AS w FROM near WHERE k <= 5 AND d > 1e-6")
def j18_k_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_weights(spark, sf_dir).filter("w < 1e12"), "w", places=6)


@register(REGISTRY, f"WITH {_POINTS}, {_STATIONS}, {_NEAR}, {_DAYS} SELECT point, day, round(sum(v / greatest(d, 1e-10) ** 2) / sum(1 / greatest(d, 1e-10) ** 2), 5) AS v FROM near JOIN days USING (id) WHERE k <= 5 GROUP BY 1, 2")
def x16_idw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(G.over_places(_near(spark, sf_dir), lambda w: G.idw(w, station_days(spark, sf_dir), "_place", "day", "v"), "point", "day", "v"), "v", places=5)


@register(REGISTRY, f"""WITH {_POINTS}, {_STATIONS}, days AS (SELECT l_suppkey AS id, CAST(date_trunc('month', l_shipdate) AS DATE) AS day, max(l_quantity) AS v FROM lineitem WHERE {_FLAGGED} GROUP BY 1, 2),
 n AS (SELECT p.id AS point, day, v, sqrt((s.lat - p.lat) ** 2 + (s.lon - p.lon) ** 2) AS d, row_number() OVER (PARTITION BY p.id, day ORDER BY sqrt((s.lat - p.lat) ** 2 + (s.lon - p.lon) ** 2), s.id) AS k
 FROM points p CROSS JOIN days t JOIN stations s ON s.id = t.id) SELECT point, day, round(sum(v / greatest(d, 1e-10) ** 2) / sum(1 / greatest(d, 1e-10) ** 2), 5) AS v FROM n WHERE k <= 4 GROUP BY 1, 2""")
def x17_idw_valid_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = points(spark, sf_dir).withColumnRenamed("id", "point")
    flagged = station_days(spark, sf_dir, _FLAGGED)
    return rounded(G.idw_valid_only(p, flagged, stations(spark, sf_dir).drop("cluster"), "point", "day", "v", 4), "v", places=5)


@register(REGISTRY, f"""WITH {_POINTS}, {_STATIONS}, {_NEAR}, {_DAYS}, m AS (SELECT point, day, sum(-sin(radians(v * 7)) / greatest(d, 1e-10) ** 2) / sum(1 / greatest(d, 1e-10) ** 2) AS u, sum(-cos(radians(v * 7)) / greatest(d, 1e-10) ** 2) / sum(1 / greatest(d, 1e-10) ** 2) AS w
 FROM near JOIN days USING (id) WHERE k <= 5 GROUP BY 1, 2) SELECT point, day, round((degrees(atan2(-u, -w)) + 360) % 360, 3) AS v FROM m WHERE abs(u) + abs(w) > 1e-3""")
def x18_idw_direction(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..functions.columns import vector_from_direction

    days = station_days(spark, sf_dir).withColumn("v", F.col("v") * 7)
    out = G.over_places(_near(spark, sf_dir), lambda w: G.idw_direction(w, days, "_place", "day", "v"), "point", "day", "v")
    u, v = vector_from_direction(F.col("v"))
    return rounded(out.filter(F.abs(u) + F.abs(v) > 1e-3), "v", places=3)


@register(REGISTRY, "SELECT vec_id, greatest(embedding[1]::DOUBLE + embedding[2]::DOUBLE, 0) AS corrected, label < 5 AS in_sample FROM embeddings")
def x19_corrected_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").select("vec_id", "label", F.get("embedding", F.lit(0)).cast("double").alias("proxy"), F.get("embedding", F.lit(1)).cast("double").alias("bias"))
    return G.corrected_grid(e, "proxy", "bias", F.col("label") < 5).select("vec_id", "corrected", "in_sample")


@register(REGISTRY, """WITH nodes AS (SELECT c_custkey % 37 AS i, c_nationkey AS j, max(c_acctbal) AS v FROM customer GROUP BY 1, 2)
SELECT row_number() OVER (ORDER BY i, j) - 1 AS cell, (-20.0 - 0.5 * i)::DOUBLE AS lat, (-48.0 + 0.5 * j)::DOUBLE AS lon FROM nodes WHERE v > 1000""")
def t05_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes where customers of some balance live."""
    nodes = table(spark, sf_dir, "customer").groupBy((F.col("c_custkey") % 37).alias("i"), F.col("c_nationkey").alias("j")).agg(F.max("c_acctbal").alias("v"))
    g = nodes.select((-20.0 - 0.5 * F.col("i")).alias("lat"), (-48.0 + 0.5 * F.col("j")).alias("lon"), "v")
    return G.cells(g, F.col("v") > 1000).select(F.col("cell").cast("long").alias("cell"), "lat", "lon")


_REFLECTED = lambda axis, n: f"(CASE WHEN ({axis} + d + {2 * n}) % {2 * n} < {n} THEN ({axis} + d + {2 * n}) % {2 * n} ELSE {2 * n - 1} - ({axis} + d + {2 * n}) % {2 * n} END)"


@register(REGISTRY, f"""WITH sold AS (SELECT year(l_shipdate) AS year, l_suppkey % 9 AS i, l_partkey % 11 AS j, avg(l_quantity) AS v FROM lineitem GROUP BY 1, 2, 3),
t AS (SELECT d, exp(-0.5 * d * d) / sum(exp(-0.5 * d * d)) OVER () AS w FROM (SELECT unnest(range(-4, 5)) AS d)),
g AS (SELECT year, i, j, coalesce(v, 0) AS v FROM (SELECT DISTINCT year FROM sold) CROSS JOIN (SELECT unnest(range(9)) AS i) CROSS JOIN (SELECT unnest(range(11)) AS j) LEFT JOIN sold USING (year, i, j)),
a AS (SELECT g.year, g.i, g.j, sum(w * s.v) AS v FROM g CROSS JOIN t JOIN g s ON s.year = g.year AND s.j = g.j AND s.i = {_REFLECTED('g.i', 9)} GROUP BY 1, 2, 3)
SELECT a.year::INT AS year, a.i::INT AS i, a.j::INT AS j, round(sum(w * s.v), 6) AS v FROM a CROSS JOIN t JOIN a s ON s.year = a.year AND s.i = a.i AND s.j = {_REFLECTED('a.j', 11)} GROUP BY 1, 2, 3""")
def x20_smoothing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quantities sold each year over a grid of suppliers and parts, smoothed; nodes without sales are 0."""
    node = [(F.col("l_suppkey") % 9).cast("int").alias("i"), (F.col("l_partkey") % 11).cast("int").alias("j")]
    sold = table(spark, sf_dir, "lineitem").groupBy(F.year("l_shipdate").alias("year"), *node).agg(F.avg("l_quantity").alias("v"))
    axis = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    every = sold.select("year").distinct().withColumn("i", axis(9)).withColumn("j", axis(11))
    full = every.join(sold, ["year", "i", "j"], "left").fillna(0.0, ["v"])
    return rounded(G.smoothed(full, ["year"], "v", 9, 11), "v", places=6)
