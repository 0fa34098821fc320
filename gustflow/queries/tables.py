"""The roles that the star-schema tables play, in Spark and in SQL.

station: l_suppkey; day: the ship date; y: the day's greatest price; proxy: its mean price; pred: a
linear rescaling of the proxy; cluster: the supplier's nation.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import season

Query = Callable[[SparkSession, str], DataFrame]


def register(registry: dict, sql: str | None = None) -> Callable[[Query], Query]:
    def keep(query: Query) -> Query:
        registry[query.__name__] = (query, sql)
        return query

    return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows of a partition that panels are dealt to.
DEALT = 250_000


def dealt(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """df by its keys, over as many partitions as its number of rows asks for.

    Shuffled rows take far less room than the tables that tasks make of them, so partitions cut by the bytes of a shuffle, or
    a fixed number of them, make tasks that grow with the input. Aggregations by the keys, and by more, need no other shuffle.
    """
    return df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, -(-rows // DEALT)), *keys)


def panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """station, day, y, proxy, pred, cluster, season."""
    lines = table(spark, sf_dir, "lineitem")
    prices = lines.select(F.col("l_suppkey").alias("station"), F.to_date("l_shipdate").alias("day"), "l_extendedprice")
    daily = (
        dealt(prices, lines.count(), "station", "day")  # counted from the files' footers
        .groupBy("station", "day")
        .agg(F.max("l_extendedprice").alias("y"), F.avg("l_extendedprice").alias("proxy"))
        .withColumn("pred", F.col("proxy") * 1.05 + 100.0)
    )
    clusters = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("station"), F.col("s_nationkey").alias("cluster"))
    return daily.join(clusters, "station", "left").withColumn("season", season(F.col("day")))


def hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """station (user), ts, kind, value of the events."""
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("station"), "ts", F.col("event_type").alias("kind"), "value")


PANEL = """
daily AS (
  SELECT l_suppkey AS station, CAST(l_shipdate AS DATE) AS day, max(l_extendedprice) AS y, avg(l_extendedprice) AS proxy
  FROM lineitem GROUP BY 1, 2
), panel AS (
  SELECT d.*, proxy * 1.05 + 100.0 AS pred, s_nationkey AS cluster,
    CASE WHEN month(day) IN (12, 1, 2) THEN 'DJF' WHEN month(day) IN (3, 4, 5) THEN 'MAM'
         WHEN month(day) IN (6, 7, 8) THEN 'JJA' ELSE 'SON' END AS season
  FROM daily d LEFT JOIN supplier ON s_suppkey = station
)"""

HOURLY = "hourly AS (SELECT user_id AS station, ts, event_type AS kind, value FROM events)"


def rounded(df: DataFrame, *columns: str, places: int = 4) -> DataFrame:
    """Sums of doubles differ in their last bits with the order of rows; results are compared rounded."""
    return df.withColumns({c: F.round(c, places) for c in columns})
