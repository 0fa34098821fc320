"""Streaming forms of the daily operators: complete days, peaks, sessions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def complete_days(stream: DataFrame, key: str, ts: str, value: str, hours: int = 24, late: str = "1 day") -> DataFrame:
    """key, day, n, mean, peak of the days with ``hours`` different hours, once a day is over.

    The hours of a day fit in a bit mask, so a day's state is a few numbers however many rows it has.
    """
    bit = F.expr(f"shiftleft(1, hour({ts}))")
    daily = (
        stream.withWatermark(ts, late)
        .groupBy(F.window(ts, "1 day").alias("w"), key)
        .agg(F.bit_or(bit).alias("_hours"), F.count(value).alias("n"), F.avg(value).alias("mean"), F.max(value).alias("peak"), F.count_if(F.col(value).isNull()).alias("_null"))
    )
    full = (F.bit_count("_hours") >= hours) & (F.col("_null") == 0)
    return daily.filter(full).select(key, F.to_date("w.start").alias("day"), "n", "mean", "peak")


def sessions(stream: DataFrame, key: str, ts: str, gap: str = "1 hour", late: str = "1 day") -> DataFrame:
    """key, started, ended, n of runs of events with no gap as long as ``gap``."""
    found = stream.withWatermark(ts, late).groupBy(F.session_window(ts, gap).alias("w"), key).agg(F.count("*").alias("n"))
    return found.select(key, F.col("w.start").alias("started"), F.col("w.end").alias("ended"), "n")
