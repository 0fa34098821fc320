"""Calendars, lags, rolling statistics, lookback windows, purges, runs and events."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def densify(df: DataFrame, key: str, day: str) -> DataFrame:
    """Every day from each key's first to its last; days that df lacks have nulls in the other columns.

    A shared dense axis is what lags and rolling windows by position need.
    """
    span = df.groupBy(key).agg(F.min(day).alias("_a"), F.max(day).alias("_b"))
    days = span.select(key, F.explode(F.sequence("_a", "_b", F.expr("interval 1 day"))).alias(day))
    return days.join(df, [key, day], "left")


def lagged(value: str, k: int, key: str, day: str) -> Column:
    return F.lag(value, k).over(Window.partitionBy(key).orderBy(day))


def rolling_mean(value: str, days: int, least: int, key: str, day: str) -> Column:
    """Mean of the last ``days`` rows, this one with them, if at least ``least`` of them are known."""
    w = Window.partitionBy(key).orderBy(day).rowsBetween(1 - days, 0)
    return F.when(F.count(value).over(w) >= least, F.avg(value).over(w))


def with_gaps(df: DataFrame, key: str, day: str) -> DataFrame:
    """Rows whose day is not the one after the row before (of the same key): empty for a gap-free table."""
    before = F.lag(day).over(Window.partitionBy(key).orderBy(day))
    return df.withColumn("_gap", F.datediff(F.col(day), before)).filter(F.col("_gap") != 1).drop("_gap")


def assert_gap_free(df: DataFrame, key: str, day: str) -> DataFrame:
    """df itself; raises ValueError if a key's days have a gap or come twice."""
    if not with_gaps(df, key, day).isEmpty():
        raise ValueError(f"days of some {key} have gaps or repeat")
    return df


def lookback(df: DataFrame, key: str, day: str, features: Sequence[str], length: int, pad: str = "none", label: str | None = None) -> DataFrame:
    """df with ``window``: the features of the last ``length`` rows, this one last.

    pad 'none' leaves out rows with fewer rows before them, 'edge' repeats the first one. With a label,
    only windows remain whose labels are all the row's own, and not 'out' (strict purge).
    """
    w = Window.partitionBy(key).orderBy(day).rowsBetween(1 - length, 0)
    rows = df.withColumn("window", F.collect_list(F.struct(*features)).over(w))
    if label:
        rows = rows.withColumn("_same", (F.min(label).over(w) == F.max(label).over(w)) & (F.col(label) != "out")).filter("_same").drop("_same")
    if pad == "edge":
        first = F.element_at("window", 1)
        return rows.withColumn("window", F.concat(F.array_repeat(first, length - F.size("window")), F.col("window")))
    return rows.filter(F.size("window") == length)


def hourly_day_windows(df: DataFrame, key: str, ts: str, features: Sequence[str], offset_hours: int = 0, hours: int = 24) -> DataFrame:
    """key, day, window (features by hour) of the days that have all their hours.

    A day begins ``offset_hours`` after midnight: with 3, at 03:00. Times off the full hour and two rows of
    one hour are errors, found where they are met; incomplete days are left out.
    """
    full = F.when(F.col(ts) == F.date_trunc("hour", ts), F.col(ts)).otherwise(F.raise_error(F.lit("time off the full hour")).cast("timestamp"))
    shifted = full - F.expr(f"interval {offset_hours} hours")
    days = df.withColumn("_t", shifted).groupBy(key, F.to_date("_t").alias("day")).agg(
        F.sort_array(F.collect_list(F.struct(F.hour("_t").alias("_h"), *features))).alias("window"),
        F.count("*").alias("_n"),
        F.count_distinct(F.hour("_t")).alias("_k"),
    )
    once = F.when(F.col("_n") == F.col("_k"), F.col("_k")).otherwise(F.raise_error(F.lit("an hour comes twice")).cast("long"))
    return days.filter(once == hours).drop("_n", "_k")


def month_block_label(day: Column, test_months: Sequence[int], val_units: Sequence[tuple[int, int]], first: str | None = None, last: str | None = None) -> Column:
    """train, val, test or out: test months, then (year, month) blocks of validation, within the range."""
    unit = F.year(day) * 100 + F.month(day)
    label = F.when(F.month(day).isin(*test_months), "test").when(unit.isin(*(y * 100 + m for y, m in val_units)), "val").otherwise("train")
    if first:
        label = F.when(day < F.lit(first).cast("date"), "out").otherwise(label)
    if last:
        label = F.when(day > F.lit(last).cast("date"), "out").otherwise(label)
    return label


def purge_boundaries(df: DataFrame, day: str, label_of, gap_days: int) -> DataFrame:
    """Rows whose label is also that of each of the ``gap_days`` days before.

    Labels of earlier days come from the calendar, so days without rows count as well.
    """
    keep = F.lit(True)
    for k in range(1, gap_days + 1):
        keep = keep & (label_of(F.date_sub(day, k)) == label_of(F.col(day)))
    return df.filter(keep)


def runs(df: DataFrame, keys: Sequence[str], day: str, out: str = "run") -> DataFrame:
    """df with the number (from 0) of the run of consecutive days that a row lies in."""
    w = Window.partitionBy(*keys).orderBy(day)
    begins = F.when(F.datediff(F.col(day), F.lag(day).over(w)) > 1, 1).otherwise(0)
    return df.withColumn("_begins", begins).withColumn(out, F.sum("_begins").over(w)).drop("_begins")


def longest_run(df: DataFrame, keys: Sequence[str], day: str) -> DataFrame:
    """keys, first_day, last_day, days of the longest run of each key; the earliest one of equals."""
    found = runs(df.select(*keys, day).distinct(), keys, day).groupBy(*keys, "run").agg(
        F.min(day).alias("first_day"), F.max(day).alias("last_day"), F.count("*").alias("days")
    )
    w = Window.partitionBy(*keys).orderBy(F.desc("days"), "first_day")
    return found.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r", "run")


def event_days(df: DataFrame, station: str, day: str, value: str, k: int = 2, q: float = 0.9, gap_days: int = 1, quiet_chunk: int = 7) -> DataFrame:
    """day, active, event: days grouped into events and quiet stretches.

    A day is active if at least k stations reach their own q-quantile. Active days at most gap_days + 1
    apart within one run of days are one event, with the days between them; quiet stretches are cut
    into chunks of ``quiet_chunk`` days. ``event`` is the group's first day and kind.
    """
    own = df.groupBy(station).agg(F.percentile(value, F.lit(q)).alias("_q"))
    days = (
        df.join(own, station)
        .groupBy(day)
        .agg((F.count_if(F.col(value) >= F.col("_q")) >= k).alias("active"))
    )
    # one row per day from here on: the calendar is small beside the stations' rows
    at = Window.orderBy(day)
    lined = days.withColumn("_n", F.when(F.datediff(F.col(day), F.lag(day).over(at)) > 1, 1).otherwise(0)).withColumn("run", F.sum("_n").over(at))
    in_run = Window.partitionBy("run").orderBy(day)
    last = F.last(F.when(F.col("active"), F.col(day)), ignorenulls=True).over(in_run.rowsBetween(Window.unboundedPreceding, 0))
    following = F.first(F.when(F.col("active"), F.col(day)), ignorenulls=True).over(in_run.rowsBetween(0, Window.unboundedFollowing))
    bridged = lined.withColumn("_in", F.col("active") | F.coalesce(F.datediff(following, last) <= gap_days + 1, F.lit(False)))
    part = bridged.withColumn("_new", F.when(F.coalesce(F.lag("_in").over(in_run) != F.col("_in"), F.lit(True)), 1).otherwise(0))
    far = part.withColumn("_part", F.sum("_new").over(in_run))
    place = F.row_number().over(Window.partitionBy("run", "_part").orderBy(day)) - 1
    chunked = far.withColumn("_chunk", F.when(F.col("_in"), F.lit(0)).otherwise(F.floor(place / quiet_chunk).cast("int")))
    first = F.min(day).over(Window.partitionBy("run", "_part", "_chunk"))
    return chunked.select(
        day, "active", F.concat(F.when(F.col("_in"), "event ").otherwise("quiet "), first.cast("string")).alias("event")
    )
