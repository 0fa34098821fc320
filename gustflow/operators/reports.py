"""What the study's reports are drawn from: scorecards, deploy windows, differences of pipelines, spreads, audits."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scan import materialise
from .metrics import _joined, core_metrics
from .quantiles import GROUPS, beside, quantile, quantiles

#: Whiskers end at the last value within so many interquartile ranges of the box.
WHISKER = 1.5


def scorecards(df: DataFrame, by: Sequence[str], y: str, pred: str, reference: str, least: int = 1) -> DataFrame:
    """by, n, rmse, rmse_ref, r2, bias, obs_max, gain of the groups with at least ``least`` rows.

    ``gain`` is how much less the prediction errs than the reference. Rows without any of the three values do not
    count; r2 is null where y does not vary.
    """
    rows = df.dropna(subset=[y, pred, reference])
    e, r = F.col(pred) - F.col(y), F.col(reference) - F.col(y)
    cards = rows.groupBy(*by).agg(
        F.count("*").alias("n"),
        F.sqrt(F.avg(e * e)).alias("rmse"),
        F.sqrt(F.avg(r * r)).alias("rmse_ref"),
        (1 - F.sum(e * e) / F.nullif(F.count("*") * F.var_pop(y), F.lit(0.0))).alias("r2"),
        F.avg(e).alias("bias"),
        F.max(y).alias("obs_max"),
    )
    return cards.filter(F.col("n") >= least).withColumn("gain", F.col("rmse_ref") - F.col("rmse"))


def slices(cards: DataFrame, value: str, ties: Sequence[str], k: int = 10) -> DataFrame:
    """cards with slice (best, median, worst) and place: the k least, the k middle and the k greatest values.

    Places count from 1, for worst from the greatest down. A row can be in several slices where there are few; null
    values are in none. The middle begins k/2 rows before the middle row, or at the first row. Its rows are found
    between two exact quantiles one place further out, so nothing sorts all cards.
    """
    known = cards.filter(F.col(value).isNotNull())
    n = known.count()
    up = Window.orderBy(value, *ties)  # over the rows of one slice
    down = Window.orderBy(F.desc(value), *(F.desc(t) for t in ties))
    named = lambda rows, name, place: rows.withColumns({"slice": F.lit(name), "place": place.cast("long")})
    best = named(known.orderBy(value, *ties).limit(k), "best", F.row_number().over(up))
    worst = named(known.orderBy(F.desc(value), *(F.desc(t) for t in ties)).limit(k), "worst", F.row_number().over(down))
    first = max(n // 2 - k // 2, 0)
    last = min(n // 2 - k // 2 + k, n) - 1
    reach = [max(first - 1, 0) / max(n - 1, 1), min(last + 1, max(n - 1, 0)) / max(n - 1, 1)]
    bounds = quantiles(known, [], [value], reach).select(F.col(value).alias("_b"))
    placed = known.crossJoin(F.broadcast(bounds))  # one row
    below = placed.agg(F.count_if(F.col(value) < F.col("_b")[0]).alias("_below"))
    near = placed.filter((F.col(value) >= F.col("_b")[0]) & (F.col(value) <= F.col("_b")[1])).drop("_b")
    at = near.withColumn("_at", F.row_number().over(up) - 1).crossJoin(F.broadcast(below))  # one row
    middle = at.filter((F.col("_at") + F.col("_below")).between(first, last)).withColumn("_at", F.col("_at") + F.col("_below") - first + 1).drop("_below")
    return best.unionByName(named(middle, "median", F.col("_at")).drop("_at")).unionByName(worst)


def half_month(day: str) -> Column:
    return F.concat(F.date_format(day, "yyyy-MM"), F.when(F.dayofmonth(day) <= 15, "-Q1").otherwise("-Q2"))


def deploy_windows(df: DataFrame, by: Sequence[str], day: str, y: str, pred: str, window: str = "monthly", least: int = 5) -> DataFrame:
    """by, windows and mean, std, least of the r2 (rounded to 4 places) of each month or half-month with enough rows.

    ``by`` names what is deployed, such as cluster and model. std is the sample's, null for a single window; a window
    where y does not vary has no r2 and counts among the windows only.
    """
    if window not in ("monthly", "biweekly"):
        raise ValueError(f"{window!r} is neither monthly nor biweekly")
    period = F.date_format(day, "yyyy-MM") if window == "monthly" else half_month(day)
    scored = core_metrics(df.withColumn("_period", period), [*by, "_period"], y, pred).filter(F.col("n") >= least)
    r2 = F.round("r2", 4)
    return scored.groupBy(*by).agg(F.count("*").alias("windows"), F.avg(r2).alias("mean"), F.stddev_samp(r2).alias("std"), F.min(r2).alias("least"))


def pipeline_differences(df: DataFrame, node: Sequence[str], pipeline: str, value: str, reference: str) -> DataFrame:
    """node, pipeline, greatest, difference: each pipeline's greatest value at a node, and less the reference's there.

    The reference's own rows have no difference; nodes that it lacks have none for any pipeline.
    """
    top = df.groupBy(*node, pipeline).agg(F.max(value).alias("greatest"))
    of_reference = F.max(F.when(F.col(pipeline) == reference, F.col("greatest"))).over(Window.partitionBy(*node))
    return top.withColumn("difference", F.when(F.col(pipeline) != reference, F.col("greatest") - of_reference))


def colour_scales(differences: DataFrame) -> DataFrame:
    """One row: least and greatest of all pipelines' values, and the greatest absolute difference (1 where it is 0 or none)."""
    wide = F.max(F.abs("difference"))
    return differences.agg(F.min("greatest").alias("least"), F.max("greatest").alias("greatest"), F.when(wide > 0, wide).otherwise(1.0).alias("widest_difference"))


def boxes(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """by, n, q1, median, q3, low, high, outside: quartiles, ends of the whiskers, and how many values lie beyond them."""
    rows = df.filter(F.col(value).isNotNull()).select(*by, value)
    quartiles = quantiles(rows, by, [value], [0.25, 0.5, 0.75]).withColumnRenamed(value, "_q")
    q1, q3 = F.col("_q")[0], F.col("_q")[2]
    v, reach = F.col(value), WHISKER * (q3 - q1)
    inside = (v >= q1 - reach) & (v <= q3 + reach)
    found = _joined(rows, quartiles, by).groupBy(*by).agg(
        F.count("*").alias("n"), F.first("_q").alias("_q"), F.min(F.when(inside, v)).alias("_low"), F.max(F.when(inside, v)).alias("_high"), F.count_if(~inside).alias("outside")
    )
    low, high = F.least(q1, F.coalesce("_low", q1)), F.greatest(q3, F.coalesce("_high", q3))
    return found.select(*by, "n", q1.alias("q1"), F.col("_q")[1].alias("median"), q3.alias("q3"), low.alias("low"), high.alias("high"), "outside")


def histogram(df: DataFrame, by: Sequence[str], value: str, bins: int = 39, q: float = 0.9) -> DataFrame:
    """by, bin, begins, ends, n, density, marker: bins of one width from a group's least to its greatest value.

    Empty bins are there, the last one holds its end. ``marker`` is the group's q-quantile. A group with one
    value only has one bin, of no width and without a density.
    """
    rows = df.filter(F.col(value).isNotNull()).select(*by, F.col(value).cast("double").alias("_v"))
    spans = rows.groupBy(*by).agg(F.min("_v").alias("_a"), F.max("_v").alias("_z"), F.count("*").alias("_all"))
    spans = materialise(beside(spans, quantile(rows, by, "_v", q, "marker"), by).withColumn("_w", (F.col("_z") - F.col("_a")) / bins))
    place = F.when(F.col("_w") > 0, F.least(F.floor((F.col("_v") - F.col("_a")) / F.col("_w")), F.lit(bins - 1))).otherwise(0).cast("int")
    few = spans.count() <= GROUPS
    counts = _joined(rows, F.broadcast(spans) if few else spans, by).groupBy(*by, place.alias("bin")).agg(F.count("*").alias("n"))
    every = spans.withColumn("bin", F.explode(F.when(F.col("_w") > 0, F.sequence(F.lit(0), F.lit(bins - 1))).otherwise(F.array(F.lit(0)))))
    edge = lambda k: F.col("_a") + k * F.col("_w")
    n = F.coalesce("n", F.lit(0)).cast("long")
    return every.join(counts, [*by, "bin"], "left").select(
        *by, "bin", edge(F.col("bin")).alias("begins"), edge(F.col("bin") + 1).alias("ends"), n.alias("n"), (n / F.nullif(F.col("_all") * F.col("_w"), F.lit(0.0))).alias("density"), "marker"
    )


def row_audit(steps: dict[str, DataFrame], by: Sequence[str]) -> DataFrame:
    """by and a column of row counts for each step, 0 where a step has no rows of a group."""
    counted = [df.groupBy(*by).agg(*(F.count("*").alias(s) if s == name else F.lit(0).cast("long").alias(s) for s in steps)) for name, df in steps.items()]
    every = reduce(DataFrame.unionByName, counted)
    return every.groupBy(*by).agg(*(F.sum(s).alias(s) for s in steps))


def split_sizes(df: DataFrame, by: Sequence[str], split: str, station: str, splits: Sequence[str] = ("train", "val", "test")) -> DataFrame:
    """by, n_stations and n_<split> for each split; rows of other splits count for the stations only."""
    return df.groupBy(*by).agg(F.count_distinct(station).alias("n_stations"), *(F.count_if(F.col(split) == s).alias(f"n_{s}") for s in splits))


def effect_matrix(effects: DataFrame, metric: str, effect: str, lo: str, hi: str) -> DataFrame:
    """effects with ``scaled`` (by the greatest absolute effect of the metric) and ``star`` ('*': the interval excludes 0).

    A metric whose effects are all 0 is not scaled: null.
    """
    widest = F.nullif(F.max(F.abs(effect)).over(Window.partitionBy(metric)), F.lit(0.0))
    return effects.withColumns({"scaled": F.col(effect) / widest, "star": F.when((F.col(lo) > 0) | (F.col(hi) < 0), "*").otherwise("")})
