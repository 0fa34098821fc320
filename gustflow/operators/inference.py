"""Paired effects by block bootstrap, multiple testing, loss differentials, Diebold-Mariano.

Rows are summed to blocks first; draws, which are many, meet the few block sums only.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from ..functions.columns import pinball
from .quantiles import quantiles


#: The tails (quantiles of y) and the pinball losses of the robustness metrics.
TAILS, TAUS = (0.90, 0.95, 0.99), (0.90, 0.95, 0.99)


def _percent(q: float) -> int:
    return round(100 * q)


def block_sums(
    df: DataFrame, by: Sequence[str], block: str, y: str, error: str, tails: Sequence[float] = (0.9,), taus: Sequence[float] = (), row: Sequence[str] = ()
) -> DataFrame:
    """Sums per group and block over the rows with a known error: n, squares, observations, each tail's, pinball losses.

    A tail is y at least its quantile over the rows of the group that have an error. ``rows`` tells sets of rows
    (by the columns ``row``) apart, so that two groups can be compared on the same rows only. A block may be a
    day or a year-month.
    """
    e = F.col(error)
    known = df.filter(e.isNotNull() & ~F.isnan(e))
    cuts = quantiles(known, by, [y], tails).withColumnRenamed(y, "_cuts")
    rows = known.join(cuts, list(by)) if by else known.crossJoin(F.broadcast(cuts))  # without groups: one row
    of_tails = []
    for i, q in enumerate(tails):
        inside, name = F.col(y) >= F.get("_cuts", F.lit(i)), f"p{_percent(q)}"
        of_tails += [
            F.count_if(inside).cast("double").alias(f"n_{name}"),
            F.sum(F.when(inside, e).otherwise(0.0)).alias(f"se_{name}"),
            F.sum(F.when(inside, e * e).otherwise(0.0)).alias(f"see_{name}"),
        ]
    return rows.groupBy(*by, block).agg(
        F.count("*").cast("double").alias("n"),
        F.sum(e * e).alias("see"),
        F.sum(y).alias("sy"),
        F.sum(F.col(y) * F.col(y)).alias("syy"),
        *of_tails,
        *(F.sum(pinball(F.col(y), F.col(y) + e, t)).alias(f"pin_{_percent(t)}") for t in taus),
        F.bit_xor(F.xxhash64(*row) if row else F.lit(0).cast("long")).alias("rows"),
    )


def drawn_metrics(sums: DataFrame, draws: DataFrame, by: Sequence[str], block: str) -> DataFrame:
    """by, b, rmse, r2, bias and rmse of each tail, pinball losses that the sums have, and rows, for each draw.

    draws: (b, block, c), c how often a block is drawn. Sums have a row for each group and block; the draws are
    computed once.
    """
    draws = draws.persist()
    s = lambda c: F.sum(F.col("c") * F.col(c))
    none = F.lit(0.0)
    per = lambda c, n: s(c) / F.nullif(s(n), none)
    tails = [c[2:] for c in sums.columns if c.startswith("n_p")]
    spread = s("syy") - s("sy") * s("sy") / F.nullif(s("n"), none)
    of_tails = [m for t in tails for m in (per(f"se_{t}", f"n_{t}").alias(f"bias_{t}"), F.sqrt(per(f"see_{t}", f"n_{t}")).alias(f"rmse_{t}"))]
    return sums.join(F.broadcast(draws) if draws.count() <= 1_000_000 else draws, block).groupBy(*by, "b").agg(
        F.sqrt(per("see", "n")).alias("rmse"),
        *of_tails,
        (1 - s("see") / F.nullif(spread, none)).alias("r2"),
        *(per(c, "n").alias(c.replace("pin_", "pinball_")) for c in sums.columns if c.startswith("pin_")),
        F.bit_xor("rows").alias("rows"),
    )


def numbered_days(df: DataFrame, day: str) -> DataFrame:
    """day, at (from 0), run_end: the days in order and the last place of their run of consecutive days.

    There is one row per day, so the windows over all rows stay small.
    """
    order = Window.orderBy(day)
    gap = F.when(F.datediff(F.col(day), F.lag(day).over(order)) > 1, 1).otherwise(0)
    days = df.select(day).filter(F.col(day).isNotNull()).distinct()
    placed = days.select(day, (F.row_number().over(order) - 1).alias("at"), gap.alias("_g")).withColumn("_run", F.sum("_g").over(order))
    return placed.withColumn("run_end", F.max("at").over(Window.partitionBy("_run"))).drop("_g", "_run")


def stretch_sums(sums: DataFrame, days: DataFrame, by: Sequence[str], day: str, length: int) -> DataFrame:
    """by, start and the sums of the ``length`` days from there, for each start whose stretch stays in its run.

    Draws of moving blocks meet these sums instead of days: a draw is then a row for each stretch, not for each day.
    """
    placed = sums.join(F.broadcast(days.select(day, "at")), day)
    start = F.explode(F.sequence(F.greatest(F.col("at") - (length - 1), F.lit(0)), F.col("at")))
    valid = days.filter(F.col("at") + (length - 1) <= F.col("run_end")).select(F.col("at").alias("start"))
    values = [c for c in sums.columns if c not in (*by, day, "rows")]
    parts = placed.withColumn("start", start).join(F.broadcast(valid), "start", "left_semi")
    return parts.groupBy(*by, "start").agg(*(F.sum(c).alias(c) for c in values), F.bit_xor("rows").alias("rows"))


def moving_block_metrics(sums: DataFrame, days: DataFrame, draws: DataFrame, by: Sequence[str], day: str, length: int) -> DataFrame:
    """drawn_metrics of moving blocks (draws: b, start, c) with draw 0, which has each day once; sums are of days."""
    once = days.select(day, F.lit(0).alias("b"), F.lit(1).alias("c"))
    whole = drawn_metrics(sums, once, by, day)
    return whole.unionByName(drawn_metrics(stretch_sums(sums, days, by, day, length), draws, by, "start"))


def seeded_draws(spark: SparkSession, blocks: Sequence, n: int, seed: int) -> DataFrame:
    """(b, block, c): n multinomial draws of the blocks after draw 0, which has each once."""
    rng = np.random.default_rng(seed)
    counts = np.vstack([np.ones(len(blocks), dtype=int), rng.multinomial(len(blocks), np.full(len(blocks), 1 / len(blocks)), size=n)])
    rows = [(b, block, int(c)) for b, line in enumerate(counts) for block, c in zip(blocks, line, strict=True) if c]
    return spark.createDataFrame(rows, "b int, block int, c int")


def moving_block_draws(spark: SparkSession, run_ends: Sequence[int], length: int, n: int, seed: int) -> DataFrame:
    """(b, start, c): n draws of stretches of ``length`` days that stay in their run, as many as cover all days.

    run_ends: for each day in order the last place of its run. ValueError if no run is that long.
    """
    days = len(run_ends)
    starts = np.flatnonzero(np.arange(days) + length - 1 <= np.asarray(run_ends, dtype=int))
    if not len(starts):
        raise ValueError(f"no {length} consecutive days")
    rng = np.random.default_rng(seed)
    rows = []
    for b in range(1, n + 1):
        drawn = rng.choice(starts, size=-(-days // length))
        rows += [(b, int(d), int(c)) for d, c in zip(*np.unique(drawn, return_counts=True), strict=True)]
    return spark.createDataFrame(rows, "b int, start int, c int")


def stationary_draws(spark: SparkSession, run_ends: Sequence[int], mean_length: float, n: int, seed: int) -> DataFrame:
    """(b, at, c): n draws of stretches of geometric length that end with their run at the latest, until all days are covered.

    Draw 0 has each day once.
    """
    days, ends = len(run_ends), np.asarray(run_ends, dtype=int)
    rng = np.random.default_rng(seed)
    rows = [(0, d, 1) for d in range(days)]
    for b in range(1, n + 1):
        counts = np.zeros(days, dtype=int)
        while counts.sum() < days:
            first = int(rng.integers(0, days))
            counts[first : min(first + int(rng.geometric(1 / mean_length)), int(ends[first]) + 1)] += 1
        rows += [(b, int(d), int(counts[d])) for d in np.flatnonzero(counts)]
    return spark.createDataFrame(rows, "b int, at int, c int")


def paired_effects(metrics: DataFrame, arm: str, tag: str, model: str, worse: str, better: str, names: Sequence[str]) -> DataFrame:
    """A row for each metric: effect (mean over models in a tag, then over tags, of draw 0), its error and interval, z and p.

    Errors are worse minus better; r2 and bias, which keeps its sign, are better minus worse. The error has two
    parts: over draws, and over tags (replicates; 0 for a single one). Pairs of a tag and a model that one side
    lacks, or whose two sides cover different rows, are left out; without a pair there is no row. All metrics go
    through the same aggregations.
    """
    values = F.explode(F.array(*(F.struct(F.lit(m).alias("metric"), F.col(m).alias("v")) for m in names))).alias("_m")
    rows = metrics.filter(F.col(arm).isin(worse, better)).select(arm, tag, model, "b", "rows", values)
    side = lambda of, c: F.max(F.when(F.col(arm) == of, F.col(c)))
    gain = side(worse, "_m.v") - side(better, "_m.v")
    signed = F.when((F.col("_metric") == "r2") | F.col("_metric").startswith("bias"), -gain).otherwise(gain)
    both = rows.groupBy(F.col("_m.metric").alias("_metric"), tag, model, "b").agg(
        signed.alias("d"), (side(worse, "rows") == side(better, "rows")).alias("same")
    )
    usable = both.filter("b = 0 AND same").select(tag, model).distinct()
    by_tag = both.join(usable, [tag, model], "left_semi").groupBy("_metric", tag, "b").agg(F.avg("d").alias("d"))
    drawn = by_tag.groupBy("_metric", "b").agg(F.avg("d").alias("d"))
    boot = drawn.groupBy("_metric").agg(
        F.max(F.when(F.col("b") == 0, F.col("d"))).alias("effect"), F.stddev_samp(F.when(F.col("b") > 0, F.col("d"))).alias("se_boot")
    )
    rep = by_tag.filter("b = 0").groupBy("_metric").agg(
        F.count("*").alias("n_replicates"), F.coalesce(F.stddev_samp("d") / F.sqrt(F.count("*")), F.lit(0.0)).alias("se_rep")
    )
    models = usable.agg(F.count_distinct(model).alias("n_models"))
    se = F.sqrt(F.col("se_boot") * F.col("se_boot") + F.col("se_rep") * F.col("se_rep"))
    return (
        boot.join(rep, "_metric")
        .crossJoin(models)  # one row
        .withColumn("se", se)
        .withColumns(
            {
                "ci_lo": F.col("effect") - 1.96 * F.col("se"),
                "ci_hi": F.col("effect") + 1.96 * F.col("se"),
                "z": F.col("effect") / F.nullif(F.col("se"), F.lit(0.0)),
            }
        )
        .withColumn("p", normal_p(F.col("z")))
        .withColumnRenamed("_metric", "metric")
    )


#: Fixed value: the smallest effect of interest, as a share of the metric of the reference arm.
SESOI_SHARE = 0.01


def effect_table(metrics: DataFrame, arm: str, tag: str, model: str, worse: str, better: str, names: Sequence[str], anchor: str | None = None) -> DataFrame:
    """paired_effects of the metrics with sesoi and verdict.

    sesoi is a share of the mean metric of the arm ``anchor`` (``worse`` if not given) in draw 0.
    """
    values = F.explode(F.array(*(F.struct(F.lit(m).alias("metric"), F.col(m).alias("v")) for m in names))).alias("_m")
    start = metrics.filter((F.col("b") == 0) & (F.col(arm) == (anchor or worse))).select(values)
    scale = start.groupBy(F.col("_m.metric").alias("metric")).agg((SESOI_SHARE * F.abs(F.avg("_m.v"))).alias("sesoi"))
    out = paired_effects(metrics, arm, tag, model, worse, better, names).join(scale, "metric", "left")
    return out.withColumn("verdict", verdict(F.col("ci_lo"), F.col("ci_hi"), F.col("se"), F.col("sesoi")))


def study_effects(
    metrics: DataFrame,
    arm: str,
    tag: str,
    model: str,
    comparisons: Sequence[tuple[str, str, str, str, str]],
    family_of: dict[str, str],
    names: Sequence[str],
    primary: dict[str, str] | None = None,
) -> DataFrame:
    """A row for each comparison, model family (and all models together) and metric, all in the same aggregations.

    comparisons: (name, worse, better, axis, anchor). Columns: comparison, axis, family, metric and those of
    ``paired_effects``, then sesoi, q and verdict. Models without a family are ``other``. An axis is judged by its
    ``primary`` metric (rmse unless given) over all models: there q is that of Benjamini-Hochberg among the axis's
    comparisons, and the verdict is given; other rows have neither. sesoi is a share of that metric's mean in the axis's
    anchors. Pairs of a tag and a model that lack a side, or cover other rows on it, are left out, as are comparisons
    without a pair.
    """
    of_axis = primary or {}
    listed = F.array(*(F.struct(*(F.lit(v).alias(c) for v, c in zip(x, ("comparison", "worse", "better", "axis", "anchor"), strict=True))) for x in comparisons))
    known = F.create_map(*(F.lit(x) for pair in family_of.items() for x in pair)) if family_of else F.lit(None).cast("map<string,string>")
    family = F.coalesce(F.try_element_at(known, F.col(model)), F.lit("other"))
    values = F.array(*(F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("v")) for m in names))
    # a row of metrics takes part in the comparisons that its arm is a side of
    meant = F.filter(listed, lambda c: (c["worse"] == F.col(arm)) | (c["better"] == F.col(arm)))
    rows = metrics.select(arm, tag, model, "b", "rows", F.explode(meant).alias("_c"), values.alias("_all")).select("*", F.explode("_all").alias("_m"))
    is_worse = F.col(arm) == F.col("_c.worse")
    side = lambda worse, c: F.max(F.when(is_worse if worse else ~is_worse, F.col(c)))
    gain = side(True, "_m.v") - side(False, "_m.v")
    both = rows.groupBy(F.col("_c.comparison").alias("comparison"), F.col("_c.axis").alias("axis"), F.col("_m.metric").alias("metric"), tag, model, "b").agg(
        F.when((F.col("metric") == "r2") | F.col("metric").startswith("bias"), -gain).otherwise(gain).alias("_d"),
        F.coalesce(side(True, "rows") == side(False, "rows"), F.lit(False)).alias("_same"),
    )
    usable = both.filter("_same").withColumn("family", F.explode(F.array(family, F.lit("all"))))
    keys = ["comparison", "axis", "family", "metric"]
    by_tag = usable.groupBy(*keys, tag, "b").agg(F.avg("_d").alias("_d"), F.collect_set(model).alias("_models"))
    drawn = by_tag.groupBy(*keys, "b").agg(
        F.avg("_d").alias("_d"),
        F.when(F.col("b") == 0, F.count("*")).alias("_n"),
        F.when(F.col("b") == 0, F.coalesce(F.stddev_samp("_d") / F.sqrt(F.count("*")), F.lit(0.0))).alias("_rep"),
        F.when(F.col("b") == 0, F.size(F.array_distinct(F.flatten(F.collect_list("_models"))))).alias("_models"),
    )
    first = lambda c: F.max(F.when(F.col("b") == 0, F.col(c)))
    found = drawn.groupBy(*keys).agg(
        first("_d").alias("effect"), F.stddev_samp(F.when(F.col("b") > 0, F.col("_d"))).alias("se_boot"), first("_rep").alias("se_rep"),
        first("_n").alias("n_replicates"), first("_models").cast("long").alias("n_models"),
    )
    se = F.sqrt(F.col("se_boot") * F.col("se_boot") + F.col("se_rep") * F.col("se_rep"))
    out = found.withColumn("se", se).withColumns(
        {
            "ci_lo": F.col("effect") - 1.96 * F.col("se"),
            "ci_hi": F.col("effect") + 1.96 * F.col("se"),
            "z": F.col("effect") / F.nullif(F.col("se"), F.lit(0.0)),
        }
    )
    out = out.withColumn("p", normal_p(F.col("z")))
    axes = sorted({x[3] for x in comparisons})
    judged_by = F.create_map(*(F.lit(x) for a in axes for x in (a, of_axis.get(a, "rmse"))))
    anchors = F.array(*(F.struct(F.lit(a).alias("axis"), F.lit(n).alias("anchor")) for a, n in sorted({(x[3], x[4]) for x in comparisons})))
    at_anchor = F.filter(anchors, lambda x: x["anchor"] == F.col(arm))
    start = metrics.filter(F.col("b") == 0).select(F.explode(at_anchor).alias("_a"), values.alias("_all")).select("_a", F.explode("_all").alias("_m"))
    mean = start.filter(F.col("_m.metric") == judged_by[F.col("_a.axis")]).groupBy("_a.axis", "_a.anchor").agg(F.avg("_m.v").alias("_v"))
    scale = mean.groupBy("axis").agg((SESOI_SHARE * F.abs(F.avg("_v"))).alias("sesoi"))  # a row for each axis
    judged = (F.col("family") == "all") & (F.col("metric") == judged_by[F.col("axis")])
    # a row for each comparison, family and metric: the windows of the q values are small
    met = benjamini_hochberg(out.join(F.broadcast(scale), "axis", "left").withColumn("_p", F.when(judged, F.col("p"))), "_p", ["axis"]).drop("_p")
    return met.withColumn("verdict", F.when(judged, verdict(F.col("ci_lo"), F.col("ci_hi"), F.col("se"), F.col("sesoi"))))


def scheme_summary(effects: DataFrame, base: str, by: Sequence[str] = ("metric",)) -> DataFrame:
    """scheme, median, least and greatest width of its intervals against those of the scheme ``base``, percent of equal verdicts."""
    reference = effects.filter(F.col("scheme") == base).select(*by, (F.col("ci_hi") - F.col("ci_lo")).alias("_w"), F.col("verdict").alias("_v"))
    ratio = (F.col("ci_hi") - F.col("ci_lo")) / F.nullif(F.col("_w"), F.lit(0.0))
    return (
        effects.join(reference, list(by))
        .groupBy("scheme")
        .agg(
            F.percentile(ratio, F.lit(0.5)).alias("median_width"),
            F.min(ratio).alias("least_width"),
            F.max(ratio).alias("greatest_width"),
            (100 * F.avg((F.col("verdict") == F.col("_v")).cast("double"))).alias("same_verdicts"),
        )
    )


def paired_interval(metrics: DataFrame, arm: str, units: Sequence[str], worse: str, better: str, metric: str, level: float = 0.95) -> DataFrame:
    """units, effect, ci_lo, ci_hi: the paired difference (worse minus better) with a percentile interval over draws."""
    side = lambda of: F.max(F.when(F.col(arm) == of, F.col(metric)))
    each = metrics.filter(F.col(arm).isin(worse, better)).groupBy(*units, "b").agg((side(worse) - side(better)).alias("d"))
    drawn = F.when(F.col("b") > 0, F.col("d"))
    return each.groupBy(*units).agg(
        F.max(F.when(F.col("b") == 0, F.col("d"))).alias("effect"),
        F.percentile(drawn, F.lit((1 - level) / 2)).alias("ci_lo"),
        F.percentile(drawn, F.lit((1 + level) / 2)).alias("ci_hi"),
    )


def ranked_intervals(metrics: DataFrame, by: Sequence[str], metric: str, level: float = 0.95) -> DataFrame:
    """by, metric, ci_lo, ci_hi, rank: draw 0, a percentile interval over the others, the place from the least error.

    There is a row for each predictor (groups alone, noise, the raw proxy), so its window stays small.
    """
    drawn = F.when(F.col("b") > 0, F.col(metric))
    each = metrics.groupBy(*by).agg(
        F.max(F.when(F.col("b") == 0, F.col(metric))).alias("_v"), F.percentile(drawn, F.lit((1 - level) / 2)).alias("ci_lo"), F.percentile(drawn, F.lit((1 + level) / 2)).alias("ci_hi")
    )
    return each.withColumn("rank", F.row_number().over(Window.orderBy(F.asc_nulls_last("_v"), *by))).withColumnRenamed("_v", metric)


@F.pandas_udf(DoubleType())
def normal_p(z: pd.Series) -> pd.Series:
    """Two-sided p of a normal z; null stays null. For tables of effects, which are small."""
    return z.map(lambda x: None if x is None or math.isnan(x) else math.erfc(abs(x) / math.sqrt(2))).astype("float64")


def benjamini_hochberg(df: DataFrame, p: str, by: Sequence[str] = (), out: str = "q") -> DataFrame:
    """df with q values of each family; null p has none."""
    known = F.col(p).isNotNull()
    family = [*by, known]
    rank = F.row_number().over(Window.partitionBy(*family).orderBy(p))
    n = F.count(p).over(Window.partitionBy(*family))
    raw = df.withColumn("_raw", F.when(known, F.col(p) * n / rank)).withColumn("_rank", rank)
    least = F.min("_raw").over(Window.partitionBy(*family).orderBy(F.desc("_rank")))
    return raw.withColumn(out, F.when(known, F.least(least, F.lit(1.0)))).drop("_raw", "_rank")


def verdict(lo: Column, hi: Column, se: Column, sesoi: Column) -> Column:
    """Against the smallest effect of interest: adds if the interval lies above it, harms if below its negative,
    no information if between the two, else inconclusive; indeterminate without a finite error or such an effect."""
    finite = lambda c: c.isNotNull() & (F.abs(c.cast("double")) < F.lit(float("inf")))
    return (
        F.when(~(finite(se) & finite(sesoi)), "indeterminate")
        .when(lo > sesoi, "adds")
        .when(hi < -sesoi, "harms")
        .when((lo >= -sesoi) & (hi <= sesoi), "no information")
        .otherwise("inconclusive")
    )


def _beta_tail(a: float, b: float, x: float) -> float:
    """The regularised incomplete beta function I_x(a, b) by its continued fraction (x below (a + 1) / (a + b + 2))."""
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    c, d = 1.0, 1.0 / (1.0 - (a + b) * x / (a + 1))
    value = d
    for m in range(1, 400):
        for term in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1.0 / (1.0 + term * d)
            c = 1.0 + term / c
            value *= c * d
        if abs(c * d - 1.0) < 1e-14:
            break
    return front * value


def student_two_sided(t: float, df: float) -> float:
    """Two-sided p of Student's t."""
    x = df / (df + t * t)
    if t == 0:
        return 1.0
    a, b = df / 2, 0.5
    return _beta_tail(a, b, x) if x < (a + 1) / (a + b + 2) else 1.0 - _beta_tail(b, a, 1.0 - x)


@F.pandas_udf(DoubleType())
def student_p(t: pd.Series, df: pd.Series) -> pd.Series:
    """Two-sided p of t with df degrees of freedom; null stays null. For tables of results, which are small."""
    known = lambda v: v is not None and not math.isnan(v)
    return pd.Series([student_two_sided(x, n) if known(x) and n > 0 else None for x, n in zip(t, df, strict=True)], dtype="float64")


def loss_differential(
    df: DataFrame, day: str, arm: str, units: Sequence[str], error: str, worse: str, better: str, place: Sequence[str] = ("station",)
) -> DataFrame:
    """day, d: squared error of worse minus that of better, mean over the day's places, then over units.

    A place of a unit's day counts where both arms have a finite error there; units without any such place leave the
    day to the others. Days that no unit covers stay, with a null d, as they belong to the calendar.
    """
    finite = F.abs(error) < float("inf")
    e2 = F.when(finite, F.col(error) * F.col(error))
    side = lambda name: F.max(F.when(F.col(arm) == name, e2))  # noqa: E731  (one row of each arm)
    pairs = df.filter(F.col(arm).isin(worse, better)).groupBy(*units, *place, day).agg((side(worse) - side(better)).alias("_d"))
    by_unit = pairs.groupBy(*units, day).agg(F.avg("_d").alias("_d"))
    return by_unit.groupBy(day).agg(F.avg("_d").alias("d"))


def diebold_mariano(d: DataFrame, day: str, value: str, max_lag: int = 5) -> DataFrame:
    """One row: n, mean, dm with Bartlett weights and the small-sample correction for horizon 1, p by Student's t.

    Runs of consecutive days are those of all rows of ``d``. Days without a value (null or not finite) are then left
    out, and autocovariances pair rows ``lag`` places apart that lie in one run. With fewer than 10 days mean,
    dm and p are null. The series has one row per day, so its windows over all rows stay small.
    """
    at = Window.orderBy(day)
    gap = F.when(F.datediff(F.col(day), F.lag(day).over(at)) > 1, 1).otherwise(0)
    numbered = d.select(day, F.col(value).alias("_x")).withColumn("_g", gap).withColumn("_run", F.sum("_g").over(at))
    known = numbered.filter(F.abs("_x") < float("inf"))
    centred = known.withColumn("_c", F.col("_x") - F.avg("_x").over(Window.partitionBy()))
    lagged = centred.select(
        "_x", "_c", *(F.when(F.lag("_run", k).over(at) == F.col("_run"), F.col("_c") * F.lag("_c", k).over(at)).alias(f"_p{k}") for k in range(1, max_lag + 1))
    )
    n = F.count("*")
    gamma = F.sum(F.col("_c") * F.col("_c")) / n
    for k in range(1, max_lag + 1):
        gamma = gamma + 2 * (1 - k / (max_lag + 1)) * F.coalesce(F.sum(f"_p{k}"), F.lit(0.0)) / n
    dm = F.avg("_x") / F.sqrt(F.greatest(gamma, F.lit(1e-12)) / n) * F.sqrt((n - 1) / n)
    enough = n >= 10
    out = lagged.agg(n.alias("n"), F.when(enough, F.avg("_x")).alias("mean"), F.when(enough, dm).alias("dm"))
    return out.withColumn("p", student_p("dm", (F.col("n") - 1).cast("double")))
