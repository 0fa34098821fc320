"""Verification metrics: one pass of sums per group, after the group's tail threshold is known."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import pinball
from .quantiles import place, quantile, quantiles

METRICS = ("r2", "rmse", "bias", "bias_p90", "rmse_p90")


def _joined(df: DataFrame, small: DataFrame, by: Sequence[str]) -> DataFrame:
    return df.join(small, list(by)) if by else df.crossJoin(small)  # without keys: one row


def with_tail(df: DataFrame, by: Sequence[str], y: str, q: float = 0.9, out: str = "tail_from") -> DataFrame:
    """df with its group's exact quantile of y (linear between ranks) as ``out``."""
    return _joined(df, quantile(df, by, y, q, out), by)


def core_metrics(df: DataFrame, by: Sequence[str], y: str, pred: str, q: float = 0.9) -> DataFrame:
    """n, r2, rmse, bias and bias, rmse where y >= the group's q-quantile.

    Rows without y or prediction do not count. r2 is null where y does not vary.
    """
    rows = with_tail(df.filter(F.col(y).isNotNull() & F.col(pred).isNotNull()), by, y, q)
    e = F.col(pred) - F.col(y)
    tail = F.col(y) >= F.col("tail_from")
    return rows.groupBy(*by).agg(
        F.count("*").alias("n"),
        (1 - F.sum(e * e) / F.nullif(F.count("*") * F.var_pop(y), F.lit(0.0))).alias("r2"),
        F.sqrt(F.avg(e * e)).alias("rmse"),
        F.avg(e).alias("bias"),
        F.avg(F.when(tail, e)).alias("bias_p90"),
        F.sqrt(F.avg(F.when(tail, e * e))).alias("rmse_p90"),
    )


def safe_metrics(df: DataFrame, by: Sequence[str], y: str, pred: str) -> DataFrame:
    """core_metrics, all null (and n_nonfinite given) for a group with any prediction that is no number."""
    odd = F.coalesce(F.isnan(pred) | (F.abs(F.col(pred)) == float("inf")), F.lit(True))
    counted = df.groupBy(*by).agg(F.count_if(odd).alias("n_nonfinite"), F.count("*").alias("rows"))
    good = core_metrics(df.filter(~odd), by, y, pred)
    joined = counted.join(good, list(by), "left") if by else counted.crossJoin(good)
    return joined.select(*by, "n_nonfinite", *(F.when(F.col("n_nonfinite") == 0, F.col(m)).alias(m) for m in METRICS))


def grouping_metrics(df: DataFrame, sets: Sequence[Sequence[str]], y: str, pred: str) -> DataFrame:
    """core_metrics for several groupings at once; a key outside a row's grouping is 'ALL'."""
    keys = list(dict.fromkeys(k for s in sets for k in s))
    made = None
    for s in sets:
        part = core_metrics(df, s, y, pred).select(
            *(F.col(k).cast("string").alias(k) if k in s else F.lit("ALL").alias(k) for k in keys), "n", *METRICS
        )
        made = part if made is None else made.unionByName(part)
    return made


def weighted_means(df: DataFrame, by: Sequence[str], values: Sequence[str], weight: str) -> DataFrame:
    """Means weighted by ``weight``, over rows that have both; null where the weights sum to 0."""
    mean = lambda v: F.sum(F.when(F.col(v).isNotNull(), F.col(v) * F.col(weight))) / F.nullif(
        F.sum(F.when(F.col(v).isNotNull(), F.col(weight))).cast("double"), F.lit(0.0)
    )
    return df.groupBy(*by).agg(F.sum(weight).alias("weight"), *(mean(v).alias(v) for v in values))


def contingency(df: DataFrame, by: Sequence[str], y: str, pred: str, threshold: float) -> DataFrame:
    """Hits, misses, false alarms and POD, FAR, CSI, frequency bias of y >= threshold."""
    seen, said = F.col(y) >= threshold, F.col(pred) >= threshold
    counted = df.groupBy(*by).agg(
        F.count_if(seen & said).alias("hits"),
        F.count_if(seen & ~said).alias("misses"),
        F.count_if(~seen & said).alias("false_alarms"),
    )
    h, m, f = (F.col(c).cast("double") for c in ("hits", "misses", "false_alarms"))
    none = F.lit(0.0)
    return counted.select(
        *by,
        "hits",
        "misses",
        "false_alarms",
        (h / F.nullif(h + m, none)).alias("pod"),
        (f / F.nullif(h + f, none)).alias("far"),
        (h / F.nullif(h + m + f, none)).alias("csi"),
        ((h + f) / F.nullif(h + m, none)).alias("freq_bias"),
    )


def reliability(df: DataFrame, y: str, pred: str, bins: int = 11) -> DataFrame:
    """Mean prediction and observation in bins between quantiles of the prediction; empty bins are left out."""
    cuts = [k / bins for k in range(bins + 1)]
    edges = quantiles(df, [], [pred], cuts).select(F.col(pred).alias("edges"))
    at = place("edges", bins + 1, F.col(pred), inclusive=True) - 1
    return (
        df.crossJoin(F.broadcast(edges))  # one row
        .withColumn("bin", F.least(F.greatest(at, F.lit(0)), F.lit(bins - 1)))
        .groupBy("bin")
        .agg(F.count("*").alias("n"), F.avg(pred).alias("mean_pred"), F.avg(y).alias("mean_obs"))
    )


def tail_sums(df: DataFrame, by: Sequence[str], y: str, error: str, thresholds: dict[str, float], taus: Sequence[float] = ()) -> DataFrame:
    """Per group the sums that every metric is made of: counts, errors, squares, tails by absolute threshold, pinball."""
    e = F.col(error)
    sums: list[Column] = [
        F.count("*").alias("n"),
        F.sum(e).alias("se"),
        F.sum(e * e).alias("see"),
        F.sum(y).alias("sy"),
        F.sum(F.col(y) * F.col(y)).alias("syy"),
    ]
    for name, t in thresholds.items():
        tail = F.col(y) >= t
        sums += [
            F.count_if(tail).alias(f"n_{name}"),
            F.sum(F.when(tail, e).otherwise(0.0)).alias(f"se_{name}"),
            F.sum(F.when(tail, e * e).otherwise(0.0)).alias(f"see_{name}"),
        ]
    for tau in taus:
        sums.append(F.sum(pinball(F.col(y), F.col(y) + e, tau)).alias(f"pin_{round(100 * tau)}"))
    return df.groupBy(*by).agg(*sums)


def stratified(df: DataFrame, strata: Sequence[str], y: str, pred: str, least: int = 30, least_tail: int = 10, q: float = 0.9) -> DataFrame:
    """stratum kind, value, n, bias, rmse, n_tail, bias_p90, rmse_p90 for each value of each stratum with at least ``least`` rows.

    The tail is y at least its quantile over all rows; its metrics are null below ``least_tail`` rows.
    """
    cut = quantile(df, [], y, q, "_cut")
    e = F.col(pred) - F.col(y)
    kinds = F.explode(F.array(*(F.struct(F.lit(s).alias("kind"), F.col(s).cast("string").alias("value")) for s in strata)))
    rows = df.crossJoin(F.broadcast(cut)).select(kinds.alias("_s"), e.alias("_e"), (F.col(y) >= F.col("_cut")).alias("_t"))  # one row
    n_tail, high = F.count_if("_t"), F.when(F.col("_t"), F.col("_e"))
    return (
        rows.groupBy("_s.kind", "_s.value")
        .agg(
            F.count("*").alias("n"),
            F.avg("_e").alias("bias"),
            F.sqrt(F.avg(F.col("_e") * F.col("_e"))).alias("rmse"),
            n_tail.alias("n_tail"),
            F.when(n_tail >= least_tail, F.avg(high)).alias("bias_p90"),
            F.when(n_tail >= least_tail, F.sqrt(F.avg(high * high))).alias("rmse_p90"),
        )
        .filter(F.col("n") >= least)
    )


def direction_scores(df: DataFrame, metric: str, higher_is_better: bool, by: Sequence[str] = ()) -> Column:
    """0 to 1, best 1: the metric between its least and greatest value (0.5 where they are the same)."""
    w = Window.partitionBy(*by)
    lo, hi = F.min(metric).over(w), F.max(metric).over(w)
    share = (F.col(metric) - lo) / (hi - lo)
    return F.when(hi - lo < 1e-12, F.lit(0.5)).otherwise(share if higher_is_better else 1 - share)
