"""Daily features from hourly rows, peak rows, climatologies, completeness rules, scaling, mapping."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import gust_factor
from .gram import correlation_matrix
from .quantiles import place, quantiles

#: Harmonics of the climatology, and the samples a station needs.
HARMONICS, LEAST_SAMPLES = 3, 30


def daily_statistics(df: DataFrame, keys: Sequence[str], ts: str, value: str) -> DataFrame:
    """keys, day and mean, max, min, population std, range of the day's known values, with n."""
    return df.groupBy(*keys, F.to_date(ts).alias("day")).agg(
        F.count(value).alias("n"),
        F.avg(value).alias("mean"),
        F.max(value).alias("max"),
        F.min(value).alias("min"),
        F.stddev_pop(value).alias("std"),
        (F.max(value) - F.min(value)).alias("range"),
    )


def complete_days(df: DataFrame, keys: Sequence[str], ts: str, value: str, hours: int = 24) -> DataFrame:
    """keys, day of the days with ``hours`` different hours and no null value."""
    return (
        df.groupBy(*keys, F.to_date(ts).alias("day"))
        .agg(F.count_distinct(F.hour(ts)).alias("_h"), F.count_if(F.col(value).isNull()).alias("_null"))
        .filter((F.col("_h") >= hours) & (F.col("_null") == 0))
        .select(*keys, "day")
    )


def complete_variables(df: DataFrame, variable: str, day: str) -> DataFrame:
    """Variables that have every day that any variable has."""
    held = df.select(variable, day).distinct()
    every = held.select(day).distinct().agg(F.count("*").alias("_all"))
    return held.groupBy(variable).agg(F.count("*").alias("_n")).crossJoin(F.broadcast(every)).filter("_n = _all").select(variable)  # one row


def peak_rows(df: DataFrame, keys: Sequence[str], ts: str, value: str, hours: int = 1) -> DataFrame:
    """The row of each key and day with the greatest value, the earliest of equals.

    Days count only with all values known and, where ``hours`` is above 1, with at least so many different
    hours; there, two rows of one hour are an error.
    """
    day = F.to_date(ts)
    by = Window.partitionBy(*keys, "day")
    counted = df.withColumn("day", day).withColumn("_known", F.count(value).over(by)).withColumn("_rows", F.count("*").over(by))
    if hours > 1:
        held = F.size(F.collect_set(F.hour(ts)).over(by))
        checked = F.when(F.col("_held") == F.col("_rows"), F.col("_held")).otherwise(F.raise_error(F.lit("an hour comes twice")).cast("int"))
        counted = counted.withColumn("_held", held).filter(checked >= hours).drop("_held")
    return (
        counted.filter(F.col("_rows") - F.col("_known") == 0)  # an equality would let Spark put one for the other in the check
        .withColumn("_r", F.row_number().over(by.orderBy(F.desc(value), ts)))
        .filter("_r = 1")
        .drop("_known", "_rows", "_r")
    )


def climatology(df: DataFrame, key: str, day: str, value: str) -> DataFrame:
    """key, doy, mean over the rows of each day of the year."""
    return df.groupBy(key, F.dayofyear(day).alias("doy")).agg(F.avg(value).alias("clim"))


def harmonic_climatology(df: DataFrame, key: str, day: str, value: str, harmonics: int = HARMONICS, least: int = LEAST_SAMPLES) -> DataFrame:
    """key, doy (1 to 366), clim: least squares on harmonics of the year; null with too few samples.

    Rows are summed to the terms of each key's normal equations, one row per key; those few sums are
    solved in one small call per key.
    """
    theta = 2 * F.pi() * (F.dayofyear(day) - 1) / 365.25
    terms: list[Column] = [F.lit(1.0)]
    for k in range(1, harmonics + 1):
        terms += [F.cos(k * theta), F.sin(k * theta)]
    n = len(terms)
    rows = df.filter(F.col(value).isNotNull()).select(key, *(t.alias(f"t{i}") for i, t in enumerate(terms)), F.col(value).alias("y"))
    sums = rows.groupBy(key).agg(
        F.array(*(F.sum(F.col(f"t{i}") * F.col(f"t{j}")) for i in range(n) for j in range(n))).alias("a"),
        F.array(*(F.sum(F.col(f"t{i}") * F.col("y")) for i in range(n))).alias("b"),
        F.count("*").alias("n"),
    )

    @F.pandas_udf("array<double>")
    def solved(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([np.linalg.pinv(np.reshape(x, (n, n))) @ np.asarray(y) for x, y in zip(a, b, strict=True)])

    fitted = sums.withColumn("c", F.when(F.col("n") >= max(least, n), solved("a", "b"))).select(key, "c")
    at = 2 * F.pi() * (F.col("doy") - 1) / 365.25
    curve = F.get("c", F.lit(0))
    for k in range(1, harmonics + 1):
        curve = curve + F.get("c", F.lit(2 * k - 1)) * F.cos(k * at) + F.get("c", F.lit(2 * k)) * F.sin(k * at)
    return fitted.withColumn("doy", F.explode(F.sequence(F.lit(1), F.lit(366)))).select(key, "doy", curve.alias("clim"))


def population_climatology(df: DataFrame, key: str, day: str, value: str, harmonics: int = HARMONICS) -> DataFrame:
    """key, doy (1 to 366), clim: a least-squares fit to the means of each day of the year, all stations of a key together.

    Each day of the year that has values counts once.
    """
    known = df.filter(F.col(value).isNotNull())
    return fitted_year(known.groupBy(key, F.dayofyear(day).alias("doy")).agg(F.avg(value).alias("m")), key, harmonics)


def fitted_year(means: DataFrame, key: str, harmonics: int = HARMONICS) -> DataFrame:
    """key, doy (1 to 366), clim, fitted to means (key, doy, m).

    As many harmonics are fitted as the days support, (days - 1) // 2 at most; with fewer than three days the
    climatology is their mean. A key has 366 means at most, so the fit is one small call per key.
    """
    per_key = means.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("doy", "m"))).alias("obs"))

    @F.pandas_udf("array<double>")
    def fitted(days: pd.Series, obs: pd.Series) -> pd.Series:
        def terms(doy: np.ndarray, n: int) -> np.ndarray:
            angle = 2 * np.pi * np.asarray(doy, dtype=float)[:, None] / 365.25 * np.arange(1, n + 1)
            return np.hstack([np.ones((len(doy), 1)), np.cos(angle), np.sin(angle)])

        out = []
        for doy, m in zip(days, obs, strict=True):
            n = min(harmonics, max(0, (len(doy) - 1) // 2))
            out.append(terms(np.arange(1, 367), n) @ np.linalg.lstsq(terms(doy, n), np.asarray(m), rcond=None)[0])
        return pd.Series(out)

    curve = per_key.select(key, fitted(F.col("obs.doy"), F.col("obs.m")).alias("curve"))
    return curve.select(key, F.posexplode("curve").alias("at", "clim")).select(key, (F.col("at") + 1).alias("doy"), "clim")


def holdout_climatology(df: DataFrame, fold: str, label: str, day: str, value: str, train: str = "train") -> DataFrame:
    """fold, doy, clim: for each fold the population climatology of the training rows of all other folds.

    Rows are summed once by fold and day of the year; what the others hold is the total without the fold's own
    part, so no row is copied to the folds that it trains.
    """
    rows = df.filter((F.col(label) == train) & F.col(value).isNotNull())
    own = rows.groupBy(fold, F.dayofyear(day).alias("doy")).agg(F.sum(value).alias("_s"), F.count("*").alias("_n"))
    total = own.groupBy("doy").agg(F.sum("_s").alias("_all"), F.sum("_n").alias("_rows"))
    grid = df.select(fold).filter(F.col(fold).isNotNull()).distinct().crossJoin(F.broadcast(total))  # at most 366 rows
    left = grid.join(own, [fold, "doy"], "left")
    n = F.col("_rows") - F.coalesce("_n", F.lit(0))
    means = left.filter(n > 0).select(fold, "doy", ((F.col("_all") - F.coalesce("_s", F.lit(0.0))) / n).alias("m"))
    return fitted_year(means, fold)


def holdout_sizes(df: DataFrame, station: str, fold: str, label: str, train: str = "train", test: str = "test", least: int = 20) -> DataFrame:
    """fold, stations (held out), n_train (training rows of the others), n_eval (test rows of its own), for folds with
    at least ``least`` rows to train on and any to evaluate."""
    own = df.groupBy(fold).agg(
        F.count_distinct(station).alias("stations"), F.count_if(F.col(label) == train).alias("_t"), F.count_if(F.col(label) == test).alias("n_eval")
    )
    every = own.agg(F.sum("_t").alias("_all"))
    out = own.crossJoin(F.broadcast(every)).select(fold, "stations", (F.col("_all") - F.col("_t")).alias("n_train"), "n_eval")  # one row
    return out.filter((F.col("n_train") >= least) & (F.col("n_eval") > 0))


#: The grid's columns that the station features are rebuilt from.
REQUIRED_BASIN = (
    "ws_mean_basin", "ws_max_basin", "ws_std_basin", "sin_dir_mean_basin", "cos_dir_mean_basin", "t2m_mean_basin",
    "t2m_range_basin", "td_dep_mean_basin", "rh_mean_basin", "msl_mean_basin", "d_msl_basin", "tp_sum_basin",
)


def rebuilt_features(df: DataFrame, key: str, day: str) -> DataFrame:
    """df (one row per key and day) with the station features under their old names; ValueError names missing columns.

    Lags and rolling means follow the calendar: a lag is null if its day is not there, the means need 3 of 7
    and 2 of 3 days.
    """
    missing = [c for c in REQUIRED_BASIN if c not in df.columns]
    if missing:
        raise ValueError(f"columns of the grid are missing: {missing}")
    c = F.col
    at = F.datediff(c(day), F.lit("1970-01-01").cast("date"))
    order = Window.partitionBy(key).orderBy(at)
    on_day = lambda v, k: F.max(v).over(order.rangeBetween(-k, -k))
    mean = lambda k, least: F.when(F.count("ws_max_basin").over(order.rangeBetween(1 - k, 0)) >= least, F.avg("ws_max_basin").over(order.rangeBetween(1 - k, 0)))
    made = {
        "wind_mag": c("ws_mean_basin"),
        "wind_mag_max": c("ws_max_basin"),
        "wind_mag_std": c("ws_std_basin"),
        "wind_dir_sin": c("sin_dir_mean_basin"),
        "wind_dir_cos": c("cos_dir_mean_basin"),
        "2m_temperature": c("t2m_mean_basin"),
        "t2m_range": c("t2m_range_basin"),
        "relative_humidity": c("rh_mean_basin"),
        "surface_pressure": c("msl_mean_basin"),
        "pressure_tendency": c("d_msl_basin"),
        "total_precipitation": c("tp_sum_basin"),
        "2m_dewpoint_temperature": c("t2m_mean_basin") - c("td_dep_mean_basin"),
        "10m_u_component_of_wind": c("ws_mean_basin") * c("cos_dir_mean_basin"),
        "10m_v_component_of_wind": c("ws_mean_basin") * c("sin_dir_mean_basin"),
        "gust_factor": gust_factor(c("ws_max_basin"), c("ws_mean_basin")),
        **{f"lag{k}_wind_mag_max": on_day("ws_max_basin", k) for k in (1, 2, 3, 7)},
        "rolling7d_wind_mag_max": mean(7, 3),
        "rolling3d_wind_mag_max": mean(3, 2),
    }
    out = df.withColumns(made)
    anomaly = c("wind_mag_max") - c("rolling7d_wind_mag_max")
    return out.withColumns({"wind_mag_max_anom": anomaly, "lag1_pressure_tendency": on_day("pressure_tendency", 1)})


def first_harmonic(df: DataFrame, key: str, theta: Column, value: str) -> DataFrame:
    """key, c0, c1, s1 of a least-squares fit of one harmonic, by Cramer's rule on sums alone."""
    rows = df.filter(F.col(value).isNotNull()).select(key, F.cos(theta).alias("c"), F.sin(theta).alias("s"), F.col(value).alias("y"))
    m = rows.groupBy(key).agg(
        F.count("*").cast("double").alias("n"),
        *(F.sum(e).alias(a) for a, e in {
            "sc": F.col("c"), "ss": F.col("s"), "cc": F.col("c") * F.col("c"), "cs": F.col("c") * F.col("s"), "s2": F.col("s") * F.col("s"),
            "sy": F.col("y"), "cy": F.col("c") * F.col("y"), "sny": F.col("s") * F.col("y"),
        }.items()),
    )
    det = lambda a, b, c, d, e, f, g, h, i: a * (e * i - f * h) - b * (d * i - f * g) + c * (d * h - e * g)
    n, sc, ss, cc, cs, s2, sy, cy, sny = (F.col(x) for x in ("n", "sc", "ss", "cc", "cs", "s2", "sy", "cy", "sny"))
    whole = F.nullif(det(n, sc, ss, sc, cc, cs, ss, cs, s2), F.lit(0.0))
    return m.select(
        key,
        (det(sy, sc, ss, cy, cc, cs, sny, cs, s2) / whole).alias("c0"),
        (det(n, sy, ss, sc, cy, cs, ss, sny, s2) / whole).alias("c1"),
        (det(n, sc, sy, sc, cc, cy, ss, cs, sny) / whole).alias("s1"),
    )


def station_statistics(df: DataFrame, key: str, value: str) -> DataFrame:
    """key, p10, p50, p90, and each of them standardised over the stations (population deviation)."""
    q = df.groupBy(key).agg(F.percentile(value, F.array(F.lit(0.1), F.lit(0.5), F.lit(0.9))).alias("_q"))
    stats = q.select(key, *(F.get("_q", F.lit(i)).alias(p) for i, p in enumerate(("p10", "p50", "p90"))))
    spread = stats.agg(*(f(p).alias(f"{a}_{p}") for p in ("p10", "p50", "p90") for a, f in (("m", F.avg), ("s", F.stddev_pop))))
    return stats.crossJoin(F.broadcast(spread)).select(  # one row
        key, "p10", "p50", "p90", *(((F.col(p) - F.col(f"m_{p}")) / F.nullif(F.col(f"s_{p}"), F.lit(0.0))).alias(f"z_{p}") for p in ("p10", "p50", "p90"))
    )


def complete_rows(df: DataFrame, features: Sequence[str], cluster: str, station: str, discovered: Sequence[str] = ()) -> DataFrame:
    """Rows without a null feature, of clusters whose every station has every discovered feature at all.

    Raises KeyError for a feature that df lacks.
    """
    missing = [f for f in [*features, *discovered] if f not in df.columns]
    if missing:
        raise KeyError(f"no such features: {missing}")
    rows = df
    if discovered:
        has = F.lit(True)
        for f in discovered:
            has = has & (F.count(f) > 0)
        stations = df.groupBy(cluster, station).agg(has.alias("_has"))
        good = stations.groupBy(cluster).agg(F.bool_and("_has").alias("_all")).filter("_all").select(cluster)
        rows = df.join(good, cluster, "left_semi")
    return rows.dropna(subset=[*features, *discovered])


def null_shares(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """column, share of nulls; one row of df's columns becomes a row each."""
    shares = df.agg(*(F.avg(F.col(c).isNull().cast("double")).alias(c) for c in columns))
    return shares.select(F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).alias("share")) for c in columns))).alias("_c")).select("_c.*")


def without_sparse_columns(df: DataFrame, columns: Sequence[str], limit: float = 0.01) -> tuple[DataFrame, list[str]]:
    """df without the columns whose share of nulls is above the limit, and their names."""
    sparse = [r["column"] for r in null_shares(df, columns).filter(F.col("share") > limit).collect()]  # one row per column
    return df.drop(*sparse), sorted(sparse)


def robust_scaling(train: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row: exact median and interquartile range of each column (a range of 0 counts as 1)."""
    found = quantiles(train, [], columns, [0.25, 0.5, 0.75])
    spread = lambda c: F.get(c, F.lit(2)) - F.get(c, F.lit(0))
    return found.select(
        *(F.get(c, F.lit(1)).alias(f"{c}_median") for c in columns),
        *(F.when(spread(c) == 0, F.lit(1.0)).otherwise(spread(c)).alias(f"{c}_iqr") for c in columns),
    )


def robust_scaled(df: DataFrame, scaling: DataFrame, columns: Sequence[str]) -> DataFrame:
    wide = df.crossJoin(F.broadcast(scaling))  # one row
    return wide.withColumns({c: (F.col(c) - F.col(f"{c}_median")) / F.col(f"{c}_iqr") for c in columns}).drop(*scaling.columns)


def quantile_delta_mapping(train: DataFrame, df: DataFrame, proxy: str, y: str, n: int = 100) -> DataFrame:
    """df with ``mapped``: proxy plus the difference of the quantiles of y and proxy at the proxy's
    place, linear between the n quantiles, flat beyond them."""
    fitted = quantiles(train, [], [proxy, y], [k / (n - 1) for k in range(n)]).select(F.col(proxy).alias("_x"), F.col(y).alias("_y"))
    wide = df.crossJoin(F.broadcast(fitted))  # one row
    x = F.col(proxy)
    low = F.least(F.greatest(place("_x", n, x, inclusive=True) - 1, F.lit(0)), F.lit(n - 2))
    at = wide.withColumn("_i", low)
    g = lambda c, k: F.get(c, F.col("_i") + k)
    share = F.when(g("_x", 1) > g("_x", 0), F.least(F.greatest((x - g("_x", 0)) / (g("_x", 1) - g("_x", 0)), F.lit(0.0)), F.lit(1.0))).otherwise(0.0)
    delta = lambda k: g("_y", k) - g("_x", k)
    return at.withColumn("mapped", x + delta(0) + share * (delta(1) - delta(0))).drop("_x", "_y", "_i")


def oversampled(df: DataFrame, y: str, power: float = 2.0) -> DataFrame:
    """df with each row as often as its weight (y / max)^power over the mean weight, rounded half to even, at least once."""
    top = df.agg(F.max(y).alias("_m"))
    weighted = df.crossJoin(F.broadcast(top)).withColumn("_w", F.pow(F.col(y) / F.col("_m"), power))  # one row
    mean = weighted.agg(F.avg("_w").alias("_mean"))
    times = F.greatest(F.bround(F.col("_w") / F.col("_mean")).cast("int"), F.lit(1))
    return weighted.crossJoin(F.broadcast(mean)).withColumn("copy", F.explode(F.sequence(F.lit(1), times))).drop("_m", "_w", "_mean")  # one row


def within_group_correlation(df: DataFrame, group: str, a: str, b: str) -> DataFrame:
    """Correlation of a and b after their group means are taken away; rows that lack either do not count."""
    return correlation_matrix(df, [a, b], [group]).select("corr")


def variance_parts(df: DataFrame, station: str, day: str, value: str) -> DataFrame:
    """One row: mean within-day deviation, deviation of daily means about their station's, and the share
    of variance between stations."""
    daily = df.groupBy(station, day).agg(F.avg(value).alias("m"), F.stddev_pop(value).alias("s"))
    w = Window.partitionBy(station)
    within = daily.withColumn("_c", F.col("m") - F.avg("m").over(w)).agg(F.avg("s").alias("within_day"), F.stddev_pop("_c").alias("between_days"))
    stations = df.groupBy(station).agg(F.avg(value).alias("m"), F.count(value).alias("n"))
    whole = df.agg(F.avg(value).alias("_g"), F.var_pop(value).alias("_v"), F.count(value).alias("_n"))
    share = stations.crossJoin(F.broadcast(whole)).groupBy("_v", "_n").agg(F.sum(F.col("n") * F.pow(F.col("m") - F.col("_g"), 2)).alias("_b"))  # one row
    return within.crossJoin(share.select((F.col("_b") / F.col("_n") / F.nullif(F.col("_v"), F.lit(0.0))).alias("station_share")))
