"""Scalar expressions of the weather domain and small helpers, all built from Spark functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of the domain.
GRAVITY = 9.80665
GUST_LOW, GUST_HIGH = 0.0, 80.0
LEAST_WIND = 0.1


def present(c: Column) -> Column:
    """The number, with NaN and infinities as null: both mean a missing value."""
    return F.when(F.isnan(c) | (F.abs(c) == float("inf")), F.lit(None)).otherwise(c)


def clipped(c: Column, low: float | None = GUST_LOW, high: float | None = GUST_HIGH) -> Column:
    """c within [low, high]; null stays null (least and greatest would skip it)."""
    out = c
    if low is not None:
        out = F.greatest(out, F.lit(low))
    if high is not None:
        out = F.least(out, F.lit(high))
    return F.when(c.isNotNull(), out)


def wind_speed(u: Column, v: Column) -> Column:
    """Length of the wind vector; taken hourly, before any daily statistic."""
    return F.hypot(u, v)


def wind_shear(u_high: Column, v_high: Column, u_low: Column, v_low: Column) -> Column:
    return F.hypot(u_high - u_low, v_high - v_low)


def gust_factor(gust: Column, mean: Column) -> Column:
    """Gust over mean wind, the latter at least 0.1."""
    return gust / clipped(mean, LEAST_WIND, None)


def relative_humidity(temperature_k: Column, dewpoint_k: Column) -> Column:
    """Percent by the Magnus formula, within [0, 100]."""
    vapour = lambda t: F.exp(17.625 * t / (t + 243.04))
    t, d = temperature_k - 273.15, dewpoint_k - 273.15
    return clipped(100 * vapour(d) / vapour(t), 0.0, 100.0)


def direction_parts(u: Column, v: Column) -> tuple[Column, Column]:
    """Sine and cosine of the direction that the vector points to."""
    angle = F.atan2(v, u)
    return F.sin(angle), F.cos(angle)


def day_of_year_parts(day: Column) -> tuple[Column, Column]:
    angle = 2 * F.pi() * F.dayofyear(day) / 365.25
    return F.sin(angle), F.cos(angle)


def month_parts(day: Column) -> tuple[Column, Column]:
    angle = 2 * F.pi() * F.month(day) / 12
    return F.sin(angle), F.cos(angle)


def season(day: Column) -> Column:
    """DJF, MAM, JJA or SON."""
    m = F.month(day)
    return (
        F.when(m.isin(12, 1, 2), "DJF").when(m.isin(3, 4, 5), "MAM").when(m.isin(6, 7, 8), "JJA").when(m.isNotNull(), "SON")
    )


def geopotential_height(geopotential: Column) -> Column:
    return geopotential / GRAVITY


def ratio_target(y: Column, proxy: Column) -> Column:
    return y / clipped(proxy, LEAST_WIND, None)


def from_ratio(ratio: Column, proxy: Column) -> Column:
    return ratio * clipped(proxy, LEAST_WIND, None)


def vector_from_direction(degrees: Column) -> tuple[Column, Column]:
    """(u, v) of a unit wind that comes from the direction."""
    a = F.radians(degrees)
    return -F.sin(a), -F.cos(a)


def direction_from_vector(u: Column, v: Column) -> Column:
    return F.pmod(F.degrees(F.atan2(-u, -v)) + 360, F.lit(360.0))


def variable_of(column: Column) -> Column:
    """The variable behind a derived column's name: lag, window and statistic suffixes are cut off."""
    return F.regexp_replace(column, r"(_(lag\d+[hd]?|max_prev\d+h|roll\d+[hd]?|mean|max|min|std|diff|range))+$", "")


def lookback_hours(column: Column) -> Column:
    """Hours that a column's name looks back, 0 if none: ..._lag3h, ..._prev6h, ..._delta3h, ..._tend_3h."""
    hours = F.regexp_extract(column, r"(?:lag|prev|delta|tend_?)(\d+)h$", 1)
    return F.when(hours != "", hours.cast("int")).otherwise(0)


def purge_days(hours: Column) -> Column:
    """Aggregate: days that a split keeps apart at its borders, for columns that look back so many hours (0 for no columns)."""
    return F.coalesce(F.ceil(F.max(hours) / 24), F.lit(0)).cast("int")


def column_group(column: Column, group_of: dict[str, str]) -> Column:
    """The group of a column's name; controls (noise, permuted statics) and unknown names have groups of their own."""
    known = F.create_map(*(F.lit(x) for pair in group_of.items() for x in pair)) if group_of else F.create_map().cast("map<string,string>")
    return F.when(column == "ctrl_noise", "noise").when(column.startswith("perm_"), "permuted").otherwise(F.coalesce(F.try_element_at(known, column), F.lit("unknown")))


def target_kind(kind: Column, model: Column) -> Column:
    """What an artifact predicts: as it says, else a ratio for the multi-layer perceptron and absolute values for others."""
    return F.coalesce(kind, F.when(model == "MLPRegressor", "ratio").otherwise("absolute"))


def level_label(level: Column) -> Column:
    """850.0 -> 850, 0.5 -> 0p5."""
    return F.when(level == F.floor(level), level.cast("long").cast("string")).otherwise(
        F.replace(level.cast("string"), F.lit("."), F.lit("p"))
    )


def cluster_number(label: Column) -> Column:
    """A label as a cluster number: '1.0' is 1, what is no whole number ('1-2') is null."""
    return label.try_cast("double").try_cast("int")


def pinball(y: Column, pred: Column, tau: float) -> Column:
    u = y - pred
    return F.greatest(tau * u, (tau - 1) * u)


def huber(y: Column, pred: Column, delta: float) -> Column:
    e = F.abs(y - pred)
    return F.when(e <= delta, 0.5 * e * e).otherwise(delta * (e - 0.5 * delta))
