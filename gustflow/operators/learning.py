"""Models on pyspark.ml, scoring by expressions, importances, folds, regimes."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.regression import DecisionTreeRegressor, GBTRegressor, GeneralizedLinearRegression, LinearRegression, RandomForestRegressor
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .quantiles import quantile, quantiles

#: The model zoo: name -> estimator over "features".
ZOO = {
    "linear": lambda: LinearRegression(),
    "ridge": lambda: LinearRegression(regParam=0.1, elasticNetParam=0.0),
    "lasso": lambda: LinearRegression(regParam=0.1, elasticNetParam=1.0),
    "elastic_net": lambda: LinearRegression(regParam=0.1, elasticNetParam=0.5),
    "glm": lambda: GeneralizedLinearRegression(family="gaussian", regParam=0.01),
    "tree": lambda: DecisionTreeRegressor(maxDepth=5, seed=42),
    "forest": lambda: RandomForestRegressor(numTrees=20, maxDepth=5, seed=42),
    "boosted": lambda: GBTRegressor(maxIter=10, maxDepth=3, seed=42),
}


def assembled(df: DataFrame, features: Sequence[str]) -> DataFrame:
    return VectorAssembler(inputCols=list(features), outputCol="features", handleInvalid="skip").transform(df)


def screened(train: DataFrame, other: DataFrame, features: Sequence[str], y: str, models: Sequence[str]) -> DataFrame:
    """other's rows with model and y_pred, once for each model of the zoo fitted on train."""
    x = assembled(train, features)
    z = assembled(other, features)
    for i, name in enumerate(models):  # each adds its column, so that other is read once
        z = ZOO[name]().setLabelCol(y).setFeaturesCol("features").setPredictionCol(f"_p{i}").fit(x).transform(z)
    each = F.array(*(F.struct(F.lit(name).alias("model"), F.col(f"_p{i}").alias("y_pred")) for i, name in enumerate(models)))
    return z.select(*other.columns, F.explode(each).alias("_m")).select(*other.columns, "_m.model", "_m.y_pred")


def simple_regressions(df: DataFrame, by: Sequence[str], x: str, y: str) -> DataFrame:
    """by, slope, intercept, n: least squares of y on one feature per group, in one aggregation."""
    return df.groupBy(*by).agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.regr_count(y, x).alias("n"))


def scored_by_group(df: DataFrame, models: DataFrame, fine: Sequence[str], coarse: Sequence[str], x: str, least: int = 10) -> DataFrame:
    """df with y_pred: by the model of the row's fine group (cluster, season) if it has ``least`` rows,
    else by that of its coarse group; null where x is null."""
    a = models.filter(F.col("n") >= least).select(*fine, F.col("slope").alias("_s1"), F.col("intercept").alias("_i1"))
    pooled = models.filter(" AND ".join(f"{c} IS NULL" for c in fine if c not in coarse))
    b = pooled.select(*coarse, F.col("slope").alias("_s0"), F.col("intercept").alias("_i0"))
    joined = df.join(a, list(fine), "left").join(b, list(coarse), "left")
    use = lambda f, c: F.when(F.col("_s1").isNotNull(), F.col(f)).otherwise(F.col(c))
    return joined.withColumn("y_pred", use("_s1", "_s0") * F.col(x) + use("_i1", "_i0")).drop("_s0", "_i0", "_s1", "_i1")


def ablation_importance(df: DataFrame, predict, features: Sequence[str], y: str) -> DataFrame:
    """feature, delta_rmse when the feature is replaced by its mean; predict: df -> Column."""
    means = df.agg(*(F.avg(c).alias(c) for c in features)).first()
    error = lambda p: F.sqrt(F.avg((p - F.col(y)) * (p - F.col(y))))
    base = predict({c: F.col(c) for c in features})
    exprs = [
        (error(predict({c: (F.lit(means[c]) if c == f else F.col(c)) for c in features})) - error(base)).alias(f) for f in features
    ]
    wide = df.agg(*exprs)
    return wide.select(F.explode(F.array(*(F.struct(F.lit(f).alias("feature"), F.col(f).alias("delta_rmse")) for f in features))).alias("_x")).select("_x.*")


def permutation_importance(
    df: DataFrame, predict, blocks: dict[str, Sequence[str]], keys: Sequence[str], y: str, repeats: int = 3, seed: int = 0, by: Sequence[str] = (), q: float = 0.9
) -> DataFrame:
    """by, block, repeat, delta_rmse, delta_rmse_p90 when the block's columns come from other rows.

    One permutation of all rows in each repeat gives every row its partner; each block then takes the partner's
    values of its columns only, and all blocks are scored in one aggregation. The tail is y at least its quantile.
    The rows that all repeats read are computed once.
    """
    from .relations import with_partner

    features = list(dict.fromkeys(c for b in blocks.values() for c in b))
    read = df.select(*dict.fromkeys([*by, *keys, *features, y])).persist()
    cut = quantile(read, [], y, q, "_cut")
    rows = read.crossJoin(F.broadcast(cut)).withColumn("_tail", F.col(y) >= F.col("_cut")).drop("_cut")  # one row
    tail = F.col("_tail")

    def errors(swapped: Sequence[str]) -> tuple[Column, Column]:
        p = predict({c: F.col(f"_o.{c}") if c in swapped else F.col(c) for c in features})
        e2 = (p - F.col(y)) * (p - F.col(y))
        return F.sqrt(F.avg(e2)), F.sqrt(F.avg(F.when(tail, e2)))

    base = errors(())
    out = None
    for r in range(repeats):
        scores = []
        for name, columns in blocks.items():
            whole, high = errors(columns)
            scores.append(F.struct(F.lit(name).alias("block"), (whole - base[0]).alias("delta_rmse"), (high - base[1]).alias("delta_rmse_p90")))
        summed = with_partner(rows, keys, features, seed + r, "_o").groupBy(*by).agg(F.array(*scores).alias("_s"))
        part = summed.select(*by, F.explode("_s").alias("_s")).select(*by, "_s.block", F.lit(r).alias("repeat"), "_s.delta_rmse", "_s.delta_rmse_p90")
        out = part if out is None else out.unionByName(part)
    return out


def hour_bands(variables: dict[str, Sequence[str]], width: int = 4) -> dict[str, list[str]]:
    """Blocks "name 04-07h" of the columns <name>_h<hour>; ValueError unless width divides 24.

    Variables without all 24 hours have no daily cycle and are left out.
    """
    if 24 % width:
        raise ValueError(f"a band of {width} hours does not divide the day")
    out = {}
    for name, columns in variables.items():
        at = {int(c.rsplit("_h", 1)[1]): c for c in columns if c.rsplit("_h", 1)[-1].isdigit()}
        if len(at) == 24:
            out |= {f"{name} {h:02d}-{h + width - 1:02d}h": [at[k] for k in range(h, h + width)] for h in range(0, 24, width)}
    return out


def linear_shap(df: DataFrame, coefficients: dict[str, float]) -> dict[str, Column]:
    """Contribution of each feature of a linear model: its coefficient times its distance from the mean."""
    w = Window.partitionBy()
    return {c: F.lit(b) * (F.col(c) - F.avg(c).over(w)) for c, b in coefficients.items()}


def linear_shap_shares(df: DataFrame, coefficients: dict[str, float], group_of: dict[str, str]) -> DataFrame:
    """group, share of the mean absolute contributions of its features."""
    means = df.agg(*(F.avg(c).alias(f"_m_{c}") for c in coefficients))
    sizes = df.crossJoin(F.broadcast(means)).agg(*(F.avg(F.abs(b * (F.col(c) - F.col(f"_m_{c}")))).alias(c) for c, b in coefficients.items()))  # one row
    rows = F.explode(F.array(*(F.struct(F.lit(group_of[c]).alias("group"), F.col(c).alias("v")) for c in coefficients)))
    summed = sizes.select(rows.alias("_r")).groupBy("_r.group").agg(F.sum("_r.v").alias("v"))
    return summed.select("group", (F.col("v") / F.nullif(F.sum("v").over(Window.partitionBy()), F.lit(0.0))).alias("share"))


def partial_dependence(df: DataFrame, predict, features: Sequence[str], swept: str, steps: int = 200) -> DataFrame:
    """step, value, y_pred: the median row with one feature swept over its range."""
    medians = quantiles(df, [], features, [0.5]).select(*(F.get(c, F.lit(0)).alias(c) for c in features))
    middle = medians.crossJoin(df.agg(F.min(swept).alias("_lo"), F.max(swept).alias("_hi")))  # one row
    line = middle.withColumn("step", F.explode(F.sequence(F.lit(0), F.lit(steps - 1))))
    value = F.col("_lo") + F.col("step") * (F.col("_hi") - F.col("_lo")) / (steps - 1)
    at = line.withColumn("value", value)
    return at.select("step", "value", predict({c: (F.col("value") if c == swept else F.col(c)) for c in features}).alias("y_pred"))


def regimes(daily: DataFrame, columns: Sequence[str], order_by: str, k: int = 4, seed: int = 42) -> DataFrame:
    """daily with regime: k-means on standardised columns, numbered by ascending mean of ``order_by``."""
    x = assembled(daily, columns)
    scaled = StandardScaler(inputCol="features", outputCol="scaled", withMean=True).fit(x).transform(x)
    found = KMeans(k=k, seed=seed, featuresCol="scaled", predictionCol="_c").fit(scaled).transform(scaled)
    names = found.groupBy("_c").agg(F.avg(order_by).alias("_m")).withColumn("regime", F.row_number().over(Window.orderBy("_m")) - 1)  # k rows
    return found.join(F.broadcast(names.select("_c", "regime")), "_c").select(*daily.columns, "regime")


def spatial_folds(stations: DataFrame, folds: int, seed: int = 42) -> DataFrame:
    """stations (lat, lon) with fold: k-means on their places; one fold each if there are too few."""
    if stations.count() <= folds:
        return stations.withColumn("fold", F.row_number().over(Window.orderBy("lat", "lon")) - 1)  # at most ``folds`` rows
    x = assembled(stations, ["lat", "lon"])
    return KMeans(k=folds, seed=seed, predictionCol="fold").fit(x).transform(x).drop("features")


def sampled_validation(units: Sequence[tuple[int, int]], test_months: Sequence[int], fraction: float, seed: int) -> list[tuple[int, int]]:
    """(year, month) blocks for validation: of each training month, round(fraction * n) years, at least
    one and not all, drawn without replacement."""
    rng = np.random.default_rng(seed)
    out = []
    for month in sorted({m for _, m in units if m not in test_months}):
        years = sorted(y for y, m in units if m == month)
        if len(years) > 1:
            n = min(len(years) - 1, max(1, round(fraction * len(years))))
            out += [(int(y), month) for y in rng.choice(years, size=n, replace=False)]
    return sorted(out)


