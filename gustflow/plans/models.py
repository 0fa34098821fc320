"""Kept models: a table of linear models with what is needed to use them, and scoring of a grid with them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .study import LegacyArtifact, UnsupportedResolution

#: Version of the table's layout, and its columns beside the group's.
SCHEMA_VERSION = 2
COLUMNS = ("arm", "model", "n", "features", "coefficients", "intercept", "r2", "target_kind", "resolution", "split", "harmonics", "schema_version")
#: The season of models fitted on all seasons, and the range of predictions in metres a second.
POOLED, CLIP = "ALL", (0.0, 80.0)


def champions(scored: DataFrame, by: Sequence[str]) -> DataFrame:
    """Of each group's models the one with the greatest r2 on the selection rows; ties go to arm and model by name."""
    best = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc_nulls_last("r2"), "arm", "model"))
    return scored.filter(F.col("r2").isNotNull()).withColumn("_r", best).filter("_r = 1").drop("_r")


def model_table(models: DataFrame, by: Sequence[str], split: str, target_kind: str = "absolute", resolution: str = "daily", harmonics: int = 3) -> DataFrame:
    """models as a table to keep: with the split (as text) and climatology they were trained by, and the target's kind."""
    if target_kind not in ("absolute", "ratio"):
        raise ValueError(f"target kind {target_kind!r}")
    meta = {"target_kind": target_kind, "resolution": resolution, "split": split, "harmonics": harmonics, "schema_version": SCHEMA_VERSION}
    return models.withColumns({k: F.lit(v) for k, v in meta.items()}).select(*by, *COLUMNS)


def keep_models(table: DataFrame, path: str) -> None:
    """Write a table of models as Parquet; models are kept beside those that are there."""
    table.write.mode("append").parquet(path)


def read_models(spark: SparkSession, path: str, by: Sequence[str], resolution: str = "daily", banned: Sequence[str] = ()) -> DataFrame:
    """The models kept at ``path``; refused where any is of an older layout, another resolution or has a banned feature.

    Of a group kept more than once only one of the same values may be there; others are refused when it is used.
    """
    found = spark.read.option("mergeSchema", "true").parquet(path)
    lacking = [c for c in (*by, *COLUMNS) if c not in found.columns]
    if lacking:
        raise LegacyArtifact(f"models at {path} have no {', '.join(lacking)}; fit them again")
    bad = found.agg(
        F.count_if(F.coalesce(F.col("schema_version") < SCHEMA_VERSION, F.lit(True))).alias("old"),
        F.count_if(F.col("resolution") != resolution).alias("other"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.array_intersect("features", F.array(*map(F.lit, banned)).cast("array<string>")))))).alias("banned"),
    ).first()
    if bad["old"]:
        raise LegacyArtifact(f"{bad['old']} models at {path} are of an older schema; fit them again")
    if bad["other"]:
        raise UnsupportedResolution(f"{bad['other']} models at {path} are not {resolution}")
    if bad["banned"]:
        raise ValueError(f"features derived from the target: {bad['banned']}")
    return found.select(*by, *COLUMNS)


def predicted(models_on: str, features: Sequence[str], proxy: str | None, clip: tuple[float, float]) -> Column:
    """The prediction of the model in struct column ``models_on`` from a row's features; null where one is missing."""
    m = F.col(models_on)
    values = F.create_map(*(x for c in features for x in (F.lit(c), F.col(c).cast("double"))))
    known = lambda v: F.when(F.abs(v) < float("inf"), v)
    products = F.zip_with(m["features"], m["coefficients"], lambda c, b: b * known(values[c]))
    raw = F.aggregate(products, m["intercept"], lambda acc, x: acc + x)
    if proxy is not None:
        raw = F.when(m["target_kind"] == "ratio", raw * F.greatest(F.col(proxy), F.lit(0.1))).otherwise(raw)
    # greatest and least pass over nulls
    return F.when(raw.isNotNull(), F.greatest(F.least(raw, F.lit(clip[1])), F.lit(clip[0])))


def score_grid(
    grid: DataFrame, models: DataFrame, features: Sequence[str], cluster: str = "cluster", season: str = "season", proxy: str | None = None, clip: tuple[float, float] = CLIP
) -> DataFrame:
    """grid with y_pred and model_season: by the model of its cluster and season where one is kept, else of its cluster.

    Rows of clusters without models, and rows that lack a feature of their model, have a null y_pred. The models
    (one per cluster and season) are sent to the tasks up to Spark's broadcast limit, and joined by shuffle beyond.
    """
    one = F.struct("features", "coefficients", "intercept", "target_kind")
    own = models.filter(F.col(season) != POOLED).select(cluster, season, one.alias("_own"))
    pooled = models.filter(F.col(season) == POOLED).select(cluster, one.alias("_pooled"))
    met = grid.join(own, [cluster, season], "left").join(pooled, cluster, "left")
    used = F.when(F.col("_own").isNotNull(), F.col(season)).when(F.col("_pooled").isNotNull(), F.lit(POOLED))
    chosen = met.withColumn("_m", F.coalesce("_own", "_pooled"))
    return chosen.withColumns({"y_pred": predicted("_m", features, proxy, clip), "model_season": used}).select(*grid.columns, "y_pred", "model_season")
