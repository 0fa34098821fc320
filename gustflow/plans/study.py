"""Plans that put operators together: the feature study's arms and the corrected grid."""

from __future__ import annotations

import hashlib
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import cluster_number
from ..operators.selection import winners_with_fallback
from ..operators.spatial import assign_polygon, corrected_grid, idw, idw_weights, k_nearest


@dataclass(frozen=True)
class Arm:
    """A set of features to fit models on, and what it is compared with."""

    name: str
    features: tuple[str, ...]
    kind: str = "group"
    reference: str | None = None
    subject: str | None = None

    @property
    def fingerprint(self) -> str:
        return hashlib.md5(",".join(sorted(self.features)).encode()).hexdigest()


def build_arms(base: Sequence[str], groups: dict[str, Sequence[str]], controls: dict[str, Sequence[str]] | None = None) -> list[Arm]:
    """base, full, base plus each group, full without each group, base plus each control.

    ValueError if a feature stands in two groups or in the base and a group.
    """
    seen = list(base) + [f for g in groups.values() for f in g]
    if len(seen) != len(set(seen)):
        raise ValueError("a feature stands in two groups")
    full = tuple(seen)
    arms = [Arm("base", tuple(base), "anchor"), Arm("full", full, "anchor")]
    for name, features in groups.items():
        arms.append(Arm(f"add_{name}", tuple(base) + tuple(features), "group", "base", name))
        arms.append(Arm(f"drop_{name}", tuple(f for f in full if f not in features), "group", "full", name))
    for name, features in (controls or {}).items():
        arms.append(Arm(f"control_{name}", tuple(base) + tuple(features), "control", "base", name))
    return arms


def resolved_features(spec: str, core: Sequence[str], columns: Sequence[str], prefix: str = "nf_", static: Sequence[str] = ()) -> list[str]:
    """Features of a comma list of groups (core, discovered, static, dynamic, all), in canonical order."""
    found = [c for c in columns if c.startswith(prefix)]
    parts = {"core": list(core), "discovered": found, "static": [c for c in found if c in static], "dynamic": [c for c in found if c not in static]}
    parts["all"] = parts["core"] + found
    tokens = [t.strip() for t in spec.split(",") if t.strip()]
    if not tokens or any(t not in parts for t in tokens):
        raise ValueError(f"unknown feature groups in {spec!r}; there are {sorted(parts)}")
    wanted = {f for t in tokens for f in parts[t]}
    out = [f for f in [*core, *found] if f in wanted]
    if not out:
        raise ValueError(f"{spec!r} has no features here")
    return out


@dataclass
class Checked:
    """Collects what is wrong with a configuration, to say it all at once."""

    errors: list[str] = field(default_factory=list)

    def need(self, ok: bool, message: str) -> None:
        if not ok:
            self.errors.append(message)

    def done(self) -> None:
        if self.errors:
            raise ValueError("; ".join(self.errors))


class LegacyArtifact(RuntimeError):
    """A model kept by an older schema; it must be fitted again."""


class UnsupportedResolution(RuntimeError):
    """A model of another time resolution than its user needs."""


def checked_artifact(meta: dict, resolution: str | None = None, schema: int = 2, legacy: Sequence[str] = (), banned: Sequence[str] = ()) -> dict:
    """A model's metadata if it can be used: schema and target kind are there, resolution fits, no feature is banned."""
    if meta.get("schema_version", 1) < schema or "target_kind" not in meta or meta.get("model_name") in legacy:
        raise LegacyArtifact(f"{meta.get('model_name')!r} has schema {meta.get('schema_version', 1)}; fit it again")
    derived = sorted(set(meta.get("feature_names", ())) & set(banned))
    if derived:
        raise ValueError(f"features derived from the target: {derived}")
    if resolution is not None and meta.get("resolution") != resolution:
        raise UnsupportedResolution(f"the model is {meta.get('resolution')!r}, {resolution!r} is needed")
    return meta


def corrected_product(
    grid: DataFrame, stations: DataFrame, predictions: DataFrame, scores: DataFrame, available: DataFrame, metric: str, k: int = 15, in_sample: Column | None = None
) -> DataFrame:
    """The corrected grid: winners by cluster and season, their residuals at stations, interpolated, added.

    grid: (point, lat, lon, day, proxy); stations: (id, lat, lon); predictions: (pipeline, arm, cluster,
    season, id, day, y_pred, proxy); scores: (pipeline, arm, cluster, season, metrics).
    """
    keys = ["pipeline", "arm"]
    chosen = winners_with_fallback(scores, available, ["cluster", "season"], metric, keys)
    stitched = predictions.join(F.broadcast(chosen.select(*keys, "cluster", "season")), [*keys, "cluster", "season"])  # a row per cluster and season
    bias = stitched.select("id", "day", (F.col("y_pred") - F.col("proxy")).alias("bias"))
    nodes = grid.select("point", "lat", "lon").distinct()
    weights = idw_weights(k_nearest(nodes, stations, k), "point")
    spread = idw(weights, bias, "point", "day", "bias")
    return corrected_grid(grid.join(spread, ["point", "day"], "left"), "proxy", "bias", in_sample if in_sample is not None else F.lit(False))


def station_clusters(stations: DataFrame, shapes: DataFrame, station: str, lon: str = "lon", lat: str = "lat", label: str = "cluster", out: str = "cluster_id") -> DataFrame:
    """station, cluster_id: the number in the label of the shape that a station lies within, -1 for none.

    ``shapes`` is what ``sources.shapes.scan_shapes`` reads. A station's first place counts (the least longitude, then
    latitude, of several) and, of several shapes around it, the first of the file; a label that is no number is -1.
    """
    placed = stations.groupBy(station).agg(F.min(F.struct(F.col(lon).alias("x"), F.col(lat).alias("y"))).alias("_at")).select(station, "_at.x", "_at.y")
    within = assign_polygon(placed, shapes.select(F.col("shape_id").alias("id"), "parts"), "x", "y", out="_shape")
    numbers = shapes.select(F.col("shape_id").alias("_shape"), cluster_number(F.col(label).cast("string")).alias(out))
    return within.join(numbers, "_shape", "left").select(station, F.coalesce(out, F.lit(-1)).alias(out))
