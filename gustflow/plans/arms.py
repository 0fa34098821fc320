"""The feature study as stages: arms of features, a prepared population, screening by Gram matrices, test residuals."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import gram
from ..operators.features import complete_rows
from ..operators.relations import noise_columns, numbered
from ..operators.windows import month_block_label, purge_boundaries
from ..sources.scan import exists
from .study import Arm

# Names of arm sets, of arms and of control columns, as study tables name them.
SETS = ("anchors", "singles", "groups", "controls")
ALIASES = {"core": ("anchors", "singles")}
NOISE, PERMUTED = "ctrl_noise", "perm_"

ARM_SCHEMA = "name string, features array<string>, kind string, reference string, subject string"


def wanted_sets(sets: Sequence[str]) -> list[str]:
    """Names of arm sets without repeats, 'core' spelt out; groups and controls need the anchors they are measured against."""
    names = list(dict.fromkeys(s for given in sets for s in ALIASES.get(given, (given,))))
    if unknown := sorted(set(names) - set(SETS)):
        raise ValueError(f"unknown sets of arms: {unknown}; there are {SETS} and {tuple(ALIASES)}")
    if "anchors" not in names and (needy := {"groups", "controls"} & set(names)):
        raise ValueError(f"{sorted(needy)} are measured against base and full, so 'anchors' is needed")
    return names


def study_arms(base: Sequence[str], new: Sequence[str], group_of: dict[str, str], sets: Sequence[str] = ("anchors", "groups", "controls"), static: Sequence[str] = ()) -> list[Arm]:
    """Arms of the sets, each with what it is compared with: additions with base, removals with full.

    Groups of new features only can be added; every group can be removed. The controls are a column of noise and, where
    there are new static features, these permuted among stations. ValueError for no new features, for one that is in the
    base as well, and for a feature without a group.
    """
    names = wanted_sets(sets)
    base, new = tuple(base), tuple(new)
    if not new or set(base) & set(new):
        raise ValueError(f"new features are needed that the base does not have; both have {sorted(set(base) & set(new))}")
    if lacking := [f for f in (*base, *new) if f not in group_of]:
        raise ValueError(f"features without a group: {lacking}")
    full = base + new
    members = {g: sorted(f for f in full if group_of[f] == g) for g in sorted({group_of[f] for f in full})}
    without = lambda gone: tuple(f for f in full if f not in gone)
    permuted = tuple(PERMUTED + f for f in new if f in static)
    made = {
        "anchors": [Arm("base", base, "anchor"), Arm("full", full, "anchor")],
        "singles": [Arm(f"add__{f}", (*base, f), "add", "base", f) for f in new] + [Arm(f"drop__{f}", without({f}), "drop", "full", f) for f in new],
        "groups": [Arm(f"add_grp__{g}", (*base, *m), "add", "base", g) for g, m in members.items() if set(m) <= set(new)]
        + [Arm(f"drop_grp__{g}", without(set(m)), "drop", "full", g) for g, m in members.items()],
        "controls": [Arm("ctrl__noise", (*base, NOISE), "add", "base", "noise")] + ([Arm("ctrl__perm_static", base + permuted, "add", "base", "perm_static")] if permuted else []),
    }
    arms = [a for s in names for a in made[s]]
    if len({a.name for a in arms}) < len(arms):
        raise ValueError("two arms have one name")
    return arms


def base_variable(name: str) -> str:
    """The variable behind a column's name, as ``columns.variable_of`` has it for columns of a table."""
    return re.sub(r"(_(lag\d+[hd]?|max_prev\d+h|roll\d+[hd]?|mean|max|min|std|diff|range))+$", "", name)


def selected_arms(tag: str, variables: Sequence[str], without: Sequence[str], full: Sequence[str]) -> list[Arm]:
    """The columns of chosen variables against full, and without each of some against that choice; unknown names are a ValueError."""
    there = {base_variable(f) for f in full}
    if bad := sorted(set(variables) - there) + sorted(set(without) - set(variables)):
        raise ValueError(f"no such variables: {bad}")
    chosen = tuple(f for f in full if base_variable(f) in set(variables))
    name = f"sel__{tag}"
    return [Arm(name, chosen, "drop", "full", tag)] + [Arm(f"{name}_sem_{v}", tuple(f for f in chosen if base_variable(f) != v), "drop", name, v) for v in without]


def comparisons(arms: Sequence[Arm], available: Sequence[str] | None = None) -> list[tuple[str, str, str]]:
    """(name, worse, better): what each arm adds to its reference or takes from it, full over base, static features over
    permuted ones, the selection over base; those only whose two arms are available."""
    have = {a.name for a in arms}
    out = [(a.name, a.reference, a.name) if a.kind == "add" else (a.name, a.name, a.reference) for a in arms if a.reference]
    out.append(("full_vs_base", "base", "full"))
    out += [("real_vs_perm_static", "ctrl__perm_static", s) for s in ("add_grp__static", "add_grp__grupo4") if s in have][:1]
    out += [("sel_vs_base", "base", s) for s in sorted(have) if s.startswith("sel__") and "_sem_" not in s][:1]
    usable = have & set(available) if available is not None else have
    return [c for c in out if {c[1], c[2]} <= usable]


def arm_table(spark: SparkSession, arms: Sequence[Arm]) -> DataFrame:
    return spark.createDataFrame([(a.name, list(a.features), a.kind, a.reference, a.subject) for a in arms], ARM_SCHEMA)


def read_arms(df: DataFrame) -> list[Arm]:
    """Arms of a table of them (some dozens), by name."""
    return [Arm(r["name"], tuple(r["features"]), r["kind"], r["reference"], r["subject"]) for r in df.orderBy("name").collect()]


def keep_arms(spark: SparkSession, path: str, arms: Sequence[Arm]) -> list[str]:
    """Add arms to those kept at the path and return all names; one that is there already with other features is a
    ValueError, since units fitted under its name would no longer be what they say."""
    known = {a.name: a for a in read_arms(spark.read.parquet(path))} if exists(spark, path) else {}
    if clash := [a.name for a in arms if a.name in known and known[a.name].features != a.features]:
        raise ValueError(f"arms kept with other features: {clash}")
    if fresh := [a for a in arms if a.name not in known]:
        arm_table(spark, fresh).coalesce(1).write.mode("append").parquet(path)
    return sorted({*known, *(a.name for a in arms)})


def with_controls(df: DataFrame, static: Sequence[str], station: str, day: str, seed: int = 42) -> DataFrame:
    """df with the control columns: noise by row, and each static feature (``perm_<name>``) as another station has it.

    Stations stand in the order of a hash and take the values of the next one, the last those of the first, so none keeps
    its own and the features of a station stay together. A station's least known value counts; with fewer than two
    stations there are no permuted columns.
    """
    noisy = noise_columns(df, [station, day], seed, NOISE)
    if not static:
        return noisy
    values = df.filter(F.col(station).isNotNull()).groupBy(station).agg(*(F.min(f).alias(PERMUTED + f) for f in static))
    n = values.count()
    if n < 2:
        return noisy
    placed = numbered(values, F.xxhash64(station, F.lit(seed)), [station], "_place")
    donors = placed.select(F.pmod(F.col("_place") - 1, F.lit(n)).alias("_place"), *(PERMUTED + f for f in static))
    return noisy.join(placed.select(station, "_place").join(donors, "_place").drop("_place"), station, "left")


def month_blocks(test_months: Sequence[int], val_units: Sequence[tuple[int, int]]) -> Callable[[Column], Column]:
    return lambda day: month_block_label(day if isinstance(day, Column) else F.col(day), test_months, val_units)


def prepared(df: DataFrame, features: Sequence[str], cluster: str, station: str, day: str, label_of: Callable[[Column], Column], gap_days: int = 0, discovered: Sequence[str] = ()) -> DataFrame:
    """Complete rows with their split, without those within ``gap_days`` after a border of splits."""
    complete = complete_rows(df, features, cluster, station, discovered).withColumn("split", label_of(F.col(day)))
    return purge_boundaries(complete, day, label_of, gap_days) if gap_days else complete


def screened_arms(rows: DataFrame, arms: Sequence[Arm], by: Sequence[str], season: str, y: str, models: Sequence[str] = tuple(gram.MODELS), least: int = 20, split: str = "split") -> DataFrame:
    """by, season (and ALL), arm, model, n, features, coefficients, intercept, n_eval, rmse, bias, r2 on validation rows.

    Rows are read once, into matrices by group, split and season; every arm is a part of them.
    """
    features = sorted({f for a in arms for f in a.features})
    size = gram.gram_size(features)
    made = gram.gram_matrices(rows.filter(F.col(split).isin("train", "val")), [*by, split, season], features, y)
    every = gram.seasonal_and_pooled(made, season, [*by, split], size)
    paired = gram.side_by_side(every, [*by, season], split, {"train": "gram", "val": "_val"}).filter("gram IS NOT NULL")
    fits = gram.fitted(paired, [*by, season, "_val"], features, {a.name: a.features for a in arms}, models, least)
    return gram.errors_of(fits, "_val", features)


def arm_residuals(rows: DataFrame, models: DataFrame, by: Sequence[str], season: str, station: str, day: str, y: str, pooled: str = "ALL", split: str = "split") -> DataFrame:
    """by, arm, model, tag (0: these fits draw nothing), station, day, y, y_pred, e: the pooled models on the test rows.

    Each row meets every arm's and model's fit of its group, which is what paired effects compare; rows of groups that
    were not fitted, and rows without a feature that a model uses, are left out. Models are some hundreds a group.
    """
    used = [f.name for f in rows.schema if f.dataType.typeName() in ("double", "float", "integer", "long", "short", "decimal") and f.name not in by]
    held = F.create_map(*(x for c in used for x in (F.lit(c), F.col(c).cast("double"))))
    test = rows.filter(F.col(split) == "test").select(*by, F.col(station).alias("station"), F.col(day).alias("day"), F.col(y).cast("double").alias("y"), held.alias("_x"))
    fits = models.filter(F.col(season) == pooled).select(*by, "arm", "model", "features", "coefficients", "intercept")
    terms = F.zip_with("features", "coefficients", lambda f, b: b * F.try_element_at(F.col("_x"), f))
    pred = F.aggregate(terms, F.col("intercept"), lambda total, t: total + t)
    out = test.join(fits, list(by)).withColumn("y_pred", pred).filter("y_pred IS NOT NULL AND y IS NOT NULL")
    return out.select(*by, "arm", "model", F.lit(0).alias("tag"), "station", "day", "y", "y_pred", (F.col("y_pred") - F.col("y")).alias("e"))
