"""Contributions of features to the predictions of trees: exact Shapley values of pyspark.ml's tree models.

A model's trees become tables of nodes. A leaf's share in a prediction is a product over the features on its path, each
either met by the row or, where the feature is unknown, followed by as many training rows as went that way. A
feature's Shapley value is the leaf's value times its own factor times a sum over all subsets of the others, which
are the coefficients of one polynomial; so a leaf costs a square of its path's length, not a power of two.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass
class Leaf:
    """value; features of the path; for each the bounds (low, high] that a row must lie in, and the part of rows that does."""

    value: float
    cover: float
    features: list[int]
    low: list[float]
    high: list[float]
    part: list[float]


@dataclass
class TreeTable:
    """Leaves of each tree with its weight in the model, and the model's mean prediction over its training rows."""

    trees: list[tuple[float, list[Leaf]]]
    base: float
    size: int


def tree_table(model, size: int) -> TreeTable:
    """The trees of a fitted regression tree, forest or boosted trees of pyspark.ml over ``size`` continuous features."""
    trees = getattr(model, "trees", None)
    weights = [1.0] if trees is None else list(getattr(model, "treeWeights", [])) or [1.0] * len(trees)
    if trees is not None and type(model).__name__.startswith("RandomForest"):
        weights = [1.0 / len(trees)] * len(trees)  # a forest is its trees' mean
    found = []
    for weight, tree in zip(weights, [model] if trees is None else trees, strict=True):
        leaves: list[Leaf] = []
        stack = [(tree._java_obj.rootNode(), {})]
        while stack:
            node, path = stack.pop()
            rows = node.impurityStats().count()
            if node.getClass().getSimpleName() != "InternalNode":
                at = sorted(path)
                leaves.append(Leaf(node.prediction(), rows, at, [path[f][0] for f in at], [path[f][1] for f in at], [path[f][2] for f in at]))
                continue
            split = node.split()
            if split.getClass().getSimpleName() != "ContinuousSplit":
                raise ValueError("splits of categories are not known here")
            f, cut = split.featureIndex(), split.threshold()
            low, high, part = path.get(f, (-math.inf, math.inf, 1.0))
            for child, bounds in ((node.leftChild(), (low, min(high, cut))), (node.rightChild(), (max(low, cut), high))):
                stack.append((child, path | {f: (*bounds, part * child.impurityStats().count() / rows)}))
        found.append((weight, leaves))
    base = sum(w * sum(x.value * x.cover for x in leaves) / sum(x.cover for x in leaves) for w, leaves in found)
    return TreeTable(found, base, size)


def shapley(table: TreeTable, x: np.ndarray) -> np.ndarray:
    """(rows, features): contributions of each row; they add up to its prediction less the base."""
    out = np.zeros(x.shape)
    for weight, leaves in table.trees:
        for leaf in leaves:
            d = len(leaf.features)
            met = [((x[:, f] > lo) & (x[:, f] <= hi)).astype(float) for f, lo, hi in zip(leaf.features, leaf.low, leaf.high, strict=True)]
            share = [math.factorial(k) * math.factorial(d - 1 - k) / math.factorial(d) for k in range(d)]
            for i, f in enumerate(leaf.features):
                # coefficient k: products with k of the other features met and the rest followed by their parts
                poly = np.zeros((d, len(x)))
                poly[0] = 1.0
                for n, j in enumerate(j for j in range(d) if j != i):
                    poly[1 : n + 2] = poly[1 : n + 2] * leaf.part[j] + poly[: n + 1] * met[j]
                    poly[0] *= leaf.part[j]
                out[:, f] += weight * leaf.value * (met[i] - leaf.part[i]) * np.tensordot(share, poly, axes=1)
    return out


def tree_contributions(df: DataFrame, model, features: Sequence[str], out: str = "contributions") -> DataFrame:
    """df with ``out`` (array<double>, one for each feature) and ``base``: exact contributions under a fitted tree model.

    ``features`` in the model's order. A row with an unknown feature has null contributions. The model, whose size its
    parameters bound, goes to the tasks; rows are not moved.
    """
    sent = df.sparkSession.sparkContext.broadcast(tree_table(model, len(features)))

    @F.pandas_udf("array<double>")
    def contributed(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        for columns in batches:
            x = np.column_stack([c.to_numpy(float) for c in columns])
            found = shapley(sent.value, x)
            known = ~np.isnan(x).any(axis=1)
            yield pd.Series([row if ok else None for row, ok in zip(found, known, strict=True)])

    return df.withColumns({out: contributed(*(F.col(c).cast("double") for c in features)), "base": F.lit(sent.value.base)})


def checked_additive(df: DataFrame, prediction: str, out: str = "contributions", close: float = 1e-3) -> DataFrame:
    """df; a row whose base and contributions do not add up to its prediction is an error, found where it is met."""
    total = F.aggregate(out, F.col("base"), lambda acc, v: acc + v)
    off = F.abs(total - F.col(prediction)) > close * F.greatest(F.lit(1.0), F.abs(prediction))
    return df.withColumn(out, F.when(F.coalesce(off, F.lit(False)), F.raise_error(F.lit("contributions do not add up to the prediction")).cast("array<double>")).otherwise(F.col(out)))


def group_shares(df: DataFrame, features: Sequence[str], group_of: dict[str, str], by: Sequence[str] = (), out: str = "contributions") -> DataFrame:
    """by, group, share (percent): a group's part of the mean absolute contributions, its features' summed for each row first.

    Rows without contributions do not count. Shares add up to 100 in each of ``by``.
    """
    groups = sorted(set(group_of.values()))
    at = {g: [k for k, c in enumerate(features) if group_of[c] == g] for g in groups}
    sizes = [F.avg(F.abs(sum((F.get(F.col(out), F.lit(k)) for k in at[g]), F.lit(0.0)))) for g in groups]
    means = df.filter(F.col(out).isNotNull()).groupBy(*by).agg(F.array(*sizes).alias("_m"))
    total = F.aggregate("_m", F.lit(0.0), lambda acc, v: acc + v)
    rows = F.explode(F.zip_with(F.array(*map(F.lit, groups)), F.col("_m"), lambda g, v: F.struct(g.alias("group"), (100 * v / F.nullif(total, F.lit(0.0))).alias("share"))))
    return means.select(*by, rows.alias("_r")).select(*by, "_r.group", "_r.share")


def share_ranges(shares: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """by, group, least and greatest: of a group's shares over seasons (or models)."""
    return shares.groupBy(*by, "group").agg(F.min("share").alias("least"), F.max("share").alias("greatest"))
