"""Linear models from Gram matrices: rows are read once, whatever is fitted to them.

A Gram row holds, for a group of rows, the upper triangle of the sums of products of (1, features, y). Sums add and
subtract: a year's matrix is that of its seasons, a training set without some stations is the whole less theirs. A fit
on some of the features uses a part of the matrix, and so does its error on other rows, so 40 models on 10
sets of features in 100 groups cost one aggregation of the rows and some small solves per group.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Features up to which each product is a sum of its own in one plan; more are summed in tasks as matrices.
NATIVE = 16


def _finite(columns: Sequence[str]) -> Column:
    ok = F.lit(True)
    for c in columns:
        ok = ok & F.coalesce(F.abs(F.col(c)) < float("inf"), F.lit(False))
    return ok


def _triangle(m: int) -> list[tuple[int, int]]:
    return [(i, j) for i in range(m) for j in range(i, m)]


def gram_matrices(df: DataFrame, by: Sequence[str], features: Sequence[str], y: str) -> DataFrame:
    """by, gram (array<double>: the upper triangle, row by row, of the sums of products of 1, features and y).

    Rows in which a feature or y is null or not finite do not count; groups without others have no row. ``by`` may be
    empty. The first number is the count of rows.
    """
    columns = [*features, y]
    rows = df.filter(_finite(columns))
    m = len(columns) + 1
    if len(features) <= NATIVE:
        part = lambda i: F.lit(1.0) if i == 0 else F.col(columns[i - 1]).cast("double")
        sums = [F.sum(part(i) * part(j)) for i, j in _triangle(m)]
        return rows.groupBy(*by).agg(F.array(*sums).alias("gram")).filter(F.col("gram")[0] > 0)
    keys = df.select(*by).schema
    kinds = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in keys)
    upper = np.triu_indices(m)

    def summed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:  # each batch is a matrix per group it has rows of
            for key, some in batch.groupby(list(by), dropna=False) if by else [((), batch)]:
                z = np.column_stack([np.ones(len(some)), some[columns].to_numpy(float)])
                key = dict(zip(by, key if isinstance(key, tuple) else (key,), strict=True))
                yield pd.DataFrame({**{k: [v] * len(upper[0]) for k, v in key.items()}, "_k": np.arange(len(upper[0])), "_v": (z.T @ z)[upper]})

    parts = rows.select(*by, *columns).mapInPandas(summed, f"{kinds}_k int, _v double")
    entries = parts.groupBy(*by, "_k").agg(F.sum("_v").alias("_v"))
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("_k", "_v"))), lambda e: e["_v"])
    return entries.groupBy(*by).agg(ordered.alias("gram")).filter(F.size("gram") > 0)


def summed_matrices(grams: DataFrame, by: Sequence[str], size: int) -> DataFrame:
    """by, gram: matrices of finer groups added up. ``size``: numbers of a matrix (``gram_size``)."""
    return grams.groupBy(*by).agg(F.array(*(F.sum(F.col("gram")[k]) for k in range(size))).alias("gram")).filter(F.col("gram")[0] > 0)


def gram_size(features: Sequence[str]) -> int:
    m = len(features) + 2
    return m * (m + 1) // 2


def without_own(grams: DataFrame, by: Sequence[str], fold: str, size: int, keep: Sequence[str] = ()) -> DataFrame:
    """by, fold, keep, gram: for each group and fold, the matrix of the group's other folds, by subtraction."""
    whole = F.array(*(F.sum(F.col("gram")[k]).over(Window.partitionBy(*by)) for k in range(size)))  # a row per fold
    return grams.withColumn("_whole", whole).select(*by, fold, *keep, F.zip_with("_whole", "gram", lambda a, b: a - b).alias("gram"))


def seasonal_and_pooled(grams: DataFrame, season: str, by: Sequence[str], size: int, pooled: str = "ALL") -> DataFrame:
    """Matrices by season, and those of all seasons together under ``pooled``."""
    every = summed_matrices(grams, by, size).withColumn(season, F.lit(pooled))
    return grams.select(*by, season, "gram").unionByName(every)


def full(triangle: np.ndarray) -> np.ndarray:
    """The symmetric matrix of an upper triangle."""
    m = int((np.sqrt(8 * len(triangle) + 1) - 1) / 2)
    out = np.zeros((m, m))
    out[np.triu_indices(m)] = triangle
    return out + np.triu(out, 1).T


class Moments:
    """Means, scales and correlations of some features and y from a Gram matrix."""

    def __init__(self, matrix: np.ndarray, columns: Sequence[int]):
        keep = [0, *(c + 1 for c in columns), len(matrix) - 1]
        s = matrix[np.ix_(keep, keep)]
        self.n = s[0, 0]
        self.mean = s[0, 1:-1] / self.n
        self.y_mean = s[0, -1] / self.n
        centre = np.append(self.mean, self.y_mean)
        c = s[1:, 1:] / self.n - np.outer(centre, centre)
        spread = np.sqrt(np.maximum(np.diag(c)[:-1], 0))
        # what does not vary takes no part: rounding leaves about 1e-16 of its square
        self.scale = np.where(spread > 1e-7 * np.maximum(1.0, np.abs(self.mean)), spread, np.inf)
        self.r = c[:-1, :-1] / np.outer(self.scale, self.scale)
        self.xy = c[:-1, -1] / self.scale
        self.yy = max(c[-1, -1], 0.0)


def _least_squares(m: Moments) -> np.ndarray:
    return np.linalg.lstsq(m.r, m.xy, rcond=1e-10)[0]


def _ridge(m: Moments, alpha: float = 1.0) -> np.ndarray:
    return np.linalg.solve(m.r + alpha / m.n * np.eye(len(m.xy)), m.xy) if len(m.xy) else m.xy


def _elastic_net(m: Moments, alpha: float = 1.0, ratio: float = 0.5, rounds: int = 1000, close: float = 1e-10) -> np.ndarray:
    """Coordinate descent on the correlations: squared error / 2 + alpha (ratio |b| + (1 - ratio) b^2 / 2)."""
    b = np.zeros(len(m.xy))
    for _ in range(rounds):
        moved = 0.0
        for k in range(len(b)):
            if m.r[k, k] <= 0:
                continue
            gradient = m.xy[k] - m.r[k] @ b + m.r[k, k] * b[k]
            new = np.sign(gradient) * max(abs(gradient) - alpha * ratio, 0.0) / (m.r[k, k] + alpha * (1 - ratio))
            moved, b[k] = max(moved, abs(new - b[k])), new
        if moved <= close * max(1.0, np.sqrt(m.yy)):
            break
    return b


def _bayesian_ridge(m: Moments, rounds: int = 300, close: float = 1e-3, prior: float = 1e-6) -> np.ndarray:
    """Evidence maximisation of the precisions of noise and weights, with flat gamma priors."""
    if m.yy <= 0 or not len(m.xy):
        return np.zeros(len(m.xy))
    values, vectors = np.linalg.eigh(m.r * m.n)
    values, turned = np.maximum(values, 0), vectors.T @ (m.xy * m.n)
    noise, weight = 1.0 / m.yy, 1.0
    b = np.zeros(len(m.xy))
    for _ in range(rounds):
        new = vectors @ (turned / (values + weight / noise))
        error = m.n * (m.yy - 2 * new @ m.xy + new @ m.r @ new)
        used = np.sum(noise * values / (weight + noise * values))
        weight = (used + 2 * prior) / (new @ new + 2 * prior)
        noise = (m.n - used + 2 * prior) / (max(error, 0.0) + 2 * prior)
        moved, b = np.abs(new - b).sum(), new
        if moved < close:
            break
    return vectors @ (turned / (values + weight / noise))


def _matching_pursuit(m: Moments, share: float = 0.1) -> np.ndarray:
    """Features one by one, each the one most correlated with what is left; a tenth of them, one at least."""
    taken: list[int] = []
    b = np.zeros(len(m.xy))
    for _ in range(max(1, int(share * len(b)))):
        left = np.abs(m.xy - m.r @ b)
        left[taken] = -1
        if not len(left) or left.max() <= 1e-12:
            break
        taken.append(int(left.argmax()))
        b = np.zeros(len(b))
        b[taken] = np.linalg.lstsq(m.r[np.ix_(taken, taken)], m.xy[taken], rcond=1e-10)[0]
    return b


#: Models on standardised features, by the names under which they are reported.
MODELS: dict[str, Callable[[Moments], np.ndarray]] = {
    "mean": lambda m: np.zeros(len(m.xy)),
    "least_squares": _least_squares,
    "ridge": _ridge,
    "lasso": lambda m: _elastic_net(m, ratio=1.0),
    "elastic_net": _elastic_net,
    "bayesian_ridge": _bayesian_ridge,
    "matching_pursuit": _matching_pursuit,
}


def fitted(
    grams: DataFrame, by: Sequence[str], features: Sequence[str], arms: dict[str, Sequence[str]], models: Sequence[str] = tuple(MODELS), least: int = 20
) -> DataFrame:
    """by, arm, model, n, features, coefficients, intercept: each model fitted on each arm's features in each group.

    Coefficients are of the features as they are; penalties are on standardised ones (1 as in the usual defaults). A
    feature that does not vary in a group has 0. Groups of fewer than ``least`` rows are not fitted.
    """
    at = {arm: [list(features).index(c) for c in some] for arm, some in arms.items()}
    known = {name: MODELS[name] for name in models}
    kinds = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in grams.select(*by).schema)

    def fit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for row in batch.to_dict("records"):
                matrix = full(np.asarray(row["gram"], float))
                for arm, columns in at.items():
                    m = Moments(matrix, columns)
                    for name, solve in known.items():
                        b = solve(m) / m.scale
                        out.append({**{k: row[k] for k in by}, "arm": arm, "model": name, "n": int(m.n), "features": list(arms[arm]), "coefficients": b, "intercept": m.y_mean - b @ m.mean})
            yield pd.DataFrame(out, columns=[*by, "arm", "model", "n", "features", "coefficients", "intercept"])

    enough = grams.filter(F.col("gram")[0] >= least)
    return enough.mapInPandas(fit, f"{kinds}arm string, model string, n long, features array<string>, coefficients array<double>, intercept double")


def side_by_side(grams: DataFrame, by: Sequence[str], part: str, names: dict[str, str]) -> DataFrame:
    """by, and the matrix of each part of the rows (training, validation, ...) under a name: ``names`` is part -> column."""
    return grams.groupBy(*by).agg(*(F.first(F.when(F.col(part) == p, F.col("gram")), ignorenulls=True).alias(c) for p, c in names.items()))


def errors_of(models: DataFrame, gram: str, features: Sequence[str]) -> DataFrame:
    """models without column ``gram``, with n_eval, rmse, bias and r2 on the rows whose matrix that is; models without one go.

    The sum of squared errors of a linear model is a quadratic form of the matrix, so no row is scored. ``fitted``
    carries the matrices along as one of the columns of ``by``.
    """
    m = len(features) + 2
    place = {c: k + 1 for k, c in enumerate(features)}
    at = lambda i, j: (F.least(i, j) * (2 * m - F.least(i, j) - 1) / 2 + F.greatest(i, j)).cast("int")
    places = F.create_map(*(x for c, k in place.items() for x in (F.lit(c), F.lit(k))))
    # the error is a combination v of (1, features, y): intercept, coefficients, -1
    terms = F.concat(
        F.array(F.struct(F.lit(0).alias("i"), F.col("intercept").alias("v"))),
        F.zip_with("features", "coefficients", lambda c, b: F.struct(places[c].alias("i"), b.alias("v"))),
        F.array(F.struct(F.lit(m - 1).alias("i"), F.lit(-1.0).alias("v"))),
    )
    kept = [c for c in models.columns if c != gram]
    met = models.filter(F.col(gram).isNotNull()).withColumn("_gram", F.col(gram)).withColumn("_v", terms)
    total = lambda f: F.aggregate("_v", F.lit(0.0), lambda acc, t: acc + f(t))
    n = F.col("_gram")[0]
    bias = total(lambda t: t["v"] * F.get(F.col("_gram"), t["i"])) / n
    sse = total(lambda t: F.aggregate("_v", F.lit(0.0), lambda acc, u: acc + t["v"] * u["v"] * F.get(F.col("_gram"), at(t["i"], u["i"]))))
    y_sum, y_square = F.col("_gram")[m - 1], F.col("_gram")[m * (m + 1) // 2 - 1]
    out = met.select(*kept, n.cast("long").alias("n_eval"), F.greatest(sse, F.lit(0.0)).alias("_sse"), bias.alias("bias"), (y_square - y_sum * y_sum / n).alias("_yy"))
    return out.select(
        *kept, "n_eval", F.sqrt(F.col("_sse") / F.col("n_eval")).alias("rmse"), "bias",
        F.when(F.col("_yy") > 0, 1 - F.col("_sse") / F.col("_yy")).alias("r2"),
    )


def correlation_matrix(df: DataFrame, columns: Sequence[str], within: Sequence[str] = ()) -> DataFrame:
    """a, b, corr of each pair of columns (a before b in their order), all pairs in one pass over the rows.

    With ``within``, group means are taken away, by the groups' own sums. Rows with an unknown value in any column
    do not count; corr is null where a column does not vary.
    """
    p, m = len(columns), len(columns) + 1  # the last column takes the place of y
    size = m * (m + 1) // 2
    g = gram_matrices(df, within, columns[:-1], columns[-1])
    at = lambda i, j: i * (2 * m - i - 1) // 2 + j
    pairs = [(i, j) for i in range(1, m) for j in range(i, m)]
    co = F.array(*(F.sum(F.col("gram")[at(i, j)] - F.col("gram")[i] * F.col("gram")[j] / F.col("gram")[0]) for i, j in pairs))
    raw = F.array(*(F.sum(F.col("gram")[at(i, i)]) for i in range(1, m)))
    assert size == at(m - 1, m - 1) + 1
    summed = g.agg(co.alias("_c"), raw.alias("_raw"))
    where = {pair: k for k, pair in enumerate(pairs)}
    c = lambda i, j: F.col("_c")[where[i, j]]
    varies = lambda i: c(i, i) > 1e-14 * F.col("_raw")[i - 1]
    rows = [
        F.struct(
            F.lit(columns[i - 1]).alias("a"), F.lit(columns[j - 1]).alias("b"),
            F.when(varies(i) & varies(j), c(i, j) / F.sqrt(c(i, i) * c(j, j))).alias("corr"),
        )
        for i in range(1, p + 1) for j in range(i + 1, p + 1)
    ]
    return summed.select(F.explode(F.array(*rows)).alias("_r")).select("_r.*")


def best_hour_correlation(df: DataFrame, hours: dict[str, dict[int, str]], y: str) -> DataFrame:
    """variable, hour, corr: of each variable's columns by hour the one most correlated (in absolute value) with y.

    ``hours``: variable -> hour -> column. All correlations come from one aggregation; rows without the column's
    value or y do not count for that column. Ties go to the earlier hour; a variable without a correlation has nulls.
    """
    pairs = [(v, h, c) for v, by_hour in hours.items() for h, c in sorted(by_hour.items())]
    summed = df.agg(F.array(*(F.struct(F.lit(v).alias("variable"), F.lit(h).alias("hour"), F.corr(c, y).alias("corr")) for v, h, c in pairs)).alias("_all"))
    rows = summed.select(F.explode("_all").alias("_r")).select("_r.*")
    known = F.col("corr").isNotNull() & ~F.isnan("corr")
    best = F.min(F.when(known, F.struct((-F.abs("corr")).alias("_k"), "hour", "corr")))
    return rows.groupBy("variable").agg(best.alias("_b")).select("variable", "_b.hour", "_b.corr")
