"""Exact quantiles of large groups: rows are counted between cuts, and only values near a quantile are kept apart.

``percentile`` holds all distinct values of a group in one task. Here approximate quantiles on both sides of each wanted
one, of bounded size, are cuts; one aggregation counts the rows between cuts and, where a cut's pair encloses a
wanted rank, each value. Counts are exact, so ranks and results are, whatever the error of the cuts.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scan import materialise

#: Accuracy of the cuts (the greatest error of their rank is the group's rows divided by it), and that of a single group.
ACCURACY, ACCURACY_OF_ALL = 5_000, 20_000
#: Groups whose cuts or quantiles are broadcast, at most.
GROUPS = 100_000


def place(cuts: str, n: int, value: Column, inclusive: bool = False) -> Column:
    """How many of the ``n`` sorted cuts (an array column) are below the value, or at most it (``inclusive``), by bisection."""
    passed = lambda c: (c <= value) if inclusive else (c < value)
    if n <= 16:
        return sum((F.when(passed(F.get(cuts, F.lit(k))), 1).otherwise(0) for k in range(n)), F.lit(0))
    steps = F.array(*(F.lit(1 << k) for k in reversed(range(n.bit_length()))))
    return F.aggregate(steps, F.lit(0), lambda at, s: F.when((at + s <= n) & passed(F.get(cuts, at + s - 1)), at + s).otherwise(at))


def _brackets(qs: Sequence[float], far: float) -> list[float]:
    """Shares (low, high, low, high, ...) of disjoint brackets around the wanted ones."""
    out: list[list[float]] = []
    for q in sorted(set(qs)):
        low, high = max(q - far, 0.0), min(q + far, 1.0)
        if out and low <= out[-1][1]:
            out[-1][1] = high
        else:
            out.append([low, high])
    return [x for b in out for x in b]


def _ranks(qs: Sequence[float], n: Column) -> Column:
    at = [F.lit(float(q)) * (n - 1) for q in qs]
    return F.array_distinct(F.array(*(f(x).cast("long") for x in at for f in (F.floor, F.ceil))))


def quantiles(df: DataFrame, by: Sequence[str], columns: Sequence[str], qs: Sequence[float]) -> DataFrame:
    """by and, under each column's name, the array of its exact ``qs``-quantiles (linear between ranks, as ``percentile``).

    Nulls do not count; a column without values in a group has null, a table without rows and ``by`` one row of nulls.
    Two passes over df; no task holds more than cuts and the values between the two cuts of one bracket. Should
    the cuts of a group have missed a rank, everything is computed by ``percentile``.
    """
    accuracy = ACCURACY if by else ACCURACY_OF_ALL
    keys = [f"_k{i}" for i in range(len(by))]
    values = [F.struct(F.lit(i).alias("_c"), F.col(c).cast("double").alias("_v")) for i, c in enumerate(columns)]
    each = F.explode(F.array(*values)) if len(values) > 1 else values[0]
    named = df.select(*(F.col(b).alias(k) for b, k in zip(by, keys, strict=True)), each.alias("_x"))
    rows = named.select(*keys, "_x._c", "_x._v")
    shares = _brackets(qs, 2 / accuracy)
    found = rows.groupBy(*keys, "_c").agg(F.array_sort(F.percentile_approx("_v", shares, accuracy)).alias("_cuts"))
    cuts = materialise(found.withColumn("_g", F.monotonically_increasing_id()))
    few = cuts.count() <= GROUPS

    of_group = cuts.select(*(F.col(k).alias(f"{k}_") for k in keys), F.col("_c").alias("_c_"), "_g", "_cuts").filter("_cuts IS NOT NULL")
    same = rows["_c"] == of_group["_c_"]
    for k in keys:
        same = same & rows[k].eqNullSafe(of_group[f"{k}_"])
    met = rows.filter("_v IS NOT NULL").join(F.broadcast(of_group) if few else of_group, same)
    met = met.withColumn("_i", place("_cuts", len(shares), F.col("_v"))).select(
        "_g", "_i", "_v", ((F.col("_i") % 2 == 1) | F.coalesce(F.get("_cuts", F.col("_i")) == F.col("_v"), F.lit(False))).alias("_kept")
    )
    bucket = F.when(F.col("_kept"), F.floor(F.col("_i") / 2).cast("int") * 2 + 1).otherwise(F.col("_i")).alias("_b")
    counted = met.groupBy("_g", bucket, F.when(F.col("_kept"), F.col("_v")).alias("_own")).agg(
        F.count("*").alias("_n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi")
    )
    counted = materialise(counted.drop("_own"))

    # a row for each bucket of a group; windows over those of one group
    of_bucket = counted.groupBy("_g", "_b").agg(F.sum("_n").alias("_m"))
    begins = F.sum("_m").over(Window.partitionBy("_g").orderBy("_b")) - F.col("_m")
    total = F.sum("_m").over(Window.partitionBy("_g"))
    placed = of_bucket.select("_g", "_b", "_m", begins.alias("_begin"), total.alias("_all"))
    inside = F.filter(_ranks(qs, F.col("_all")), lambda r: (r >= F.col("_begin")) & (r < F.col("_begin") + F.col("_m")))
    wanted = placed.select("_g", "_b", "_begin", "_all", F.explode(inside).alias("_r"))
    before = F.sum("_n").over(Window.partitionBy("_g", "_b").orderBy("_lo")) - F.col("_n")
    at = F.col("_r") - F.col("_begin") - F.col("_before")
    hit = wanted.join(counted.withColumn("_before", before), ["_g", "_b"]).filter((at >= 0) & (at < F.col("_n")))
    value = F.when((F.col("_lo") == F.col("_hi")) | (at == 0), F.col("_lo")).when(at == F.col("_n") - 1, F.col("_hi"))
    listed = hit.groupBy("_g").agg(F.max("_all").alias("_all"), F.map_from_entries(F.collect_list(F.struct("_r", value.alias("_v")))).alias("_of"))

    def quantile(q: float) -> Column:
        x = F.lit(float(q)) * (F.col("_all") - 1)
        low, high = (F.try_element_at("_of", f(x).cast("long")) for f in (F.floor, F.ceil))
        return F.when(low == high, low).otherwise((F.ceil(x) - x) * low + (x - F.floor(x)) * high)

    each = listed.select("_g", F.array(*map(quantile, qs)).alias("_q"))
    joined = cuts.join(each, "_g", "left")
    columns_of = [F.max(F.when(F.col("_c") == i, F.col("_q"))).alias(c) for i, c in enumerate(columns)]
    missed = F.bool_or(F.col("_cuts").isNotNull() & (F.col("_q").isNull() | F.exists("_q", lambda v: v.isNull())))
    out = materialise(joined.groupBy(*keys).agg(*columns_of, missed.alias("_missed")))
    if not out.filter("_missed").isEmpty():
        return df.groupBy(*by).agg(*(F.percentile(c, F.array(*(F.lit(float(q)) for q in qs))).alias(c) for c in columns))
    out = out.select(*(F.col(k).alias(b) for b, k in zip(by, keys, strict=True)), *columns)
    return F.broadcast(out) if few else out


def quantile(df: DataFrame, by: Sequence[str], column: str, q: float, out: str) -> DataFrame:
    """by and ``out``, the column's exact q-quantile."""
    return quantiles(df, by, [column], [q]).select(*by, F.get(column, F.lit(0)).alias(out))


def beside(groups: DataFrame, found: DataFrame, by: Sequence[str]) -> DataFrame:
    """groups, a row for each, with what was found for each; keys that are null meet too."""
    renamed = found.withColumnsRenamed({b: f"_{b}_" for b in by})
    same = reduce(lambda a, b: a & b, (F.col(b).eqNullSafe(F.col(f"_{b}_")) for b in by), F.lit(True))
    return groups.join(renamed, same, "left").drop(*(f"_{b}_" for b in by))
