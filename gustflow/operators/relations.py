"""Validated joins, filling joins, set comparisons, label merging."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def repeated_keys(df: DataFrame, on: Sequence[str]) -> DataFrame:
    return df.groupBy(*on).agg(F.count("*").alias("n")).filter("n > 1")


def validated_join(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "inner", validate: str = "one_to_one") -> DataFrame:
    """left joined with right; a key that repeats on a side that must have unique ones is an error, found where it is met.

    The check counts a key's rows on the partitioning that the join needs anyway, so neither side is computed twice.
    """
    unique = {"one_to_one": ("left", "right"), "many_to_one": ("right",), "one_to_many": ("left",)}[validate]

    def checked(df: DataFrame, side: str) -> DataFrame:
        if side not in unique:
            return df
        said = F.raise_error(F.lit(f"the {side} side repeats keys {list(on)}; {validate} was asked for")).cast("boolean")
        counted = df.withColumn("_times", F.count(F.lit(1)).over(Window.partitionBy(*on)))
        return counted.filter(F.when(F.col("_times") == 1, F.lit(True)).otherwise(said)).drop("_times")

    return checked(left, "left").join(checked(right, "right"), list(on), how)


def combine_first(left: DataFrame, right: DataFrame, on: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """All keys of both; left's values, filled from right's where null or missing."""
    r = right.select(*on, *(F.col(c).alias(f"_{c}") for c in columns))
    joined = left.select(*on, *columns).join(r, list(on), "full_outer")
    return joined.select(*on, *(F.coalesce(c, f"_{c}").alias(c) for c in columns))


def override_on_common(first: DataFrame, second: DataFrame, on: Sequence[str], common: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """combine_first over the values of ``common`` that both tables have."""
    both = first.select(*common).intersect(second.select(*common))
    keep = lambda df: df.join(F.broadcast(both) if both.limit(100_001).count() <= 100_000 else both, list(common), "left_semi")
    return combine_first(keep(first), keep(second), on, columns)


def fetched_rows(rows: DataFrame, keys: DataFrame, on: Sequence[str], missing: str = "error") -> DataFrame:
    """The rows of the keys. A key without a row fails, or with ``missing="null"`` has nulls; one with several fails.

    The checks are part of the plan: they run with it, and rows are read once.
    """
    if missing not in ("error", "null"):
        raise ValueError("missing is error or null")
    on = list(on)
    found = keys.select(*on).distinct().join(rows.withColumn("_there", F.lit(True)), on, "left")
    many = F.count("*").over(Window.partitionBy(*on)) > 1
    wrong = F.when(many, F.raise_error("a key has more than one row").cast("boolean"))
    if missing == "error":
        wrong = wrong.when(F.col("_there").isNull(), F.raise_error("a key has no row").cast("boolean"))
    checked = found.withColumn("_wrong", F.coalesce(wrong, F.lit(False)))
    return checked.filter(~F.col("_wrong")).select(*(c for c in rows.columns))


def sequences_at(rows: DataFrame, keys: DataFrame, station: str, ts: str, value: str, hours: int) -> DataFrame:
    """station, ts, window: the values of the ``hours`` hours up to each key's, nulls where a row is missing."""
    spread = keys.select(station, F.col(ts).alias("_end"), F.explode(F.sequence(F.lit(0), F.lit(hours - 1))).alias("_k"))
    at = spread.withColumn(ts, F.expr(f"_end - make_interval(0, 0, 0, 0, {hours - 1} - _k, 0, 0)"))
    met = at.join(rows.select(station, ts, F.col(value).alias("_v")), [station, ts], "left")
    return met.groupBy(station, F.col("_end").alias(ts)).agg(
        F.transform(F.sort_array(F.collect_list(F.struct("_k", "_v"))), lambda x: x["_v"]).alias("window")
    )


def compared_rows(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: only_a and only_b (how many rows, as often as they come, the other lacks) and same (neither has any)."""
    both = a.withColumn("_n", F.lit(1)).unionByName(b.select(*a.columns).withColumn("_n", F.lit(-1)))
    found = both.groupBy(*a.columns).agg(F.sum("_n").alias("_n"))
    sides = found.agg(*(F.coalesce(F.sum(F.greatest(s * F.col("_n"), F.lit(0))), F.lit(0)).alias(c) for s, c in ((1, "only_a"), (-1, "only_b"))))
    return sides.withColumn("same", (F.col("only_a") == 0) & (F.col("only_b") == 0))


def same_rows(a: DataFrame, b: DataFrame) -> bool:
    """Whether both have the same rows, as often, in any order."""
    return compared_rows(a, b).first()["same"]


def greatest_difference(a: DataFrame, b: DataFrame, on: Sequence[str], value: str) -> DataFrame:
    """One row: pairs, and the greatest absolute difference of the value."""
    joined = a.select(*on, F.col(value).alias("_a")).join(b.select(*on, F.col(value).alias("_b")), list(on))
    return joined.agg(F.count("*").alias("pairs"), F.max(F.abs(F.col("_a") - F.col("_b"))).alias("greatest"))


def within_days(rows: DataFrame, centres: DataFrame, station: str, day: str, days: int) -> DataFrame:
    """Rows at most ``days`` days from a centre of the same station, with that centre's day.

    Each centre is spread over the days around it, so the join is an equality on station and day.
    """
    around = centres.select(station, F.col(day).alias("centre"), F.explode(F.sequence(F.lit(-days), F.lit(days))).alias("_k"))
    spread = around.withColumn(day, F.date_add("centre", F.col("_k"))).drop("_k")
    return rows.join(spread, [station, day])


def parse_merges(spec: str) -> list[list[int]]:
    """'1-2-3,5-6' as [[1, 2, 3], [5, 6]]; ValueError if a cluster comes twice."""
    groups = [[int(x) for x in part.split("-")] for part in spec.split(",") if part.strip()]
    members = [m for g in groups for m in g]
    if len(members) != len(set(members)):
        raise ValueError(f"a cluster comes twice in {spec!r}")
    return groups


def merged_label(cluster: Column, groups: Sequence[Sequence[int]]) -> Column:
    """The label of a cluster's group ('1-2-3'), or the cluster itself as a string."""
    label = cluster.cast("string")
    for g in groups:
        label = F.when(cluster.isin(*g), F.lit("-".join(map(str, g)))).otherwise(label)
    return label


def with_donors(df: DataFrame, donors: DataFrame, station: str, columns: Sequence[str]) -> DataFrame:
    """df with ``perm_<column>``: the column of the station that is the row's donor (station, donor)."""
    static = df.groupBy(station).agg(*(F.first(c, ignorenulls=True).alias(f"perm_{c}") for c in columns))
    return df.join(donors.join(static.withColumnRenamed(station, "donor"), "donor").drop("donor"), station, "left")


def with_neighbour_training(df: DataFrame, neighbours: DataFrame, cluster: str, split: str) -> DataFrame:
    """df and, for each cluster, its neighbours' training rows under the cluster's own label (for_cluster)."""
    own = df.withColumn("for_cluster", F.col(cluster))
    train = df.filter(F.col(split) == "train")
    lent = neighbours.select(F.col("cluster").alias("for_cluster"), F.col("other").alias(cluster)).join(train, cluster)
    return own.unionByName(lent.select(*own.columns))


def latest(df: DataFrame, by: Sequence[str], value: str, at: str) -> DataFrame:
    """by, value of the row that is latest."""
    return df.groupBy(*by).agg(F.max_by(value, at).alias(value))


def first_present(df: DataFrame, names: Sequence[str], out: str) -> DataFrame:
    """df with ``out``: the first of the named columns that df has; KeyError if it has none."""
    for n in names:
        if n in df.columns:
            return df.withColumn(out, F.col(n))
    raise KeyError(f"none of {list(names)} is there")


def noise_columns(df: DataFrame, order: Sequence[str], seed: int, out: str = "noise") -> DataFrame:
    """df with a standard normal column that depends on the row's keys and the seed alone.

    Two uniform numbers from hashes of the keys, by the Box-Muller transform.
    """
    u = lambda k: (F.pmod(F.xxhash64(*order, F.lit(seed), F.lit(k)), F.lit(1_000_003)) + 1) / 1_000_004.0
    return df.withColumn(out, F.sqrt(-2 * F.log(u(1))) * F.cos(2 * F.pi() * u(2)))


#: Buckets that numbered rows are counted in: as many as the one row of offsets can hold.
BUCKETS = 1 << 14


def numbered(df: DataFrame, order: Column, ties: Sequence[str], out: str) -> DataFrame:
    """df with the place, from 0, of each row in the order of a hash.

    Rows are numbered within the hash's leading bits; what lies before each bucket comes from its counts, a
    table of ``BUCKETS`` rows at most, so that no sort goes over all rows.
    """
    low = F.shiftrightunsigned(order, 64 - BUCKETS.bit_length() + 1)
    # the hash itself, which no compression shortens, is computed again where the rows are
    rows = df.withColumn("_k", low).repartition("_k").withColumn("_h", order)
    before = F.sum("_n").over(Window.orderBy("_k").rowsBetween(Window.unboundedPreceding, -1))
    counts = df.groupBy(low.alias("_k")).agg(F.count("*").alias("_n"))
    offsets = counts.select("_k", F.coalesce(before, F.lit(0)).alias("_before"))
    place = F.row_number().over(Window.partitionBy("_k").orderBy("_h", *ties)) - 1
    return rows.withColumn("_at", place).join(F.broadcast(offsets), "_k").withColumn(out, F.col("_before") + F.col("_at")).drop("_h", "_k", "_at", "_before")


def with_partner(df: DataFrame, keys: Sequence[str], columns: Sequence[str], seed: int, out: str = "partner") -> DataFrame:
    """df with a struct of the columns of another row: one permutation of the whole table, by hashes of the keys.

    Rows are placed in two hash orders and meet by place, so every row is the partner of exactly one.
    """
    first = numbered(df, F.xxhash64(*keys, F.lit(seed)), keys, "_place")
    second = numbered(df.select(*dict.fromkeys([*keys, *columns])), F.xxhash64(*keys, F.lit(seed), F.lit("partner")), keys, "_place")
    return first.join(second.select("_place", F.struct(*columns).alias(out)), "_place").drop("_place")


def permuted(df: DataFrame, keys: Sequence[str], columns: Sequence[str], seed: int) -> DataFrame:
    """df with the columns of another row in each row: one permutation of the table for all of them."""
    return with_partner(df, keys, columns, seed, "_o").withColumns({c: F.col(f"_o.{c}") for c in columns}).drop("_o")


def overlap(first: DataFrame, second: DataFrame, key: str) -> DataFrame:
    """key, in_first, in_second of the keys that two selections hold."""
    side = lambda df, name: df.select(key).distinct().withColumn(name, F.lit(True))
    both = side(first, "in_first").join(side(second, "in_second"), key, "full_outer")
    return both.select(key, *(F.coalesce(c, F.lit(False)).alias(c) for c in ("in_first", "in_second")))


def snapped(df: DataFrame, axis: str, reference: DataFrame, tolerance: float = 1e-6) -> DataFrame:
    """df with the axis set to the reference axis' value at most ``tolerance`` away (the nearest one).

    Whoever reads the axis of a row that has none gets an error when the plan runs. Reference values are posted in their own cell of that
    width and its neighbours, so the join is an equality. Nulls have none.
    """
    at = lambda c: F.floor(F.col(c) / tolerance)
    posted = reference.select(F.col(axis).alias("_r")).distinct().withColumn("_c", F.explode(F.sequence(at("_r") - 1, at("_r") + 1)))
    values = df.select(F.col(axis).alias("_v")).distinct().withColumn("_c", at("_v"))
    far = F.abs(F.col("_v") - F.col("_r"))
    near = values.join(posted, "_c").filter(far <= tolerance).groupBy("_v").agg(F.min_by("_r", F.struct(far, "_r")).alias("_r"))
    message = F.concat(F.lit(f"{axis} is not on the reference grid: "), F.coalesce(F.col(axis).cast("string"), F.lit("null")))
    joined = df.join(near, df[axis] == near["_v"], "left")
    return joined.withColumn(axis, F.coalesce("_r", F.raise_error(message).cast("double"))).drop("_v", "_r")


def masked(df: DataFrame, mask: DataFrame, on: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """df with the columns null where the mask (on, inside) is not true."""
    held = mask.filter("inside").select(*on).distinct().withColumn("_in", F.lit(True))
    return df.join(held, list(on), "left").withColumns({c: F.when(F.col("_in"), F.col(c)) for c in columns}).drop("_in")
