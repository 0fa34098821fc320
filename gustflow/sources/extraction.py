"""Extraction of values at many stations that can stop anywhere and goes on with what is missing.

Stations are dealt to parts by a hash. A part counts as finished once it stands in the manifest, which names the folder of
its rows and a digest of the station ids that it holds; a part whose ids have changed since is extracted anew. Rows are
written before their manifest rows, and nothing is ever overwritten, so readers and second writers see whole parts only.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .scan import exists

MANIFEST = "variant string, part int, n bigint, digest bigint, folder string"


def part_of(key: str, parts: int) -> Column:
    """The part that a station belongs to, the same in every run with as many parts."""
    return F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(parts)).cast("int")


def id_sets(stations: DataFrame, key: str, parts: int) -> DataFrame:
    """part, n, digest: the number of distinct ids of each part and a digest that does not depend on their order."""
    ids = stations.filter(F.col(key).isNotNull()).select(F.col(key).cast("string").alias("_id")).distinct()
    return (
        ids.groupBy(F.pmod(F.xxhash64("_id"), F.lit(parts)).cast("int").alias("part"))
        .agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64(F.lit(parts), F.col("_id"))).alias("digest"))
    )


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """The finished parts of all variants: variant, part, n, digest, folder."""
    at = f"{path}/_manifest"
    return spark.read.schema(MANIFEST).parquet(at) if exists(spark, at) else spark.createDataFrame([], MANIFEST)


def finished(spark: SparkSession, path: str, stations: DataFrame, key: str, parts: int, variant: str) -> DataFrame:
    """part, n, digest of each part that the stations make, and the folder that holds just its ids (null: missing)."""
    known = manifest(spark, path).filter(F.col("variant") == variant).groupBy("part", "n", "digest").agg(F.max("folder").alias("folder"))
    return id_sets(stations, key, parts).join(known, ["part", "n", "digest"], "left")


def extracted(
    spark: SparkSession,
    path: str,
    stations: DataFrame,
    key: str,
    extract: Callable[[DataFrame], DataFrame],
    parts: int = 8,
    at_once: int = 1,
    variant: str = "nearest",
) -> DataFrame:
    """Rows of ``extract`` at all stations, from the finished parts below ``path`` and from those that it has to make.

    ``extract`` gets the stations of ``at_once`` parts and returns rows with their ``key``, at least one for each station
    (values outside a grid are null, as ``nearest_values`` gives them): ValueError, and no manifest row, if the ids
    are not those of the part. A ``variant`` (a method of interpolation) has parts of its own. Stations without an
    id are left out; no stations give the columns of ``extract`` and no rows.
    """
    if parts < 1 or at_once < 1:
        raise ValueError("parts and at_once are positive")
    missing = finished(spark, path, stations, key, parts, variant).filter("folder IS NULL")
    waiting = sorted(r["part"] for r in missing.select("part").collect())  # ``parts`` rows at most
    for k in range(0, len(waiting), at_once):
        _make(spark, path, stations, key, extract, parts, waiting[k : k + at_once], variant)
    held = finished(spark, path, stations, key, parts, variant).select("part", "folder").collect()  # likewise
    if not held:
        return extract(stations.filter("false"))
    paths = [f"{r['folder']}/_part={r['part']}" for r in held]
    return spark.read.parquet(*paths)


def _make(spark: SparkSession, path: str, stations: DataFrame, key: str, extract: Callable[[DataFrame], DataFrame], parts: int, some: Sequence[int], variant: str) -> None:
    """Extract some parts into a new folder, check the ids that came, and enter the parts in the manifest."""
    folder = f"{path}/variant={variant}/run={uuid.uuid4().hex}"
    mine = stations.filter(F.col(key).isNotNull() & part_of(key, parts).isin(list(some)))
    extract(mine).withColumn("_part", part_of(key, parts)).write.partitionBy("_part").parquet(folder)
    wanted = id_sets(mine, key, parts)
    came = id_sets(spark.read.parquet(folder), key, parts)
    agreed = wanted.join(came, ["part", "n", "digest"])
    rows = agreed.select(F.lit(variant).alias("variant"), "part", "n", "digest", F.lit(folder).alias("folder"))
    entered = rows.collect()  # ``at_once`` rows
    if lacking := sorted(set(some) - {r["part"] for r in entered}):
        raise ValueError(f"parts {lacking} came without just their stations' ids; they are not entered, see {folder}")
    spark.createDataFrame(entered, MANIFEST).coalesce(1).write.mode("append").parquet(f"{path}/_manifest")


def staged(spark: SparkSession, stages: Sequence[tuple[str, Callable[[DataFrame | None], DataFrame]]], use_cache: bool = True) -> DataFrame:
    """The last stage's table; stages before the last complete table are not computed again.

    Each stage is (path, function of the table before it, None for the first). Work goes on after the last path that is
    complete, so a failure past an intermediate table costs only what follows it. With ``use_cache`` false the last
    table is made anew from the one before it, in the place of the old one.
    """
    if not stages:
        raise ValueError("no stages")
    done = [k for k, (path, _) in enumerate(stages) if exists(spark, f"{path}/_SUCCESS") and (use_cache or k < len(stages) - 1)]
    start = done[-1] + 1 if done else 0
    table = spark.read.parquet(stages[start - 1][0]) if start else None
    for path, function in stages[start:]:
        function(table).write.mode("overwrite").parquet(path)
        table = spark.read.parquet(path)
    return table
