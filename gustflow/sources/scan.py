"""Scans: tables with missing values normalised, discovery of yearly files, caches, fingerprints."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType, StructType

from ..functions.columns import present

#: Names that time and auxiliary columns of grid files come under.
TIME_NAMES = ("time", "valid_time")
AUXILIARY = ("number", "expver", "step", "surface")


def materialise(df: DataFrame) -> DataFrame:
    """Compute df once and cut its lineage in the shared checkpoint folder.

    The folder is the cluster's ``spark.checkpoint.dir``. Where that is unset, a single machine
    (tests) takes a temporary folder, a cluster a folder in the warehouse, which its nodes share.
    """
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        folder = context.getConf().get("spark.checkpoint.dir")
        if not folder and context.master.startswith("local"):
            folder = tempfile.mkdtemp(prefix="gustflow-checkpoint-")
        context.setCheckpointDir(folder or df.sparkSession.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints")
    return df.checkpoint(eager=True)


def normalised(df: DataFrame) -> DataFrame:
    """df with NaN and infinities of its floating columns as null, as every operator here expects."""
    floating = [f.name for f in df.schema if isinstance(f.dataType, (DoubleType, FloatType))]
    return df.withColumns({c: present(F.col(c)) for c in floating}) if floating else df


def scan(spark: SparkSession, path: str, columns: Sequence[str] | None = None, where: str | None = None) -> DataFrame:
    """A parquet table; columns and the condition reach the files."""
    df = spark.read.parquet(path)
    if where:
        df = df.filter(where)
    return normalised(df.select(*columns) if columns else df)


def scan_csv(spark: SparkSession, path: str, schema: StructType | str, renames: dict[str, str] | None = None, date_format: str = "yyyy-MM-dd") -> DataFrame:
    """A CSV file with a header and a declared schema."""
    df = spark.read.csv(path, header=True, schema=schema, dateFormat=date_format)
    return normalised(df.withColumnsRenamed(renames or {}))


def column_names(spark: SparkSession, path: str, without: Sequence[str] = (), without_suffix: Sequence[str] = ()) -> list[str]:
    """Columns of a table by its schema alone."""
    return [c for c in spark.read.parquet(path).columns if c not in without and not c.endswith(tuple(without_suffix) or ("\0",))]


def discovered(spark: SparkSession, root: str, pattern: str = "*.parquet") -> DataFrame:
    """path, region, name, year of the files <root>/<region>/<kind>/<name>_<YYYY>.parquet; others are left out."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(root).select("path", "length", "modificationTime")
    stem = F.regexp_extract("path", r"([^/]+)\.[^./]+$", 1)
    return (
        files.withColumn("name", F.regexp_extract(stem, r"^(.+)_(\d{4})$", 1))
        .withColumn("year", F.regexp_extract(stem, r"^(.+)_(\d{4})$", 2).try_cast("int"))
        .withColumn("region", F.regexp_extract("path", r"([^/]+)/[^/]+/[^/]+$", 1))
        .filter("year IS NOT NULL")
    )


def fingerprint(files: DataFrame) -> DataFrame:
    """One row: sha1 over the sorted paths, lengths and times of discovered files."""
    each = F.concat_ws("|", "path", F.col("length").cast("string"), F.col("modificationTime").cast("string"))
    return files.agg(F.sha1(F.concat_ws("\n", F.sort_array(F.collect_list(each)))).alias("fingerprint"))


def single_variable(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """df with time under its usual name and without auxiliary columns; ValueError unless one variable remains."""
    for name in TIME_NAMES[1:]:
        if name in df.columns and TIME_NAMES[0] not in df.columns:
            df = df.withColumnRenamed(name, TIME_NAMES[0])
    df = df.drop(*AUXILIARY)
    variables = [c for c in df.columns if c not in keys]
    if len(variables) != 1:
        raise ValueError(f"one variable was expected, there are {variables}")
    return df


def exists(spark: SparkSession, path: str) -> bool:
    """Whether the path is there, on whatever file system it names."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def first_existing(spark: SparkSession, paths: Sequence[str]) -> str:
    """The first of the paths (new names before legacy ones) that is there; FileNotFoundError names all of them."""
    for path in paths:
        if exists(spark, path):
            return path
    raise FileNotFoundError(f"none of {list(paths)} is there")


def cached(spark: SparkSession, path: str, compute: Callable[[], DataFrame], use_cache: bool = True, key: str | None = None) -> DataFrame:
    """The table at the path if it is complete; else it is computed, written there and read again.

    ``key`` tells versions of the source apart, as ``fingerprint`` does: each has its own folder below the path, so
    a changed source is computed anew. A table is written beside its place and renamed, so readers see it whole.
    """
    place = f"{path}/key={key}" if key else path
    if not (use_cache and exists(spark, f"{place}/_SUCCESS")):
        beside = f"{place}.{uuid.uuid4().hex}.tmp"
        compute().write.parquet(beside)
        jvm = spark.sparkContext._jvm
        at, new = jvm.org.apache.hadoop.fs.Path(place), jvm.org.apache.hadoop.fs.Path(beside)
        files = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        if files.exists(at):
            files.delete(at, True)
        if not files.rename(new, at):
            raise OSError(f"{beside} could not be renamed to {place}")
    return spark.read.parquet(place)


def results(spark: SparkSession, glob: str, pattern: str, names: Sequence[str]) -> DataFrame:
    """All result files of a glob, with the groups of the pattern in their names as columns."""
    df = spark.read.option("mergeSchema", "true").parquet(glob)
    name = F.input_file_name()
    return df.withColumns({n: F.regexp_extract(name, pattern, k) for k, n in enumerate(names, 1)})


def artifacts(spark: SparkSession, root: str) -> DataFrame:
    """cluster, season (null: the pooled model), path of the model files best_model_c<cluster>[_<season>].<kind> below root."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "best_model_c*").load(root).select("path")
    named = r"best_model_c(\d+)(?:_(DJF|MAM|JJA|SON))?\.(?:joblib|keras|json)$"
    cluster = F.regexp_extract("path", named, 1).try_cast("int")
    return files.select(cluster.alias("cluster"), F.nullif(F.regexp_extract("path", named, 2), F.lit("")).alias("season"), "path").filter("cluster IS NOT NULL")


def target_rows(df: DataFrame, value: str, day: str, end: str) -> tuple[DataFrame, DataFrame]:
    """Rows with a value up to the end, and the days that they have."""
    rows = df.filter(F.col(value).isNotNull() & (F.col(day) <= F.lit(end).cast("date")))
    return rows, rows.select(day).distinct()
