"""Sinks: yearly grids, idempotent work units, an index with changing columns, reports."""

from __future__ import annotations

import html
import json
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .scan import exists


def write_units(df: DataFrame, path: str, by: Sequence[str]) -> None:
    """Write work units; units that were there before are replaced, others stay."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def missing_units(spark: SparkSession, path: str, wanted: DataFrame, by: Sequence[str], fingerprint: str | None = None) -> DataFrame:
    """The units that the path lacks; with a fingerprint, also those that were computed under another one."""
    if not exists(spark, path):
        return wanted
    kinds = {f.name: f.dataType for f in wanted.schema}
    there = spark.read.parquet(path)
    if fingerprint is not None:
        there = there.filter(F.col("fingerprint") == fingerprint) if "fingerprint" in there.columns else there.filter("false")
    done = there.select(*(F.col(c).cast(kinds[c]).alias(c) for c in by)).distinct()
    return wanted.join(done, list(by), "left_anti")


def write_grid(df: DataFrame, path: str, day: str, attributes: dict) -> None:
    """A gridded product by year, with its attributes beside it as JSON."""
    df.withColumn("year", F.year(day)).write.mode("overwrite").partitionBy("year").parquet(path)
    write_json(df.sparkSession, f"{path}.attributes", attributes)


def write_json(spark: SparkSession, path: str, document: dict) -> None:
    spark.createDataFrame([(json.dumps(document, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def read_json(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.text(path, wholetext=True).first()["value"])


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", "true").csv(path)


def append_index(spark: SparkSession, path: str, rows: DataFrame) -> None:
    """Append rows to an index whose columns may change; readers merge the schemas."""
    rows.write.mode("append").parquet(path)


def read_index(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("mergeSchema", "true").parquet(path)


def merged_periods(parts: dict[str, DataFrame], day: str) -> DataFrame:
    """All periods with their names; ValueError if two hold the same year."""
    years = None
    for df in parts.values():
        own = df.select(F.year(day).alias("y")).distinct()
        years = own if years is None else years.unionByName(own)
    if not years.groupBy("y").count().filter("count > 1").isEmpty():
        raise ValueError("periods overlap in a year")
    out = None
    for name, df in parts.items():
        tagged = df.withColumn("period", F.lit(name))
        out = tagged if out is None else out.unionByName(tagged, allowMissingColumns=True)
    return out


def next_experiment(names: Sequence[str]) -> str:
    """exp<N>, one after the greatest that is there."""
    numbers = [int(n[3:]) for n in names if n.startswith("exp") and n[3:].isdigit()]
    return f"exp{max(numbers, default=0) + 1}"


def null_census(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """column, nulls."""
    counts = df.agg(*(F.count_if(F.col(c).isNull()).alias(c) for c in columns))
    return counts.select(F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).alias("nulls")) for c in columns))).alias("_x")).select("_x.*")


def html_table(df: DataFrame, title: str, limit: int = 1000) -> str:
    """A small result as an HTML page; a report's rows are few, and more than ``limit`` raise ValueError."""
    rows = df.limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError("a report is for summaries")
    cell = lambda v, tag="td": f"<{tag}>{html.escape('' if v is None else str(v))}</{tag}>"
    head = "".join(cell(c, "th") for c in df.columns)
    body = "".join("<tr>" + "".join(map(cell, r)) + "</tr>" for r in rows)
    return f"<!doctype html><title>{html.escape(title)}</title><h1>{html.escape(title)}</h1><table><tr>{head}</tr>{body}</table>"
