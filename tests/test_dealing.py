"""Panels are dealt by their rows, so that no task grows with the table."""

from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F

from gustflow.operators import learning, relations
from gustflow.queries import inference, tables

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")


def test_partitions_grow_with_rows(spark, monkeypatch):
    lines = tables.table(spark, SF, "lineitem").count()
    for rows in (lines, lines // 40):
        monkeypatch.setattr(tables, "DEALT", rows, raising=False)
        wanted = max(spark.sparkContext.defaultParallelism, -(-lines // rows))
        for df in (tables.panel(spark, SF), inference._uneven(spark, SF)):
            assert df.rdd.getNumPartitions() == wanted
    assert wanted >= 40


def test_rows_of_a_panel_meet_where_they_were_dealt(spark):
    """Arms are paired, and boosted trees fitted, in the panel's own partitions: keys of both are the panel's."""
    day = tables.panel(spark, SF).withColumn("at", F.spark_partition_id())
    assert day.groupBy("station", "day").agg(F.count_distinct("at").alias("n")).filter("n > 1").isEmpty()
    plan = inference._uneven(spark, SF).groupBy("model", "tag", "station", "day").agg(F.max("e"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_permutations_read_rows_once(spark):
    """All repeats take the same computed rows, and no shuffle carries the random hash that orders them."""
    df = spark.range(200).select("id", (F.col("id") % 7).cast("double").alias("a"), (F.col("id") % 11).cast("double").alias("y"))
    found = learning.permutation_importance(df, lambda c: c["a"], {"a": ["a"]}, ["id"], "y", repeats=2)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "InMemoryTableScan" in plan
    placed = relations.numbered(df, F.xxhash64("id"), ["id"], "place")._jdf.queryExecution().executedPlan().toString()
    below = placed[placed.index("REPARTITION_BY_COL") :].splitlines()[1]
    assert "_k" in below and "_h" not in below
