"""Block sums and what is drawn from them: no task reads a whole group of residuals."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from gustflow.queries import inference, tables


def most_read(spark, run) -> int:
    """Bytes of shuffles that the largest task of the run read."""
    store = spark.sparkContext._jsc.sc().statusStore()
    stages = lambda: {(s.stageId(), s.attemptId()): s for s in listed(store.stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None))}
    listed = lambda seq: [seq.apply(i) for i in range(seq.size())]
    before = stages().keys()
    run()
    read = [0]
    for key in stages().keys() - before:
        for task in listed(store.taskList(*key, 1_000)):
            if task.taskMetrics().isDefined():
                metrics = task.taskMetrics().get().shuffleReadMetrics()
                read.append(metrics.remoteBytesRead() + metrics.localBytesRead())
    return max(read)


@pytest.fixture(scope="module")
def sized(spark, tmp_path_factory):
    """Tables of 30 000 and of 240 000 lines, each with a price of its own, all of them in a month of the test split."""
    found = {}
    for n in (30_000, 240_000):
        found[n] = str(tmp_path_factory.mktemp(f"lines_{n}"))
        k = F.col("id")
        lines = spark.range(0, n, 1, 4).select(
            (k / 31).cast("long").alias("l_suppkey"),
            F.date_add(F.lit("1996-01-01").cast("date"), (k % 31).cast("int")).cast("timestamp").alias("l_shipdate"),
            (F.pmod(F.xxhash64("id"), F.lit(10_000_000)) / 100.0).alias("l_extendedprice"),
        )
        lines.write.parquet(f"{found[n]}/lineitem.parquet")
        of_station = spark.range(n // 31 + 1).select(k.alias("s_suppkey"), (k % 25).cast("int").alias("s_nationkey"))
        of_station.write.parquet(f"{found[n]}/supplier.parquet")
    return found


@pytest.mark.parametrize("query", [inference.x03_effects_by_family_and_axis, inference.x03_x07_paired_effect, inference.x06_seeded_draws, inference.a18_block_sums])
def test_no_task_reads_a_group(spark, sized, monkeypatch, query):
    """Eight times the lines: the largest task reads less than three times as much. Exact percentiles read all of a group."""
    monkeypatch.setattr(tables, "DEALT", 30_000, raising=False)
    monkeypatch.setattr(inference, "DRAWS", 20)
    read = {}
    for n, place in sized.items():
        read[n] = most_read(spark, lambda: query(spark, place).collect())  # noqa: B023
        spark.catalog.clearCache()
    assert 0 < read[240_000] < 3 * read[30_000], read
