"""Streamed work units: stopped and started again, asked for twice, computed anew under another fingerprint."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from gustflow.sources import sink
from gustflow.streaming.units import stream_units


def test_units_are_there_once_after_a_stop(spark, tmp_path):
    asked, path, done = (str(tmp_path / n) for n in ("asked", "units", "state"))
    ask = lambda *units: spark.createDataFrame(units, "arm string, seed int").coalesce(1).write.mode("append").parquet(asked)
    seen, broken = [], [True]

    def compute(units):
        got = sorted(tuple(r) for r in units.collect())
        seen.append(got)
        if broken[0] and ("b", 1) in got:
            raise RuntimeError("stopped half way")
        return units.withColumn("v", F.explode(F.array(F.lit(1), F.lit(2))))

    def run(fingerprint="one"):
        stream = spark.readStream.schema("arm string, seed int").option("maxFilesPerTrigger", 1).parquet(asked)
        query = stream_units(stream, path, done, compute, ["arm", "seed"], fingerprint)
        query.awaitTermination()

    ask(("a", 1), ("a", 2), ("a", 1))
    run()
    ask(("b", 1), ("a", 2))
    with pytest.raises(Exception, match="stopped half way"):
        run()
    broken[0] = False
    run()
    rows = sorted(tuple(r) for r in spark.read.parquet(path).select("arm", "seed", "v", "fingerprint").collect())
    assert rows == [(a, k, v, "one") for a, k in (("a", 1), ("a", 2), ("b", 1)) for v in (1, 2)]
    assert seen == [[("a", 1), ("a", 2)], [("b", 1)], [("b", 1)]]
    ask(("a", 2))
    run("two")  # a changed definition: computed anew, in place of the old rows
    rows = {(r["arm"], r["seed"]): r["fingerprint"] for r in spark.read.parquet(path).collect()}
    assert rows == {("a", 1): "one", ("a", 2): "two", ("b", 1): "one"} and spark.read.parquet(path).count() == 6
    wanted = spark.createDataFrame([("a", 1), ("a", 2), ("c", 9)], "arm string, seed int")
    lacking = lambda f: sorted(tuple(r) for r in sink.missing_units(spark, path, wanted, ["arm", "seed"], f).collect())
    assert lacking(None) == [("c", 9)] and lacking("two") == [("a", 1), ("c", 9)]
