"""Extraction by parts that stops and goes on, and tables made in stages."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from gustflow.operators import spatial
from gustflow.sources import extraction

LAT, LON = (0.0, -1.0, 6), (0.0, 1.0, 6)


@pytest.fixture()
def world(spark):
    stations = spark.createDataFrame([(f"A{k:03d}", -0.37 * (k % 20), 0.23 * k) for k in range(40)] + [(None, 0.0, 0.0)], "estacao string, lat double, lon double")
    grid = spark.range(36).select((F.col("id") / 6).cast("int").alias("i"), (F.col("id") % 6).cast("int").alias("j"), (F.col("id") * 1.5).alias("v"))
    calls = []

    def at(some):
        calls.append(sorted(r["estacao"] for r in some.collect()))
        return spatial.nearest_values(some, grid, LAT, LON, ["v"]).select("estacao", "v")

    return stations, at, calls


def whole(df):
    return sorted(map(tuple, df.select("estacao", "v").collect()), key=str)


def test_goes_on_with_missing_parts_only(spark, tmp_path, world):
    stations, at, calls = world
    wanted = whole(at(stations.filter("estacao IS NOT NULL")))
    calls.clear()

    def failing(some):
        if len(calls) == 3:
            raise OSError("lost")
        return at(some)

    path = str(tmp_path / "values")
    with pytest.raises(OSError, match="lost"):
        extraction.extracted(spark, path, stations, "estacao", failing, parts=5)
    assert len(calls) == 3 and extraction.manifest(spark, path).count() == 3
    assert whole(extraction.extracted(spark, path, stations, "estacao", at, parts=5)) == wanted
    assert len(calls) == 5 and sorted(sum(calls, [])) == [r[0] for r in wanted]  # each station once
    assert whole(extraction.extracted(spark, path, stations, "estacao", at, parts=5)) == wanted and len(calls) == 5
    other = extraction.extracted(spark, path, stations, "estacao", at, parts=5, at_once=5, variant="bilinear")
    assert whole(other) == wanted and len(calls) == 6  # a variant has parts of its own


def test_changed_stations_and_wrong_ids(spark, tmp_path, world):
    stations, at, calls = world
    path = str(tmp_path / "values")
    extraction.extracted(spark, path, stations, "estacao", at, parts=4)
    fewer = stations.filter("estacao != 'A007' OR estacao IS NULL")
    calls.clear()
    assert len(whole(extraction.extracted(spark, path, fewer, "estacao", at, parts=4))) == 39
    assert len(calls) == 1 and "A007" not in calls[0]  # only the part that held it
    assert len(whole(extraction.extracted(spark, path, stations, "estacao", at, parts=4))) == 40 and len(calls) == 1
    bad = str(tmp_path / "bad")
    for wrong in (lambda s: at(s).filter("estacao != 'A011'"), lambda s: at(s).withColumn("estacao", F.regexp_replace("estacao", "A011", "B011"))):
        with pytest.raises(ValueError, match="ids"):
            extraction.extracted(spark, bad, stations, "estacao", wrong, parts=1)
        assert extraction.manifest(spark, bad).count() == 0
    assert len(whole(extraction.extracted(spark, bad, stations, "estacao", at, parts=1))) == 40
    none = extraction.extracted(spark, str(tmp_path / "none"), stations.filter("estacao IS NULL"), "estacao", at)
    assert none.columns == ["estacao", "v"] and none.count() == 0
    repeated = extraction.extracted(spark, str(tmp_path / "twice"), stations.union(stations.limit(3)), "estacao", at, parts=2)
    assert repeated.count() == 43 and repeated.distinct().count() == 40


def test_stages_start_after_the_last_complete_table(spark, tmp_path):
    calls = []

    def stage(name, fail=False):
        def made(before):
            calls.append(name)
            if fail:
                raise OSError(name)
            return spark.range(3) if before is None else before.select((F.col("id") + 10).alias("id"))

        return str(tmp_path / name), made

    with pytest.raises(OSError):
        extraction.staged(spark, [stage("merged"), stage("rebuilt", fail=True)])
    both = [stage("merged"), stage("rebuilt")]
    assert sorted(r["id"] for r in extraction.staged(spark, both).collect()) == [10, 11, 12]
    assert calls == ["merged", "rebuilt", "rebuilt"]
    extraction.staged(spark, both)
    assert len(calls) == 3
    extraction.staged(spark, both, use_cache=False)
    assert calls[3:] == ["rebuilt"]
    with pytest.raises(ValueError):
        extraction.staged(spark, [])
