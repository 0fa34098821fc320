"""Shapefiles written here, byte by byte, and read back by Spark; polygons of several parts and with holes."""

from __future__ import annotations

import datetime as dt
import struct

import pytest
from pyspark.sql import functions as F

from gustflow.operators import spatial
from gustflow.plans.study import station_clusters
from gustflow.sources import shapes


def box(x0, y0, x1, y1):
    return [(x0, y0), (x0, y1), (x1, y1), (x1, y0), (x0, y0)]


def content(rings, code=5):
    if rings is None:
        return struct.pack("<i", 0)
    if code == 1:
        return struct.pack("<i2d", 1, *rings)
    points = [p for r in rings for p in r]
    xs, ys = zip(*points, strict=True)
    starts = [sum(map(len, rings[:k])) for k in range(len(rings))]
    out = struct.pack("<i4d2i", code, min(xs), min(ys), max(xs), max(ys), len(rings), len(points))
    out += struct.pack(f"<{len(rings)}i", *starts) + b"".join(struct.pack("<2d", *p) for p in points)
    return out + (struct.pack(f"<{2 + len(points)}d", *[0.0] * (2 + len(points))) if code == 15 else b"")


def write(path, records, fields=(), rows=(), deleted=(), index=True, gap=0):
    """records: contents; fields: (name, type, size, places); rows: texts of each record's fields."""
    head = lambda size: struct.pack(">7i", 9994, 0, 0, 0, 0, 0, size // 2) + struct.pack("<2i", 1000, 5) + b"\0" * 64
    body, places = b"", []
    for k, raw in enumerate(records):
        places.append((100 + len(body), len(raw)))
        body += struct.pack(">2i", k + 1, len(raw) // 2) + raw + b"\0" * gap
    path.with_suffix(".shp").write_bytes(head(100 + len(body)) + body)
    if index:
        path.with_suffix(".shx").write_bytes(head(100 + 8 * len(places)) + b"".join(struct.pack(">2i", a // 2, n // 2) for a, n in places))
    if fields:
        width = 1 + sum(f[2] for f in fields)
        table = struct.pack("<4BIHH20x", 3, 120, 1, 1, len(rows), 33 + 32 * len(fields), width)
        table += b"".join(struct.pack("<11sc4x2B14x", n.encode(), t.encode(), size, dec) for n, t, size, dec in fields) + b"\r"
        for k, row in enumerate(rows):
            table += (b"*" if k in deleted else b" ") + b"".join(v.encode("latin-1").ljust(f[2]) if f[1] == "C" else v.encode().rjust(f[2]) for v, f in zip(row, fields, strict=True))
        path.with_suffix(".dbf").write_bytes(table + b"\x1a")
    return str(path.with_suffix(".shp"))


FIELDS = [("CLUSTER", "C", 4, 0), ("AREA", "N", 10, 3), ("N", "N", 5, 0), ("BORN", "D", 8, 0), ("OLD", "L", 1, 0)]


def test_shapes_and_attributes(spark, tmp_path):
    rings = [[box(0, 0, 4, 4), box(1, 1, 3, 3)], None, [box(10, 0, 11, 1)], [box(20, 0, 21, 1), box(22, 0, 23, 1)]]
    rows = [("01", "1.500", "7", "20200131", "T"), ("", "", "", "", "?"), ("gone", "1", "1", "20200101", "F"), ("São", "x", "-3", "20209999", "n")]
    path = write(tmp_path / "a", [content(r, 15 if k == 3 else 5) for k, r in enumerate(rings)], FIELDS, rows, deleted={2})
    for stretch in (1, 3, 1000):
        df = shapes.scan_shapes(spark, path, stretch)
        assert df.rdd.getNumPartitions() == -(-4 // stretch)
        found = {r["shape_id"]: r for r in df.collect()}
        assert sorted(found) == [0, 1, 3]  # the deleted record is left out
        assert [[tuple(p) for p in r] for r in found[0]["parts"]] == rings[0] and found[1]["parts"] is None
        assert [[tuple(p) for p in r] for r in found[3]["parts"]] == rings[3]
        assert tuple(found[0])[2:] == ("01", 1.5, 7, dt.date(2020, 1, 31), True)
        assert tuple(found[1])[2:] == (None,) * 5 and tuple(found[3])[2:] == ("São", None, -3, None, False)
    assert df.dtypes[2:] == [("CLUSTER", "string"), ("AREA", "double"), ("N", "bigint"), ("BORN", "date"), ("OLD", "boolean")]


def test_folders_missing_files_and_refusals(spark, tmp_path):
    folder = tmp_path / "some"
    folder.mkdir()
    write(folder / "a", [content([box(0, 0, 1, 1)])], index=False)
    write(folder / "b", [content((5.0, 6.0), 1), content([box(0, 0, 2, 2)], 3)], gap=12)
    found = shapes.scan_shapes(spark, str(folder)).orderBy("shape_id").collect()
    assert [r["shape_id"] for r in found] == [0, 1 << 32, (1 << 32) + 1]
    assert [tuple(p) for p in found[1]["parts"][0]] == [(5.0, 6.0)] and len(found[2]["parts"][0]) == 5
    assert shapes.scan_shapes(spark, write(tmp_path / "none", [])).count() == 0
    with pytest.raises(Exception, match="nowhere"):
        shapes.scan_shapes(spark, str(tmp_path / "nowhere.shp"))
    write(tmp_path / "clash", [content(None)], [("Parts", "C", 1, 0)], [("a",)])
    with pytest.raises(Exception, match="clash"):
        shapes.scan_shapes(spark, str(tmp_path / "clash.shp"))
    write(tmp_path / "metres", [content(None)])
    (tmp_path / "metres.prj").write_text('PROJCS["UTM"]')
    with pytest.raises(Exception, match="projected"):
        shapes.scan_shapes(spark, str(tmp_path / "metres.shp"))
    (tmp_path / "text.shp").write_text("no shapes")
    with pytest.raises(Exception, match="no shapefile"):
        shapes.scan_shapes(spark, str(tmp_path / "text.shp"))


def test_holes_islands_parts_and_cells(spark):
    ring = lambda *a: [{"x": float(x), "y": float(y)} for x, y in box(*a)]
    held = [(1, [ring(0, 0, 9, 9), ring(1, 1, 8, 8), ring(3, 3, 6, 6)]), (2, [ring(20, 0, 21, 1), ring(30, 0, 31, 1)]), (3, None), (4, []), (5, [ring(0, 0, 31, 9)])]
    polygons = spark.createDataFrame(held, f"id int, parts {shapes.PARTS_TYPE}")
    wanted = {(0.5, 0.5): 1, (2.0, 2.0): 5, (4.0, 4.0): 1, (1.0, 2.0): 5, (20.5, 0.5): 2, (30.5, 0.5): 2, (25.0, 0.5): 5, (0.0, 3.0): -1, (40.0, 40.0): -1}
    pts = spark.createDataFrame([*wanted, (None, 1.0)], "x double, y double")
    for limit in (100, 0):
        found = {(r["x"], r["y"]): r["cluster"] for r in spatial.assign_polygon(pts, polygons, "x", "y", limit=limit).collect()}
        assert found == {**wanted, (None, 1.0): -1}
        empty = spatial.assign_polygon(pts, polygons.filter("id IN (3, 4)"), "x", "y", limit=limit)
        assert {r["cluster"] for r in empty.collect()} == {-1}


def test_stations_take_the_first_shapes_number(spark, tmp_path):
    records = [content([box(0, 0, 4, 4), box(1, 1, 3, 3)]), content([box(2, 2, 6, 6)]), content([box(7, 7, 8, 8)])]
    path = write(tmp_path / "c", records, [("cluster", "C", 4, 0)], [("02",), ("01",), ("x",)])
    stations = spark.createDataFrame([("a", 3.5, 3.5), ("b", 2.5, 2.5), ("c", 1.5, 1.5), ("d", 7.5, 7.5), ("a", 5.0, 5.0), ("e", None, 1.0)], "estacao string, lon double, lat double")
    found = station_clusters(stations, shapes.scan_shapes(spark, path), "estacao")
    assert sorted(map(tuple, found.collect())) == [("a", 2), ("b", 1), ("c", -1), ("d", -1), ("e", -1)]
    assert found.select(F.max("cluster_id")).first()[0] == 2
