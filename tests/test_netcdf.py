"""NetCDF files written here, byte by byte, and read back by Spark."""

from __future__ import annotations

import datetime as dt
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from gustflow.sources import netcdf

CODES = {"i2": 3, "i4": 4, "f4": 5, "f8": 6}


def text(s):
    raw = s.encode()
    return struct.pack(">i", len(raw)) + raw + b"\0" * (-len(raw) % 4)


def attributes(found):
    out = struct.pack(">ii", 12 if found else 0, len(found))
    for name, value in found.items():
        if isinstance(value, str):
            raw = value.encode()
            out += text(name) + struct.pack(">ii", 2, len(raw)) + raw
        else:
            raw = np.array([value], ">" + ("i2" if isinstance(value, np.int16) else "f8")).tobytes()
            out += text(name) + struct.pack(">ii", 3 if isinstance(value, np.int16) else 6, 1) + raw
        out += b"\0" * (-len(raw) % 4)
    return out


def write(path, dims, variables, records=None, version=1):
    """dims: (name, length; 0: records); variables: (name, dims by place, attributes, kind, values)."""
    lengths = [records if n == 0 else n for _, n in dims]
    moving = [v for v in variables if v[1] and dims[v[1][0]][1] == 0]
    padded = lambda raw: raw + b"\0" * (-len(raw) % 4)
    block = lambda v: int(np.prod([lengths[d] for d in v[1][1:]])) * np.dtype(v[3]).itemsize if v in moving else v[4].size * np.dtype(v[3]).itemsize

    def header(begins):
        out = b"CDF" + bytes([version]) + struct.pack(">i", records or 0)
        out += struct.pack(">ii", 10, len(dims)) + b"".join(text(n) + struct.pack(">i", k) for n, k in dims) + attributes({"title": "made here"})
        out += struct.pack(">ii", 11, len(variables))
        for v, begin in zip(variables, begins, strict=True):
            size = block(v) + -block(v) % 4
            out += text(v[0]) + struct.pack(">i", len(v[1])) + b"".join(struct.pack(">i", d) for d in v[1]) + attributes(v[2])
            out += struct.pack(">ii", CODES[v[3]], size) + struct.pack(">i" if version == 1 else ">q", begin)
        return out

    at = len(header([0] * len(variables)))
    begins, fixed = [0] * len(variables), b""
    for k, v in enumerate(variables):
        if v not in moving:
            begins[k] = at + len(fixed)
            fixed += padded(v[4].astype(">" + v[3]).tobytes())
    place = at + len(fixed)
    for k, v in enumerate(variables):
        if v in moving:
            begins[k] = place
            place += block(v) + (-block(v) % 4 if len(moving) > 1 else 0)
    body = b""
    for r in range(records or 0):
        for v in moving:
            raw = np.atleast_1d(v[4][r]).astype(">" + v[3]).tobytes()
            body += padded(raw) if len(moving) > 1 else raw
    path.write_bytes(header(begins) + fixed + body)


def grid(path, version, record, first=0, days=40):
    rng = np.random.default_rng(first + version)
    packed = rng.integers(-100, 100, (days, 3, 5)).astype("i2")
    packed[0, 0, 0] = -999
    dims = [("time", 0 if record else days), ("lat", 3), ("lon", 5)]
    hours = np.arange(first * 24.0, (first + days) * 24, 24)
    write(
        path, dims,
        [
            ("time", [0], {"units": "hours since 2000-01-01 00:00:00"}, "f8", hours),
            ("lat", [1], {}, "f4", np.array([-1.5, 0.0, 1.5])),
            ("gust", [0, 1, 2], {"scale_factor": 0.5, "add_offset": 10.0, "_FillValue": np.int16(-999)}, "i2", packed),
        ],
        days if record else None, version,
    )
    return np.where(packed == -999, np.nan, packed * 0.5 + 10.0)


@pytest.mark.parametrize(("version", "record"), [(1, False), (1, True), (2, True), (2, False)])
def test_grids_are_read_back(spark, tmp_path, version, record):
    wanted = grid(tmp_path / "a.nc", version, record)
    df = netcdf.scan_netcdf(spark, str(tmp_path / "a.nc"), stretch=7)
    assert dict(df.dtypes) == {"time": "timestamp", "lat": "double", "lon": "bigint", "gust": "double"}
    assert df.rdd.getNumPartitions() == 6
    got = df.select(F.datediff("time", F.lit("2000-01-01").cast("date")).alias("d"), "lat", "lon", "gust").collect()
    assert len(got) == wanted.size
    for r in got:
        v = wanted[r["d"], int(r["lat"] / 1.5) + 1, r["lon"]]
        assert (r["gust"] is None and np.isnan(v)) or r["gust"] == v


def test_filters_leave_files_and_stretches_unread(spark, tmp_path):
    for k in range(3):
        grid(tmp_path / f"{k}.nc", 1, k == 1, first=40 * k)
    df = netcdf.scan_netcdf(spark, str(tmp_path / "*.nc"), "gust", stretch=10)
    assert df.rdd.getNumPartitions() == 12 and df.count() == 3 * 40 * 15
    day = lambda k: dt.datetime(2000, 1, 1) + dt.timedelta(days=k)
    few = df.filter((F.col("time") >= F.lit(day(55))) & (F.col("time") < F.lit(day(58))) & (F.col("lat") > 0))
    assert few.count() == 3 * 5 and few.rdd.getNumPartitions() == 1
    assert df.filter(F.col("time") == F.lit(day(60))).count() == 15
    assert df.filter(F.col("time") > F.lit(day(500))).count() == 0


def test_other_files_and_variables_are_refused(spark, tmp_path):
    (tmp_path / "x.nc").write_bytes(b"\x89HDF....")
    with pytest.raises(Exception, match="classic"):
        netcdf.scan_netcdf(spark, str(tmp_path / "x.nc")).count()
    grid(tmp_path / "a.nc", 1, False)
    with pytest.raises(Exception, match="choose a variable"):
        netcdf.scan_netcdf(spark, str(tmp_path / "a.nc"), "other").count()
    with pytest.raises(Exception, match="none.nc"):
        netcdf.scan_netcdf(spark, str(tmp_path / "none.nc")).count()
