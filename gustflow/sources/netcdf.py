"""NetCDF files of the classic formats as a Spark data source.

A file's header says where each variable's numbers lie, so a scan is planned as stretches of the first dimension
(time, as a rule), each read by its byte range in a task of its own. Filters on that dimension drop stretches before they
are read. The layout follows the published description of the classic and 64-bit-offset formats.
"""

from __future__ import annotations

import datetime as dt
import glob
import os
import re
import struct
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual
from pyspark.sql.types import StructType

# Fixed values of the format: type codes, and the tags of its lists.
_TYPES = {1: ">i1", 2: "S1", 3: ">i2", 4: ">i4", 5: ">f4", 6: ">f8"}
_DIMENSION, _VARIABLE, _ATTRIBUTE = 10, 11, 12
#: Seconds of the units that times come in.
_UNITS = {"second": 1, "minute": 60, "hour": 3600, "day": 86400}


@dataclass
class Variable:
    name: str
    dims: list[int]
    attributes: dict
    kind: str
    size: int
    begin: int
    record: bool


@dataclass
class Header:
    """Dimensions (name, length; the record dimension's is the number of records), variables and bytes of a record."""

    dims: list[tuple[str, int]]
    variables: dict[str, Variable]
    record_size: int


def read_header(path: str) -> Header:
    """The header of a classic NetCDF file; ValueError for any other file."""
    with open(path, "rb") as f:

        def number(kind: str) -> int:
            return struct.unpack(kind, f.read(struct.calcsize(kind)))[0]

        def text() -> str:
            n = number(">i")
            found = f.read(n).decode()
            f.read(-n % 4)
            return found

        def attributes() -> dict:
            tag, n = number(">i"), number(">i")
            if tag not in (0, _ATTRIBUTE):
                raise ValueError(f"{path}: no list of attributes where one belongs")
            out = {}
            for _ in range(n):
                name, kind, count = text(), _TYPES[number(">i")], number(">i")
                size = count * np.dtype(kind).itemsize
                raw = f.read(size)
                f.read(-size % 4)
                out[name] = raw.decode() if kind == "S1" else np.frombuffer(raw, kind).tolist()
            return out

        if f.read(3) != b"CDF" or (version := f.read(1)[0]) not in (1, 2):
            raise ValueError(f"{path} is no NetCDF file of a classic format")
        records = number(">i")
        number(">i")  # the tag of dimensions
        dims = [(text(), number(">i")) for _ in range(number(">i"))]
        unlimited = next((k for k, (_, n) in enumerate(dims) if n == 0), None)
        attributes()
        number(">i")  # the tag of variables
        variables = {}
        for _ in range(number(">i")):
            name = text()
            places = [number(">i") for _ in range(number(">i"))]
            own, kind, size = attributes(), _TYPES[number(">i")], number(">i")
            begin = number(">i" if version == 1 else ">q")
            variables[name] = Variable(name, places, own, kind, size, begin, bool(places) and places[0] == unlimited)
        moving = [v for v in variables.values() if v.record]
        # a single variable of records is not padded between them
        step = moving[0] if len(moving) == 1 else None
        shape = lambda v: int(np.prod([dims[d][1] for d in v.dims[1:]], dtype=np.int64))
        record_size = shape(step) * np.dtype(step.kind).itemsize if step else sum(v.size for v in moving)
        if unlimited is not None:
            if records < 0:
                records = (os.path.getsize(path) - min(v.begin for v in moving)) // record_size if moving else 0
            dims[unlimited] = (dims[unlimited][0], records)
        return Header(dims, variables, record_size)


def read_values(path: str, header: Header, name: str, start: int = 0, stop: int | None = None) -> np.ndarray:
    """A variable's numbers from ``start`` to ``stop`` of its first dimension, unpacked; unknown ones are NaN."""
    v = header.variables[name]
    shape = [header.dims[d][1] for d in v.dims]
    stop = shape[0] if stop is None and shape else stop
    inner = int(np.prod(shape[1:], dtype=np.int64))
    width = np.dtype(v.kind).itemsize
    with open(path, "rb") as f:
        if not shape:
            f.seek(v.begin)
            raw = np.frombuffer(f.read(width), v.kind)
        elif v.record:
            parts = []
            for k in range(start, stop):
                f.seek(v.begin + k * header.record_size)
                parts.append(f.read(inner * width))
            raw = np.frombuffer(b"".join(parts), v.kind)
        else:
            f.seek(v.begin + start * inner * width)
            raw = np.frombuffer(f.read((stop - start) * inner * width), v.kind)
    values = raw.astype(float)
    one = lambda key: np.ravel(v.attributes[key])[0] if key in v.attributes else None
    for key in ("_FillValue", "missing_value"):
        if (fill := one(key)) is not None:
            values[raw == np.array(fill).astype(v.kind)] = np.nan
    if (scale := one("scale_factor")) is not None:
        values = values * scale
    if (offset := one("add_offset")) is not None:
        values = values + offset
    return values.reshape([stop - start, *shape[1:]] if shape else [1])


def _times(values: np.ndarray, units: str) -> np.ndarray | None:
    """Microseconds since 1970 of numbers in units "<unit> since <date>[ <time>]"; None for other units."""
    found = re.fullmatch(r"\s*(second|minute|hour|day)s?\s+since\s+(\d+-\d+-\d+)(?:[ T](\d+:\d+(?::\d+)?).*)?\s*", units or "")
    if not found:
        return None
    clock = (found[3] or "0:0:0").split(":") + ["0"]
    begin = dt.datetime(*map(int, found[2].split("-")), int(clock[0]), int(clock[1]), int(clock[2]), tzinfo=dt.UTC)
    return np.round(values * _UNITS[found[1]] * 1e6).astype(np.int64) + int(begin.timestamp()) * 1_000_000


def coordinate(path: str, header: Header, dim: int) -> tuple[str, np.ndarray]:
    """Spark's type and the values of a dimension: its coordinate variable's (times where units say so), else its places."""
    name, length = header.dims[dim]
    v = header.variables.get(name)
    if v is None or v.dims != [dim] or v.kind == "S1":
        return "bigint", np.arange(length)
    values = read_values(path, header, name)
    times = _times(values, v.attributes.get("units", "") if isinstance(v.attributes.get("units", ""), str) else "")
    return ("timestamp", times) if times is not None else ("double", values)


@dataclass
class Stretch(InputPartition):
    """Places start to stop of the first dimension of a file's variable."""

    path: str
    start: int
    stop: int


def _micros(value) -> float:
    if isinstance(value, dt.datetime):
        return (value if value.tzinfo else value.replace(tzinfo=dt.UTC)).timestamp() * 1e6
    return float(value)


class ClassicReader(DataSourceReader):
    def __init__(self, schema: StructType, paths: list[str], variable: str, stretch: int):
        self.names, self.paths, self.variable, self.stretch = schema.names, paths, variable, stretch
        self.schema = schema
        self.low, self.high = -np.inf, np.inf

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Bounds of the first dimension drop stretches; Spark still filters what is read."""
        for f in filters:
            if getattr(f, "attribute", None) == (self.names[0],) and isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)):
                if not isinstance(f, (LessThan, LessThanOrEqual)):
                    self.low = max(self.low, _micros(f.value))
                if not isinstance(f, (GreaterThan, GreaterThanOrEqual)):
                    self.high = min(self.high, _micros(f.value))
            yield f

    def partitions(self) -> list[Stretch]:
        out = []
        for path in self.paths:
            header = read_header(path)
            _, values = coordinate(path, header, header.variables[self.variable].dims[0])
            for start in range(0, len(values), self.stretch):
                some = values[start : start + self.stretch]
                if some.max() >= self.low and some.min() <= self.high:
                    out.append(Stretch(path, start, start + len(some)))
        return out

    def read(self, part: Stretch) -> Iterator[pa.RecordBatch]:
        if part is None:  # nothing is left after filters
            return
        header = read_header(part.path)
        dims = header.variables[self.variable].dims
        axes = [coordinate(part.path, header, d) for d in dims]
        axes[0] = (axes[0][0], axes[0][1][part.start : part.stop])
        inner = int(np.prod([len(v) for _, v in axes[1:]], dtype=np.int64))
        step = max(1, 200_000 // max(1, inner))  # a batch is some places of the first dimension
        for at in range(0, part.stop - part.start, step):
            some = [axes[0][1][at : at + step], *(v for _, v in axes[1:])]
            values = read_values(part.path, header, self.variable, part.start + at, part.start + at + len(some[0])).ravel()
            grid = np.meshgrid(*some, indexing="ij")
            columns = [pa.array(g.ravel(), pa.timestamp("us", "UTC") if kind == "timestamp" else None) for g, (kind, _) in zip(grid, axes, strict=True)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(values, mask=np.isnan(values))], names=self.names)


class ClassicNetcdf(DataSource):
    """Format ``netcdf_classic``: rows (dimensions..., variable) of one variable.

    Options: ``path`` (a file or pattern, which every node must see), ``variable`` (may be left out where just one
    has as many dimensions as the most), ``stretch`` (places of the first dimension that a task reads, 366).
    """

    @classmethod
    def name(cls) -> str:
        return "netcdf_classic"

    def _chosen(self) -> tuple[list[str], Header, str]:
        paths = sorted(glob.glob(self.options["path"]))
        if not paths:
            raise FileNotFoundError(self.options["path"])
        header = read_header(paths[0])
        most = max((len(v.dims) for v in header.variables.values()), default=0)
        fields = [n for n, v in header.variables.items() if len(v.dims) == most and v.kind != "S1" and [n] != [header.dims[d][0] for d in v.dims]]
        variable = self.options.get("variable") or (fields[0] if len(fields) == 1 else None)
        if variable not in header.variables or not header.variables[variable].dims:
            raise ValueError(f"choose a variable of {paths[0]}: {', '.join(fields)}")
        return paths, header, variable

    def schema(self) -> str:
        paths, header, variable = self._chosen()
        dims = header.variables[variable].dims
        return ", ".join([*(f"`{header.dims[d][0]}` {coordinate(paths[0], header, d)[0]}" for d in dims), f"`{variable}` double"])

    def reader(self, schema: StructType) -> ClassicReader:
        paths, _, variable = self._chosen()
        return ClassicReader(schema, paths, variable, int(self.options.get("stretch", 366)))


def scan_netcdf(spark: SparkSession, path: str, variable: str | None = None, stretch: int = 366) -> DataFrame:
    """A variable of NetCDF files as rows (dimensions..., variable); filters on the first dimension reach the files."""
    spark.dataSource.register(ClassicNetcdf)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    read = spark.read.format("netcdf_classic").option("stretch", stretch)
    return (read.option("variable", variable) if variable else read).load(path)
