"""Shapefiles as a Spark data source: shapes with their parts, beside the attributes of the .dbf table.

The index (.shx) says where each record lies, so a scan is planned as stretches of records, each read by its byte range
in a task of its own; records of the .dbf table have one width and are read at their places. The layouts follow the
published descriptions of both formats.
"""

from __future__ import annotations

import datetime as dt
import glob
import os
import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

# Fixed values of the formats: shape codes (plain, with heights, with measures) and the width of the two headers.
_EMPTY, _POINTS, _PARTED = 0, (1, 11, 21), (3, 5, 13, 15, 23, 25)
_HEADER, _INDEXED, _FIELD = 100, 8, 32
#: Columns of a shape: its number (its place in the file, plus 2^32 for each file before it), and its rings or lines as arrays of points (null: an empty shape).
SHAPE_ID, PARTS = "shape_id", "parts"
PARTS_TYPE = "array<array<struct<x: double, y: double>>>"
_POINT = pa.struct([("x", pa.float64()), ("y", pa.float64())])


@dataclass
class Field:
    """A column of a .dbf table: its type in Spark and Arrow, and where it lies in a record."""

    name: str
    kind: str
    begin: int
    size: int

    @property
    def spark_type(self) -> str:
        return {"N": "double", "F": "double", "I": "bigint", "D": "date", "L": "boolean"}.get(self.kind, "string")

    @property
    def arrow_type(self) -> pa.DataType:
        return {"double": pa.float64(), "bigint": pa.int64(), "date": pa.date32(), "boolean": pa.bool_(), "string": pa.string()}[self.spark_type]


@dataclass
class Attributes:
    n: int
    begin: int
    width: int
    fields: list[Field]


def beside(path: str, ending: str) -> str | None:
    """The file of another ending that belongs to a .shp file, whichever case it has."""
    stem = os.path.splitext(path)[0]
    return next((p for p in (f"{stem}.{ending}", f"{stem}.{ending.upper()}") if os.path.exists(p)), None)


def read_attributes(path: str) -> Attributes:
    """The header of a .dbf table; whole numbers of up to 18 digits are bigint, other numbers double."""
    with open(path, "rb") as f:
        head = f.read(_FIELD)
        n, begin, width = struct.unpack("<IHH", head[4:12])
        fields, at = [], 1  # a flag of deletion leads each record
        for _ in range((begin - _FIELD - 1) // _FIELD):
            raw = f.read(_FIELD)
            if raw[:1] in (b"\r", b""):
                break
            kind, size, places = chr(raw[11]), raw[16], raw[17]
            fields.append(Field(raw[:11].split(b"\0")[0].decode("latin-1").strip(), "I" if kind == "N" and not places and size <= 18 else kind, at, size))
            at += size
    return Attributes(n, begin, width, fields)


def _value(raw: bytes, kind: str, encoding: str):
    """A field's value; null where it is blank or cannot be read."""
    text = raw.decode(encoding, "replace").strip(" \0")
    if not text:
        return None
    try:
        match kind:
            case "I":
                return int(text)
            case "N" | "F":
                return float(text)
            case "D":
                return dt.date(int(text[:4]), int(text[4:6]), int(text[6:8]))
            case "L":
                return {"t": True, "y": True, "f": False, "n": False}.get(text[0].lower())
    except ValueError:
        return None
    return text


def checked_header(path: str) -> None:
    """ValueError unless the file is a shapefile in degrees: nothing here can turn metres into them."""
    with open(path, "rb") as f:
        head = f.read(_HEADER)
    if len(head) < _HEADER or struct.unpack(">i", head[:4])[0] != 9994:
        raise ValueError(f"{path} is no shapefile")
    if system := beside(path, "prj"):
        with open(system, encoding="latin-1") as f:
            if f.read().lstrip().upper().startswith("PROJC"):
                raise ValueError(f"{system} names a projected system; longitudes and latitudes are expected")


def places(path: str) -> np.ndarray:
    """Byte offset of each record, from the index or, without one, from the records' own lengths."""
    if index := beside(path, "shx"):
        with open(index, "rb") as f:
            f.seek(_HEADER)
            return np.frombuffer(f.read(), ">i4").reshape(-1, 2)[:, 0].astype(np.int64) * 2
    found, at, end = [], _HEADER, os.path.getsize(path)
    with open(path, "rb") as f:
        while at + _INDEXED <= end:
            found.append(at)
            f.seek(at + 4)
            at += _INDEXED + 2 * struct.unpack(">i", f.read(4))[0]
    return np.array(found, np.int64)


def parts_of(content: bytes) -> list[np.ndarray] | None:
    """A record's parts as arrays of (x, y): a point is one part of one point, an empty shape None."""
    (code,) = struct.unpack_from("<i", content)
    if code == _EMPTY:
        return None
    if code in _POINTS:
        return [np.frombuffer(content, "<f8", 2, 4).reshape(1, 2)]
    if code not in _PARTED:
        raise ValueError(f"shapes of code {code} are not read")
    n_parts, n_points = struct.unpack_from("<ii", content, 36)
    starts = np.frombuffer(content, "<i4", n_parts, 44)
    points = np.frombuffer(content, "<f8", 2 * n_points, 44 + 4 * n_parts).reshape(-1, 2)
    return np.split(points, starts[1:])


@dataclass
class Records(InputPartition):
    """Records of a file from ``start`` on, by the byte at which each lies; ``first`` is added to their numbers."""

    path: str
    first: int
    start: int
    at: list[int]


class ShapeReader(DataSourceReader):
    def __init__(self, schema: StructType, paths: list[str], stretch: int, encoding: str | None):
        self.names, self.paths, self.stretch, self.encoding = schema.names, paths, stretch, encoding

    def partitions(self) -> list[Records]:
        out = []
        for n, path in enumerate(self.paths):
            at = places(path)
            out += [Records(path, n << 32, k, at[k : k + self.stretch].tolist()) for k in range(0, len(at), self.stretch)]
        return out

    def read(self, part: Records) -> Iterator[pa.RecordBatch]:
        if part is None:  # no records
            return
        attributes = beside(part.path, "dbf")
        table = read_attributes(attributes) if attributes else None
        if table:
            with open(attributes, "rb") as f:
                f.seek(table.begin + part.start * table.width)
                rows = f.read(len(part.at) * table.width)
        numbers, shapes, kept = [], [], []
        with open(part.path, "rb") as f:
            for k, at in enumerate(part.at):
                f.seek(at)
                content = f.read(2 * struct.unpack(">ii", f.read(_INDEXED))[1])
                row = rows[k * table.width : (k + 1) * table.width] if table else b""
                if row[:1] == b"*":  # deleted
                    continue
                numbers.append(part.first + part.start + k)
                shapes.append(parts_of(content))
                kept.append(row)
        columns = [pa.array(numbers, pa.int64()), _nested(shapes)]
        encoding = self.encoding or _encoding(part.path)
        for field in table.fields if table else ():
            columns.append(pa.array([_value(r[field.begin : field.begin + field.size], field.kind, encoding) for r in kept], field.arrow_type))
        yield pa.RecordBatch.from_arrays(columns, names=self.names)


def _encoding(path: str) -> str:
    """What the .cpg file names, else Latin-1 (the table's own default)."""
    at = beside(path, "cpg")
    if not at:
        return "latin-1"
    with open(at, encoding="ascii", errors="ignore") as f:
        return f.read().strip() or "latin-1"


def _nested(shapes: list[list[np.ndarray] | None]) -> pa.Array:
    """Parts as lists of lists of points, without a Python object for each point."""
    rings = [r for s in shapes if s is not None for r in s]
    points = np.concatenate(rings) if rings else np.empty((0, 2))
    flat = pa.StructArray.from_arrays([np.ascontiguousarray(points[:, 0]), np.ascontiguousarray(points[:, 1])], fields=list(_POINT))
    inner = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, rings)]), pa.int32()), flat)
    ends = np.cumsum([0, *(len(s or ()) for s in shapes)])
    empty = np.array([s is None for s in shapes], bool)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), inner, mask=pa.array(empty)) if len(shapes) else pa.array([], pa.list_(pa.list_(_POINT)))


class Shapefile(DataSource):
    """Format ``shapefile``: rows (shape_id, parts, attributes...).

    Options: ``path`` (a .shp file, a pattern, or a folder of them, which every node must see; files of a pattern have
    the same attributes), ``stretch`` (records that a task reads, 1,000), ``encoding`` of the attributes.
    """

    @classmethod
    def name(cls) -> str:
        return "shapefile"

    def _paths(self) -> list[str]:
        path = self.options["path"]
        found = sorted(glob.glob(os.path.join(path, "*.[sS][hH][pP]") if os.path.isdir(path) else path))
        if not found:
            raise FileNotFoundError(path)
        return found

    def schema(self) -> str:
        fields: list[Field] | None = None
        for path in self._paths():
            checked_header(path)
            table = beside(path, "dbf")
            own = read_attributes(table).fields if table else []
            if fields is not None and own != fields:
                raise ValueError(f"{path} has other attributes than the files before it")
            fields = own
        names = [SHAPE_ID, PARTS, *(f.name.lower() for f in fields)]
        if len(set(names)) < len(names):
            raise ValueError(f"attributes clash with each other or with the shape's columns: {names}")
        return ", ".join([f"{SHAPE_ID} bigint", f"{PARTS} {PARTS_TYPE}", *(f"`{f.name}` {f.spark_type}" for f in fields)])

    def reader(self, schema: StructType) -> ShapeReader:
        return ShapeReader(schema, self._paths(), int(self.options.get("stretch", 1000)), self.options.get("encoding"))


def scan_shapes(spark: SparkSession, path: str, stretch: int = 1000, encoding: str | None = None) -> DataFrame:
    """Shapes of a shapefile, pattern or folder, with their attributes; deleted records are left out."""
    spark.dataSource.register(Shapefile)
    read = spark.read.format("shapefile").option("stretch", stretch)
    return (read.option("encoding", encoding) if encoding else read).load(path)
