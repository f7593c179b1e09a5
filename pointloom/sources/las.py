"""LAS 1.2 to 1.4 point files (formats 0 to 3) as a Spark data source, and a writer of format 2.

spark.read.format("las").load(path) splits files into ranges of rows; the option `columns` reads only some of them, which
the fixed records allow without decoding the others. spark.read.format("las_header") reads headers only. Compressed files
(.laz) need a codec that is not here and are refused.
"""

from __future__ import annotations

import os
import struct
from collections.abc import Iterator
from dataclasses import dataclass
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import DoubleType, IntegerType, LongType, ShortType, StructField, StructType

ROWS_PER_SPLIT = 1_000_000
#: Bytes before the colour by point format (time takes eight of them), and which formats have colour.
_BASE = [("X", "<i4"), ("Y", "<i4"), ("Z", "<i4"), ("intensity", "<u2"), ("flags", "u1"), ("classification", "u1"), ("scan_angle_rank", "i1"), ("user_data", "u1"), ("point_source_id", "<u2")]
_TIME, _COLOUR = [("gps_time", "<f8")], [("r", "<u2"), ("g", "<u2"), ("b", "<u2")]
FORMATS = {0: _BASE, 1: _BASE + _TIME, 2: _BASE + _COLOUR, 3: _BASE + _TIME + _COLOUR}
SCHEMA = (
    "point_id long, x double, y double, z double, qx int, qy int, qz int, intensity int, return_number short, number_of_returns short, "
    "classification short, scan_angle_rank short, user_data short, point_source_id int, r int, g int, b int"
)
HEADER_SCHEMA = "name string, legacy_count long, extended_count long, min_x double, min_y double, min_z double, max_x double, max_y double, max_z double, bytes_per_point int"


@dataclass
class Header:
    path: str
    point_format: int
    record: int
    start: int
    legacy: int
    extended: int
    scale: tuple[float, float, float]
    offset: tuple[float, float, float]
    low: tuple[float, float, float]
    high: tuple[float, float, float]

    @property
    def points(self) -> int:
        return max(self.legacy, self.extended)


_TYPES = {"long": LongType(), "double": DoubleType(), "int": IntegerType(), "short": ShortType()}


def _whole_schema() -> StructType:
    return StructType([StructField(n, _TYPES[t]) for n, t in (c.split() for c in SCHEMA.split(", "))])


def read_header(path: str) -> Header:
    suffix = Path(path).suffix.lower()
    if suffix == ".laz":
        raise ValueError(f"{path}: compressed point files are not supported")
    if suffix != ".las":
        raise ValueError(f"{path}: no reader for {suffix or 'files without extension'}")
    with open(path, "rb") as f:
        h = f.read(375)
    if h[:4] != b"LASF" or len(h) < 227:
        raise ValueError(f"{path}: not a point file")
    start, _, kind, record, legacy = struct.unpack_from("<IIBHI", h, 96)
    numbers = struct.unpack_from("<12d", h, 131)
    if kind & 0x80 or kind not in FORMATS:
        raise ValueError(f"{path}: point format {kind} is not supported")
    extended = struct.unpack_from("<Q", h, 247)[0] if h[25] >= 4 and len(h) >= 255 else 0
    box = numbers[6:]
    return Header(path, kind, record, start, legacy, extended, numbers[:3], numbers[3:6], box[1::2], box[0::2])


def _files(path: str) -> list[str]:
    path = path.removeprefix("file:")
    if path.startswith("//"):
        path = path[2:]
    if os.path.isdir(path):
        return sorted(os.path.join(path, f) for f in os.listdir(path) if f.lower().endswith((".las", ".laz")))
    return [path]


@dataclass
class Split(InputPartition):
    header: Header | None
    first: int
    rows: int
    serial: int


class _Reader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict):
        self.schema, self.options = schema, options

    def partitions(self) -> list[Split]:
        out, serial = [], 0
        rows = int(self.options.get("rowspersplit", ROWS_PER_SPLIT))
        for path in _files(self.options["path"]):
            h = read_header(path)
            out += [Split(h, k, min(rows, h.points - k), serial + k) for k in range(0, h.points, rows)]
            serial += h.points
        return out or [Split(None, 0, 0, 0)]

    def read(self, split: Split) -> Iterator[pa.RecordBatch]:
        if not split.rows:
            return
        h = split.header
        kind = np.dtype({"names": [n for n, _ in FORMATS[h.point_format]], "formats": [t for _, t in FORMATS[h.point_format]], "offsets": np.cumsum([0, *(np.dtype(t).itemsize for _, t in FORMATS[h.point_format])])[:-1].tolist(), "itemsize": h.record})
        names = self.schema.names
        for at in range(0, split.rows, 65_536):
            n = min(65_536, split.rows - at)
            raw = np.fromfile(h.path, dtype=kind, count=n, offset=h.start + (split.first + at) * h.record)
            if len(raw) < n:
                raise ValueError(f"{h.path} ends before its last point")
            columns = []
            for name in names:
                k = "xyz".find(name[-1]) if name in ("x", "y", "z", "qx", "qy", "qz") else -1
                if name == "point_id":
                    value = np.arange(split.serial + at, split.serial + at + n)
                elif k >= 0:
                    value = raw["XYZ"[k]]
                    if len(name) == 1:
                        value = value * h.scale[k] + h.offset[k]
                elif name == "return_number":
                    value = raw["flags"] & 7
                elif name == "number_of_returns":
                    value = raw["flags"] >> 3 & 7
                elif name in ("r", "g", "b") and name not in kind.names:
                    value = None
                else:
                    value = raw[name]
                if name == "scan_angle_rank" and self.options.get("compat") == "unsigned_angle":
                    value = value.view(np.uint8)
                columns.append(pa.nulls(n, pa.int32()) if value is None else pa.array(value).cast(_ARROW[self.schema[name].dataType.simpleString()]))
            yield pa.RecordBatch.from_arrays(columns, names=names)


_ARROW = {"bigint": pa.int64(), "double": pa.float64(), "int": pa.int32(), "smallint": pa.int16()}


class LasSource(DataSource):
    """Options: path (a file, or a folder of them), columns, rowsPerSplit, compat=unsigned_angle."""

    @classmethod
    def name(cls) -> str:
        return "las"

    def schema(self) -> StructType:
        whole = _whole_schema()
        wanted = [c.strip() for c in self.options.get("columns", "").split(",") if c.strip()]
        return StructType([whole[c] for c in wanted]) if wanted else whole

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(schema, self.options)


class _HeaderReader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = options

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(p) for p in _files(self.options["path"])]

    def read(self, split: InputPartition) -> Iterator[tuple]:
        h = read_header(split.value)
        yield (Path(h.path).stem, h.legacy, h.extended, *h.low, *h.high, 27 if h.point_format >= 2 else 21)


class LasHeaderSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "las_header"

    def schema(self) -> str:
        return HEADER_SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return _HeaderReader(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(LasSource)
    spark.dataSource.register(LasHeaderSource)


def _packed(points: pa.Table, scale: float) -> np.ndarray:
    """Records of format 2; missing columns are zero, values are cut to their field's range."""
    kind = np.dtype([(n, t) for n, t in FORMATS[2]])
    out = np.zeros(len(points), kind)
    whole = lambda c: np.nan_to_num(points.column(c).to_numpy(zero_copy_only=False).astype(float))
    for c in "XYZ":
        out[c] = np.round(whole(c.lower()) / scale)
    for c, t in FORMATS[2][3:]:
        if c in points.column_names:
            limits = np.iinfo(np.dtype(t))
            out[c] = np.clip(whole(c), limits.min, limits.max)
    if {"return_number", "number_of_returns"} <= set(points.column_names):
        out["flags"] = whole("return_number").astype(int) & 7 | (whole("number_of_returns").astype(int) & 7) << 3
    else:
        out["flags"] = 9
    return out


class _File:
    """One LAS 1.2 file, written batch after batch; the header follows at the end, when counts and box are known."""

    def __init__(self, path: str, scale: float):
        self.path, self.scale, self.n = path, scale, 0
        self.low, self.high = np.full(3, np.inf), np.full(3, -np.inf)
        self.f = open(path, "wb")
        self.f.write(b"\0" * 227)

    def add(self, points: pa.Table) -> None:
        if not len(points):
            return
        out = _packed(points, self.scale)
        stored = np.stack([out[c] * self.scale for c in "XYZ"], axis=1)
        self.low, self.high, self.n = np.minimum(self.low, stored.min(axis=0)), np.maximum(self.high, stored.max(axis=0)), self.n + len(out)
        self.f.write(out.tobytes())

    def close(self) -> None:
        low, high = (self.low, self.high) if self.n else (np.zeros(3), np.zeros(3))
        size, scale = np.dtype([(n, t) for n, t in FORMATS[2]]).itemsize, self.scale
        header = bytearray(227)
        header[:4] = b"LASF"
        header[24:26] = bytes((1, 2))
        struct.pack_into("<H", header, 94, 227)
        struct.pack_into("<IIBHI", header, 96, 227, 0, 2, size, self.n)
        struct.pack_into("<5I", header, 111, self.n, 0, 0, 0, 0)
        struct.pack_into("<12d", header, 131, scale, scale, scale, 0, 0, 0, *(v for k in range(3) for v in (high[k], low[k])))
        self.f.seek(0)
        self.f.write(header)
        self.f.close()


def write_las(points: DataFrame, path: str, scale: float = 0.001) -> int:
    """points (point_id, x, y, z, and any of the further columns) as one LAS 1.2 file of format 2, by point_id.

    A file is one stream of bytes, so rows pass through the driver, a partition at a time; write_las_files has no such limit.
    """
    out = _File(path, scale)
    ordered = points.orderBy("point_id")
    for batch in _batches(ordered):
        out.add(batch)
    out.close()
    return out.n


def _batches(frame: DataFrame) -> Iterator[pa.Table]:
    """Rows 50,000 at a time."""
    held: list = []
    for row in frame.toLocalIterator(prefetchPartitions=True):
        held.append(row.asDict())
        if len(held) == 50_000:
            yield pa.Table.from_pylist(held)
            held = []
    if held:
        yield pa.Table.from_pylist(held)


def write_las_files(points: DataFrame, folder: str, scale: float = 0.001) -> int:
    """points as LAS files in a folder that driver and executors share, one for each partition that has rows; their number
    of points. A task that is run again writes its file anew."""
    place = folder.removeprefix("file:")
    place = place[2:] if place.startswith("//") else place
    os.makedirs(place, exist_ok=True)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        own, n = f"{place}/.part-{task.partitionId():06d}-{task.attemptNumber()}", 0
        out = None
        for b in batches:
            if b.num_rows:
                out = out or _File(own, scale)
                out.add(pa.Table.from_batches([b]))
        if out:
            out.close()
            n = out.n
            os.replace(own, f"{place}/part-{task.partitionId():06d}.las")
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], names=["points"])

    return points.mapInArrow(write, "points long").agg(F.coalesce(F.sum("points"), F.lit(0))).first()[0]


def union_sources(frames: list[DataFrame]) -> DataFrame:
    """All rows of several sources; their columns must be the same set, the first one's order holds."""
    first = frames[0]
    for other in frames[1:]:
        if set(other.columns) != set(first.columns):
            raise ValueError(f"sources differ in columns: {sorted(set(first.columns) ^ set(other.columns))}")
    out = first
    for other in frames[1:]:
        out = out.unionByName(other)
    return out
