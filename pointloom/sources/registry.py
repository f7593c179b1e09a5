"""Readers of point files by extension, and loaders of a selection's points by name; both can be extended."""

from __future__ import annotations

from collections.abc import Callable
from pathlib import PurePosixPath

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import interchange, las, rooms

Reader = Callable[[SparkSession, str, dict], DataFrame]
Loader = Callable[[DataFrame, object], DataFrame]


def _las(spark: SparkSession, path: str, options: dict) -> DataFrame:
    las.register(spark)
    return spark.read.format("las").options(**options).load(path)


READERS: dict[str, Reader] = {
    ".las": _las,
    ".laz": _las,  # raises: compressed files have no decoder here
    ".txt": lambda spark, path, options: rooms.parse_lines(spark.read.text(path)),
    ".parquet": lambda spark, path, options: spark.read.options(**options).parquet(path),
}


def register_reader(extension: str, reader: Reader) -> None:
    READERS[extension.lower()] = reader


def read_points(spark: SparkSession, path: str, **options: str) -> DataFrame:
    """Points of a file by its extension in lower case; ValueError where no reader is known for it."""
    extension = PurePosixPath(path).suffix.lower()
    if extension not in READERS:
        raise ValueError(f"{path}: no reader for {extension or 'files without extension'}")
    return READERS[extension](spark, path, options)


def has_extension(path: str, extension: str | None):
    """Column: whether the last part of a path has the extension, whatever the case; any path has an empty one."""
    if not extension:
        return F.lit(True)
    return F.lower(F.regexp_extract(path, r"[^/](\.[^./]*)$", 1)) == extension.lower()


#: Selected nodes and where their points are -> points. "dataset": a table of points with `node`; "exchange": a folder.
LOADERS: dict[str, Loader] = {
    "dataset": lambda nodes, points: points.join(nodes.select("node"), "node", "left_semi"),
    "exchange": lambda nodes, folder: interchange.read_points(nodes, folder),
}


def load(nodes: DataFrame, where, loader: str = "dataset") -> DataFrame:
    return LOADERS[loader](nodes, where)
