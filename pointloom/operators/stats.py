"""Bounds, counts and attribute statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import spatial


def cube_bounds(points: DataFrame) -> DataFrame:
    """One row: low corner of the cube and its edge."""
    low = [F.min(a).alias(f"min_{a}") for a in spatial.AXES]
    edge = F.greatest(*[F.max(a) - F.min(a) for a in spatial.AXES]).alias("edge")
    return points.agg(*low, edge)


def total_points(headers: DataFrame) -> DataFrame:
    """headers (legacy_count, extended_count): the sum of the larger count of each source."""
    return headers.agg(F.coalesce(F.sum(F.greatest("legacy_count", "extended_count")), F.lit(0)).cast("long").alias("points"))


def grid_counts(points: DataFrame, cube: spatial.Cube, cells: int) -> DataFrame:
    """Points of each cell that has any; sparse, counted before the shuffle."""
    return points.groupBy(spatial.cell_index(cube, cells).alias("cell")).agg(F.count("*").alias("num_points"))


def attribute_ranges(points: DataFrame, names: list[str]) -> DataFrame:
    """(attribute, min_value, max_value), all attributes in one pass."""
    row = points.agg(*[f(n).cast("double").alias(f"{k}_{n}") for n in names for k, f in (("min", F.min), ("max", F.max))])
    parts = ", ".join(f"'{n}', `min_{n}`, `max_{n}`" for n in names)
    return row.selectExpr(f"stack({len(names)}, {parts}) as (attribute, min_value, max_value)")


def class_histogram(points: DataFrame, column: str = "classification", bins: int = 256) -> DataFrame:
    """One row: the counts of all bins as an array, values clamped to the bins."""
    inside = F.least(F.greatest(F.col(column).cast("long"), F.lit(0)), F.lit(bins - 1))
    counts = points.where(F.col(column).isNotNull()).groupBy(inside.alias("bin")).agg(F.count("*").alias("n"))
    whole = counts.agg(F.map_from_entries(F.collect_list(F.struct("bin", "n"))).alias("m"))  # bins entries at most
    return whole.select(F.transform(F.sequence(F.lit(0).cast("long"), F.lit(bins - 1).cast("long")), lambda i: F.coalesce(F.col("m")[i], F.lit(0).cast("long"))).alias("histogram"))


def plane_moments(groups: DataFrame, *keys: str, box: bool = False) -> DataFrame:
    """n, centroid and covariances of x, y, z by group; with `box` also min and max of each."""
    pairs = (("x", "x"), ("x", "y"), ("x", "z"), ("y", "y"), ("y", "z"), ("z", "z"))
    return groups.groupBy(*keys).agg(F.count("*").alias("n"), *[F.avg(a).alias(f"c{a}") for a in "xyz"], *[F.covar_pop(a, b).alias(f"{a}{b}") for a, b in pairs], *[f(a).alias(f"{k}_{a}") for a in "xyz" if box for k, f in (("min", F.min), ("max", F.max))])
