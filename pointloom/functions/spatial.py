"""Cells, Morton codes and octree paths as column expressions, relative to a cube (low corner and edge)."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

LEVELS = 21
AXES = ("x", "y", "z")


@dataclass(frozen=True)
class Cube:
    """Anchored at the low corner of the points, as large as their longest side."""

    x: float
    y: float
    z: float
    edge: float

    @staticmethod
    def around(points: DataFrame) -> Cube:
        """One aggregate over x, y, z; an empty table gives an empty cube at the origin."""
        r = points.agg(*[f(c).alias(f"{n}{c}") for c in AXES for n, f in (("low", F.min), ("high", F.max))]).first()
        if r["lowx"] is None:
            return Cube(0.0, 0.0, 0.0, 0.0)
        return Cube(r["lowx"], r["lowy"], r["lowz"], max(r[f"high{c}"] - r[f"low{c}"] for c in AXES))

    def low(self, axis: str) -> float:
        return getattr(self, axis)


def share(value: Column, low: float, edge: float, cells: int) -> Column:
    """The share of the edge times cells; in an empty edge how far the value is from it."""
    return value - F.lit(low) if edge == 0 else (value - F.lit(low)) / F.lit(edge) * F.lit(float(cells))


def cell(value: Column, low: float, edge: float, cells: int) -> Column:
    """floor of the share of the edge times cells, within 0 and cells - 1; everything is cell 0 of an empty edge."""
    if edge == 0:
        return F.lit(0).cast("long")
    return F.least(F.greatest(F.floor(share(value, low, edge, cells)), F.lit(0)), F.lit(cells - 1)).cast("long")


def cell_index(cube: Cube, cells: int) -> Column:
    x, y, z = (cell(F.col(a), cube.low(a), cube.edge, cells) for a in AXES)
    return x + y * cells + z * cells * cells


def _spread(v: Column) -> Column:
    """The low 21 bits of v, two zero bits after each."""
    for shift, mask in ((32, 0x1F00000000FFFF), (16, 0x1F0000FF0000FF), (8, 0x100F00F00F00F00F), (4, 0x10C30C30C30C30C3), (2, 0x1249249249249249)):
        v = v.bitwiseOR(F.shiftleft(v, shift)).bitwiseAND(F.lit(mask))
    return v


def morton(x: Column, y: Column, z: Column) -> Column:
    """63-bit code of three cell numbers, x most significant; its octal digits are the octree path."""
    return F.shiftleft(_spread(x), 2).bitwiseOR(F.shiftleft(_spread(y), 1)).bitwiseOR(_spread(z))


def morton_of(cube: Cube) -> Column:
    return morton(*(cell(F.col(a), cube.low(a), cube.edge, 1 << LEVELS) for a in AXES))


def path(code: Column, level: Column | int) -> Column:
    """Node name: r and the first `level` octal digits of the code."""
    digits = F.lpad(F.conv(code.cast("string"), 10, 8), LEVELS, "0")
    return F.concat(F.lit("r"), F.substring(digits, F.lit(1), F.lit(level) if isinstance(level, int) else level.cast("int")))


def code_of(name: str) -> Column:
    """The digits of a node's name as a number."""
    return F.conv(F.concat(F.lit("0"), F.substring(F.col(name), F.lit(2), F.lit(LEVELS))), 8, 10).cast("long")


def octant(x: Column, y: Column, z: Column, centre: Sequence[Column | float]) -> Column:
    """Digit 4 X + 2 Y + Z of the child that holds a point; the middle belongs to the upper half."""
    bits = [(v >= c).cast("int") for v, c in zip((x, y, z), centre, strict=True)]
    return bits[0] * 4 + bits[1] * 2 + bits[2]


def shared_levels(a: Column, b: Column) -> Column:
    """Number of leading octal digits that two codes share."""
    differ = a.bitwiseXOR(b)
    return F.when(differ == 0, F.lit(LEVELS)).otherwise(F.lit(LEVELS) - F.length(F.conv(differ.cast("string"), 10, 8)))


def box_of(name: str, cube: Cube) -> list[Column]:
    """low x, y, z and edge of the node whose name is in a column."""
    edge = F.lit(cube.edge) / F.pow(F.lit(2.0), F.length(name) - 1)

    def steps(bit: int) -> Column:
        """The cell's number along an axis: one bit of each digit."""
        return F.expr(f"aggregate(slice(split({name}, ''), 2, {LEVELS}), 0L, (s, d) -> s * 2 + (shiftright(cast(d as int), {bit}) & 1))")

    return [*[F.lit(cube.low(axis)) + steps(bit) * edge for axis, bit in zip(AXES, (2, 1, 0), strict=True)], edge]


def ancestors(name: str, proper: bool = False) -> Column:
    """Array of the names from the root down to the node (or to its parent)."""
    last = f"length({name}) - 1" if proper else f"length({name})"
    return F.expr(f"case when {last} < 1 then array() else transform(sequence(1, greatest({last}, 1)), i -> substring({name}, 1, i)) end")
