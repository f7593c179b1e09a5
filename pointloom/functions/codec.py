"""Attribute codec: raw * scale + offset, and back by truncation towards zero within the type's range."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, functions as F

#: The numeric types, their Spark types (one step wider where unsigned) and ranges.
TYPES = {
    "int8": ("byte", -(2**7), 2**7 - 1),
    "int16": ("short", -(2**15), 2**15 - 1),
    "int32": ("int", -(2**31), 2**31 - 1),
    "int64": ("long", -(2**63), 2**63 - 1),
    "uint8": ("short", 0, 2**8 - 1),
    "uint16": ("int", 0, 2**16 - 1),
    "uint32": ("long", 0, 2**32 - 1),
    "uint64": ("decimal(20,0)", 0, 2**64 - 1),
    "float": ("float", None, None),
    "double": ("double", None, None),
}


@dataclass(frozen=True)
class Attribute:
    name: str
    type: str = "int32"
    scale: float = 1.0
    offset: float = 0.0

    def __post_init__(self):
        if self.type not in TYPES:
            raise ValueError(f"unknown attribute type {self.type!r}")


def decode(raw: Column, a: Attribute) -> Column:
    return raw * F.lit(a.scale) + F.lit(a.offset)


def clamped(value: Column, type_: str) -> Column:
    """value cut to the range of the type before the cast, which then truncates; NaN is 0."""
    spark_type, low, high = TYPES[type_]
    if low is None:
        return value.cast(spark_type)
    if type_ in ("int64", "uint64"):
        exact = lambda v: F.lit(str(v)).cast("decimal(20,0)")  # noqa: E731  doubles do not hold the ends
        whole = F.when(value >= float(high), exact(high)).when(value <= float(low), exact(low)).otherwise(value.cast("decimal(20,0)"))
        return F.when(F.isnan(value), exact(0)).otherwise(whole).cast(spark_type)
    return F.when(F.isnan(value), 0).otherwise(F.least(F.greatest(value, F.lit(float(low))), F.lit(float(high)))).cast(spark_type)


def encode(value: Column, a: Attribute) -> Column:
    moved = value - F.lit(a.offset)
    return clamped(moved / F.lit(a.scale) if a.scale else moved, a.type)


def recode(raw: Column, source: Attribute, target: Attribute) -> Column:
    """raw of one layout in another; equal layouts pass the bare column, without arithmetic."""
    if (source.type, source.scale, source.offset) == (target.type, target.scale, target.offset):
        return raw
    return encode(decode(raw, source), target)


def colour_share(c: Column) -> Column:
    """0 to 1 of a 16-bit colour, light grey where there is none."""
    return F.coalesce(c / 65535.0, F.lit(0.8))


def colour_8_to_16(c: Column) -> Column:
    return F.least(F.greatest(c, F.lit(0)), F.lit(255)) * 257


def thousands(n: Column) -> Column:
    return F.format_number(n, 0)


def slug(name: Column) -> Column:
    """Letters, digits, - and _ of a name, spaces as _, at most 64 characters, `project` where nothing is left."""
    kept = F.regexp_replace(F.regexp_replace(name, "[^A-Za-z0-9_ -]", ""), " ", "_")
    return F.substring(F.coalesce(F.nullif(kept, F.lit("")), F.lit("project")), 1, 64)
