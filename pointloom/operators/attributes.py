"""What a dataset does with each attribute, found by the attribute's name; names without a handler of their own are scalars."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import codec
from ..functions.codec import Attribute
from . import stats


@dataclass(frozen=True)
class Handler:
    """Encodes, decodes, summarises and picks the columns of one attribute; subclass and register() for other behaviour."""

    components: tuple[str, ...] = ()
    bins: int = 0

    def columns(self, name: str) -> tuple[str, ...]:
        return self.components or (name,)

    def encode(self, name: str, target: Attribute, source: Attribute | None = None) -> list[Column]:
        """The columns in the layout of `target`; from raw values where `source` is given."""
        return [(codec.recode(F.col(c), source, target) if source else codec.encode(F.col(c).cast("double"), target)).alias(c) for c in self.columns(name)]

    def decode(self, name: str, source: Attribute) -> list[Column]:
        return [codec.decode(F.col(c), source).alias(c) for c in self.columns(name)]

    def statistics(self, points: DataFrame, name: str) -> DataFrame:
        """(attribute, component, min_value, max_value, histogram): the histogram only where the handler has bins."""
        own = self.columns(name)
        ranges = stats.attribute_ranges(points, list(own)).select(F.lit(name).alias("attribute"), F.col("attribute").alias("component"), "min_value", "max_value")
        none = F.lit(None)
        if not self.bins:
            return ranges.withColumn("histogram", none.cast("array<bigint>"))
        counts = stats.class_histogram(points, own[0], self.bins).select(F.lit(name).alias("attribute"), F.lit(own[0]).alias("component"), none.cast("double").alias("min_value"), none.cast("double").alias("max_value"), "histogram")
        both = ranges.withColumn("histogram", none.cast("array<bigint>")).union(counts)
        return both.groupBy("attribute", "component").agg(*[F.max(c).alias(c) for c in ("min_value", "max_value", "histogram")])

    def picked(self, rows: DataFrame, name: str, by: Column | str, *keys: str) -> DataFrame:
        """Of each group the attribute of one row, the first by `by`."""
        own = self.columns(name)
        return rows.groupBy(*keys).agg(F.min_by(F.struct(*own), by).alias("v")).select(*keys, *[F.col(f"v.{c}").alias(c) for c in own])


SCALAR = Handler()
HANDLERS: dict[str, Handler] = {"position": Handler(("x", "y", "z")), "rgb": Handler(("r", "g", "b")), "classification": Handler(bins=256)}


def register(name: str, handler: Handler) -> None:
    HANDLERS[name] = handler


def handler_of(name: str) -> Handler:
    return HANDLERS.get(name, SCALAR)


def attributes_of(points: DataFrame) -> list[str]:
    """Names of the attributes that a table of points has: those of all registered components, and numeric columns."""
    have = set(points.columns)
    whole = [n for n, h in HANDLERS.items() if set(h.columns(n)) <= have]
    taken = {c for n in whole for c in handler_of(n).columns(n)} | {"point_id"}
    numeric = ("double", "float", "int", "bigint", "smallint", "tinyint")
    return whole + [c for c, t in points.dtypes if t in numeric and c not in taken]


def statistics(points: DataFrame, names: list[str]) -> DataFrame:
    out = None
    for n in names:
        own = handler_of(n).statistics(points, n)
        out = own if out is None else out.union(own)
    if out is None:
        raise ValueError("no attributes")
    return out
