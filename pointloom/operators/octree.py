"""Chunk plan, leaf plan and node table; closed forms instead of level-by-level merging.

A cell's chunk is its shallowest ancestor with at most `cap` points, or the finest cell. Leaves are found the same way from
counts of cells below the chunks, and only where these cells are too full from the counts of whole codes, so that the work
does not depend on the cap and no key gathers points in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions import spatial
from ..functions.spatial import LEVELS, Cube
from .scratch import keep


def with_codes(points: DataFrame, cube: Cube) -> DataFrame:
    return points.withColumn("morton", spatial.morton_of(cube))


def prefix(code: Column | str, level: int, of: int = LEVELS) -> Column:
    return F.shiftright(code, 3 * (of - level))


def chunk_plan(coded: DataFrame, grid_level: int, cap: int) -> DataFrame:
    """(finest, chunk, level, num_points): the chunk of each occupied finest cell, as a code of `grid_level` digits.

    Cells are counted first and only cells are taken through the levels.
    """
    cells = coded.groupBy(prefix("morton", grid_level).alias("finest")).agg(F.count("*").alias("n"))
    levels = cells.select("finest", "n", F.explode(F.sequence(F.lit(0), F.lit(grid_level))).alias("level"))
    levels = levels.withColumn("above", F.expr(f"shiftright(finest, 3 * ({grid_level} - level))"))
    totals = levels.groupBy("level", "above").agg(F.sum("n").alias("total"))
    fits = levels.join(totals, ["level", "above"]).where((F.col("total") <= cap) | (F.col("level") == grid_level))
    best = fits.groupBy("finest").agg(F.min(F.struct("level", "above", "total")).alias("b"))
    return best.select("finest", F.col("b.above").alias("chunk"), F.col("b.level").alias("level"), F.col("b.total").alias("num_points"))


def chunk_name(chunk: Column, level: Column) -> Column:
    """Path of a chunk given as the first `level` digits of its code."""
    digits = F.lpad(F.conv(chunk.cast("string"), 10, 8), 32, "0")
    return F.concat(F.lit("r"), F.substring(digits, F.lit(33) - level.cast("int"), level.cast("int")))


def with_chunks(coded: DataFrame, plan: DataFrame, grid_level: int) -> DataFrame:
    """Every point with its chunk; the plan has a row for each occupied cell, which Spark broadcasts while it is small."""
    own = plan.select("finest", chunk_name(F.col("chunk"), F.col("level")).alias("chunk"), F.col("level").alias("chunk_level"))
    return coded.withColumn("finest", prefix("morton", grid_level)).join(own, "finest").drop("finest")


#: Levels below the deepest chunk that are counted first: a chunk of ten million points has leaves of 4,096 by then even
#: where the points are a surface.
BELOW = 7


def _fitting(counts: DataFrame, digits: int, first: Column, cap: int) -> DataFrame:
    """counts (cell of `digits` digits, chunk_level, n) with leaf_level: the first level from `first` to `digits` on which
    the cell's ancestor holds at most `cap` points, or the last allowed one; null where there is none."""
    limit = F.least(F.col("chunk_level") + 20, F.lit(LEVELS))
    levels = counts.withColumn("level", F.explode(F.sequence(first.cast("int"), F.least(limit, F.lit(digits)).cast("int"))))
    levels = levels.withColumn("above", F.expr(f"shiftright(cell, 3 * ({digits} - level))"))
    totals = levels.groupBy("level", "above").agg(F.sum("n").alias("total"))
    ok = (F.col("total") <= cap) | (F.col("level") == limit)
    return levels.join(totals, ["level", "above"]).groupBy("cell").agg(F.min(F.when(ok, F.col("level"))).alias("leaf_level"))


def with_leaves(chunked: DataFrame, cap: int, digits: int | None = None) -> DataFrame:
    """chunked (point_id, morton, chunk, chunk_level) with leaf_level: chunk_level at least, chunk_level + 20 or 21 at most.

    digits: the level of the cells that are counted first; by default BELOW levels under the deepest chunk.
    """
    if digits is None:
        deepest = chunked.agg(F.max("chunk_level")).first()[0]
        digits = min(LEVELS, (deepest or 0) + BELOW)
    cell = prefix("morton", digits)
    counts = chunked.groupBy(cell.alias("cell"), "chunk_level").agg(F.count("*").alias("n"))
    found = keep(_fitting(counts, digits, F.col("chunk_level"), cap), "cells")
    out = chunked.withColumn("cell", cell).join(found, "cell").drop("cell")
    full = found.where("leaf_level is null").select("cell")
    if digits < LEVELS and not full.isEmpty():
        codes = chunked.withColumn("cell", cell).join(full, "cell", "left_semi").groupBy(F.col("morton").alias("cell"), "chunk_level").agg(F.count("*").alias("n"))
        deep = _fitting(codes, LEVELS, F.greatest(F.col("chunk_level"), F.lit(digits + 1)), cap).toDF("morton", "deep_level")
        out = out.join(deep, "morton", "left").withColumn("leaf_level", F.coalesce("leaf_level", "deep_level")).drop("deep_level")
    return out.select(*chunked.columns, F.col("leaf_level").cast("int").alias("leaf_level"))


def merge_tasks(roots: DataFrame, most: int = 5_000_000) -> DataFrame:
    """roots (chunk, num_points) with `task`: the shallowest proper ancestor that holds fewer than `most` points of all
    roots, or the chunk itself where there is none. Tasks are disjoint subtrees, each of bounded size."""
    above = roots.select("chunk", "num_points", F.explode(spatial.ancestors("chunk", proper=True)).alias("node"))
    totals = above.groupBy("node").agg(F.sum("num_points").alias("total"))
    small = above.join(totals.where(F.col("total") < most), "node").groupBy("chunk").agg(F.min_by("node", F.length("node")).alias("task"))
    return roots.join(small, "chunk", "left").withColumn("task", F.coalesce("task", "chunk"))


def leaves(leafed: DataFrame) -> DataFrame:
    """(node, level, num_points) of the leaves."""
    return leafed.groupBy(spatial.path(F.col("morton"), F.col("leaf_level")).alias("node"), F.col("leaf_level").alias("level")).agg(F.count("*").alias("num_points"))


def nodes(leaf: DataFrame) -> DataFrame:
    """(node, level, is_leaf, subtree_points) of all leaves and their ancestors."""
    every = leaf.select(F.explode(spatial.ancestors("node")).alias("name"), "node", "num_points")
    return every.groupBy(F.col("name").alias("node")).agg(F.max((F.col("name") == F.col("node")).cast("int")).alias("is_leaf"), F.sum("num_points").alias("subtree_points")).select("node", (F.length("node") - 1).alias("level"), "is_leaf", "subtree_points")


def skeleton(names: DataFrame, column: str = "chunk") -> DataFrame:
    """(node) of the given names and all their ancestors."""
    return names.select(F.explode(spatial.ancestors(column)).alias("node")).distinct()


def child_masks(names: DataFrame) -> DataFrame:
    """(node, child_mask): the bits of the children that exist; 0 for leaves. Children without points of their own count."""
    below = names.where("length(node) > 1").select(F.expr("substring(node, 1, length(node) - 1)").alias("node"), F.expr("shiftleft(1, cast(right(node, 1) as int))").alias("bit"))
    masks = below.groupBy("node").agg(F.bit_or("bit").alias("child_mask"))
    return names.select("node").join(masks, "node", "left").select("node", F.coalesce("child_mask", F.lit(0)).alias("child_mask"))


def tight_boxes(owned: DataFrame) -> DataFrame:
    """(node, num_points, min and max of x, y, z) over the points that a node owns."""
    return owned.groupBy("node").agg(F.count("*").alias("num_points"), *[f(a).alias(f"{k}_{a}") for a in spatial.AXES for k, f in (("min", F.min), ("max", F.max))])


def breadth_first(names: DataFrame) -> DataFrame:
    """(node, batch, position): position in the order by length, then name, within each batch of nodes.

    A batch is the first step + 1 characters of the path, so numbering needs no global sort.
    """
    order = W.partitionBy("batch").orderBy(F.length("node"), "node")
    return names.withColumn("position", F.row_number().over(order))
