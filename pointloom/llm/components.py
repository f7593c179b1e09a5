"""Connected components by large-star / small-star steps on an edge table; nothing is gathered in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ._spark import Scratch


def connected_components(edges: DataFrame, scratch: Scratch, name: str = "cc", most_rounds: int = 60) -> DataFrame:
    """edges (u long, v long), any order, repeats and loops allowed -> (id, component): the smallest id reachable.

    Only ids that have an edge to another id are returned; no edges give an empty table.
    Every round is written to the shared folder; groups are only ever reduced with min(), which combines before
    the shuffle.
    """
    state = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    state = scratch.keep(state, f"{name}0")
    for k in range(1, most_rounds + 1):
        both = state.union(state.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u"), F.col("m").alias("v")))).alias("e")).select("e.*").where("u <> v").distinct()
        state = scratch.keep(small, f"{name}{k}")
        scratch.drop(f"{name}{k - 1}")
        # Done when the edges are stars: every id has one edge down, and to an id without one.
        ends = state.select(F.col("u").alias("x"), F.lit(1).alias("down"), F.lit(0).alias("up")).union(state.select("v", F.lit(0), F.lit(1)))
        open_ids = ends.groupBy("x").agg(F.sum("down").alias("down"), F.max("up").alias("up")).where("down > 1 or (down = 1 and up = 1)")
        if open_ids.isEmpty():
            break
    else:
        raise RuntimeError("connected components did not settle")
    return state.groupBy("u").agg(F.min("v").alias("component")).select(F.col("u").alias("id"), "component").union(state.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
