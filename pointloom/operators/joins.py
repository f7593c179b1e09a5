"""Spatial joins as equi-joins on buckets: radius, nearest neighbours, point location, spheres and boxes."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions import spatial
from ..functions.spatial import AXES, LEVELS, Cube
from .scratch import delete, folder, keep


def squared_distance(a: str = "", b: str = "q_") -> Column:
    return sum(((F.col(f"{a}{x}") - F.col(f"{b}{x}")) ** 2 for x in AXES), F.lit(0.0))


def _buckets(frame: DataFrame, p: str, size: float, around: bool) -> DataFrame:
    out = frame
    for a in AXES:
        own = F.floor(F.col(f"{p}{a}") / size)
        out = out.withColumn(f"b{a}", F.explode(F.array(own - 1, own, own + 1)) if around else own)
    return out


def radius_join(points: DataFrame, queries: DataFrame, radius: float, *same: str) -> DataFrame:
    """queries (query_id, q_x, q_y, q_z) with the points (point_id, x, y, z) at most `radius` away, and d2.

    Queries are put in the 27 buckets around them; points only in their own. Both sides of a pair agree in the columns
    `same`. A radius of 0 or less gives no pairs.
    """
    if radius <= 0:
        return queries.drop(*same).limit(0).join(points.limit(0), F.lit(False)).withColumn("d2", squared_distance())
    keys = [f"b{a}" for a in AXES]
    pairs = _buckets(points, "", radius, False).join(_buckets(queries, "q_", radius, True), [*same, *keys]).drop(*keys)
    return pairs.withColumn("d2", squared_distance()).where(F.col("d2") <= radius * radius)


def _cells(frame: DataFrame, p: str, low: Cube, size: Column, around: bool) -> DataFrame:
    out = frame
    for a in AXES:
        own = F.floor((F.col(f"{p}{a}") - low.low(a)) / size)
        out = out.withColumn(f"b{a}", F.explode(F.array(own - 1, own, own + 1)) if around else own)
    return out


def nearest(points: DataFrame, queries: DataFrame, k: int, cube: Cube | None = None) -> DataFrame:
    """(query_id, point_id, d2, rank) of the k nearest points, ties by point_id.

    Two joins, no loop: cells are counted on all levels; the deepest cell about a query that holds k points gives a distance
    within which k points are, and the buckets of that size around the query hold all that can be nearer. So buckets are
    small where points are dense, and each query meets points of its own level only.
    """
    cube = cube or Cube.around(points)
    n = points.count()
    k = min(k, n)
    if k == 0:
        return queries.limit(0).join(points.limit(0), F.lit(False)).select("query_id", "point_id", squared_distance().alias("d2"), F.lit(0).alias("rank"))
    edge = cube.edge or 1.0
    deepest = min(LEVELS, math.ceil(math.log2(max(n / k, 1)) / 2) + 2)  # enough levels for a surface
    points, queries = points.select("point_id", *AXES), queries.select("query_id", *[f"q_{a}" for a in AXES])
    keys = ["level", *[f"b{a}" for a in AXES]]
    size = F.lit(edge) / F.pow(F.lit(2.0), F.col("level"))
    inside = {f"c_{a}": F.least(F.greatest(F.col(f"q_{a}"), F.lit(cube.low(a))), F.lit(cube.low(a) + cube.edge)) for a in AXES}

    def on_levels(frame: DataFrame, levels: list[int]) -> DataFrame:
        return frame.withColumn("level", F.explode(F.array(*[F.lit(v) for v in levels])))

    def levels_of(frame: DataFrame) -> list[int]:
        return sorted(r[0] for r in frame.select("level").where("level is not null").distinct().collect()) or [0]  # few

    every = list(range(deepest + 1))
    full = _cells(on_levels(points, every), "", cube, size, False).groupBy(*keys).agg(F.count("*").alias("n")).where(f"n >= {k}").select(*keys)
    homes = _cells(on_levels(queries.withColumns(inside), every), "c_", cube, size, False).join(full, keys, "left_semi").groupBy("query_id").agg(F.max("level").alias("level"))
    homes = keep(queries.withColumns(inside).join(homes, "query_id", "left"), "homes")
    order = W.partitionBy("query_id").orderBy("d2", "point_id")
    met = _cells(homes, "c_", cube, size, False).join(_cells(on_levels(points, levels_of(homes)), "", cube, size, False), keys).withColumn("d2", squared_distance())
    bound = met.withColumn("rank", F.row_number().over(order)).where(f"rank = {k}").select("query_id", F.col("d2").alias("bound"))
    # Far-end points have cells of their own, so a query may be without a home; all points are within the farthest corner.
    corner = sum((F.greatest(F.abs(F.col(f"q_{a}") - cube.low(a)), F.abs(F.col(f"q_{a}") - (cube.low(a) + cube.edge))) ** 2 for a in AXES), F.lit(0.0))
    asked = queries.join(bound, "query_id", "left").withColumn("bound", F.coalesce("bound", corner) * (1 + 1e-9))
    fitting = F.floor(F.log2(F.lit(edge) / F.greatest(F.sqrt("bound") * (1 + 1e-9), F.lit(edge * 2.0**-LEVELS))))
    asked = keep(asked.withColumn("level", F.least(fitting, F.lit(LEVELS)).cast("int")), "asked")
    hits = _cells(asked, "q_", cube, size, True).join(_cells(on_levels(points, levels_of(asked)), "", cube, size, False), keys)
    hits = hits.withColumn("d2", squared_distance()).where("d2 <= bound")
    return hits.withColumn("rank", F.row_number().over(order)).where(f"rank <= {k}").select("query_id", "point_id", "d2", "rank")


def in_box(points: DataFrame, low: tuple[float, float, float], high: tuple[float, float, float]) -> DataFrame:
    """Points within a box, both ends included."""
    for a, lo, hi in zip(AXES, low, high, strict=True):
        points = points.where(F.col(a).between(lo, hi))
    return points


def boxes_near(boxes: DataFrame, centre: tuple[float, float, float], radius: float) -> DataFrame:
    """Boxes (min_x .. max_z) whose nearest point is at most `radius` from the centre."""
    out = [F.greatest(F.col(f"min_{a}") - c, F.lit(c) - F.col(f"max_{a}"), F.lit(0.0)) for a, c in zip(AXES, centre, strict=True)]
    return boxes.where(sum((d * d for d in out), F.lit(0.0)) <= radius * radius)


def locate(points: DataFrame, names: DataFrame, cube: Cube, boundary: str = "upper") -> DataFrame:
    """(point_id, node, level): the deepest existing node that holds each point, probed on the levels that occur.

    boundary: "upper" gives what is on a middle to the upper half, as everywhere else. "lower" descends from the root to the
    first child in digit order that exists and whose closed cube holds the point, which is the lower half on a middle.
    "closed" descends to the last such child, which is the upper half where that exists and else the lower one; a point
    outside the cube is taken as on its side.
    """
    names = keep(names, "names")
    levels = sorted(r[0] for r in names.select(F.length("node") - 1).distinct().collect())  # 22 at most
    if boundary in ("lower", "closed"):
        return _descended(points, names, cube, levels, boundary == "closed")
    code = points.select("point_id", spatial.morton_of(cube).alias("morton"))
    every = code.select("point_id", "morton", F.explode(F.array(*[F.lit(k) for k in levels]) if levels else F.expr("cast(array() as array<int>)")).alias("level"))
    every = every.select("point_id", "level", F.expr(f"shiftright(morton, 3 * ({LEVELS} - level))").alias("code"))
    known = names.select((F.length("node") - 1).alias("level"), spatial.code_of("node").alias("code"), "node")
    found = every.join(known, ["level", "code"]).groupBy("point_id").agg(F.max_by("node", "level").alias("node"), F.max("level").alias("level"))
    return found


def _descended(points: DataFrame, names: DataFrame, cube: Cube, levels: list[int], last: bool) -> DataFrame:
    """One level at a time: the eight children that exist, of which the first (or last) that holds the point is taken.

    Places are in cells of the deepest level, computed as for codes, so that no rounding puts a point outside the cube of
    its own code; halving a cube is exact in them.
    """
    below = names.where("length(node) > 1").select(F.expr("substring(node, 1, length(node) - 1)").alias("node"), F.right("node", F.lit(1)).cast("int").alias("digit"))
    below = below.groupBy("node").agg(F.sort_array(F.collect_list("digit"), asc=not last).alias("digits"))  # eight at most
    cells = 1 << LEVELS

    def place(a: str) -> Column:
        at = spatial.share(F.col(a), cube.low(a), cube.edge, cells)
        return F.least(F.greatest(at, F.lit(0.0)), F.lit(float(cells))) if last else at

    root = F.lit(0).cast("long")
    at = points.select("point_id", *[place(a).alias(a) for a in AXES], *[root.alias(f"l{a}") for a in AXES], F.lit("r").alias("node")).join(names.where("node = 'r'"), "node", "left_semi")
    before = None
    half = F.expr(f"shiftleft(1L, greatest({LEVELS} - length(node), 0))")  # of the point's own node, which may be higher than the others'
    for _ in levels[1:]:
        at = at.join(below, "node", "left")
        low = {a: F.col(f"l{a}") + half * F.shiftright(F.col("child"), bit).bitwiseAND(F.lit(1)) for a, bit in zip(AXES, (2, 1, 0), strict=True)}

        def holds(d: Column) -> Column:
            out = F.lit(True)
            for a, bit in zip(AXES, (2, 1, 0), strict=True):
                start = F.col(f"l{a}") + half * F.shiftright(d, bit).bitwiseAND(F.lit(1))
                out = out & F.col(a).between(start, start + half)
            return out

        at = at.withColumn("child", F.try_element_at(F.filter(F.coalesce("digits", F.expr("cast(array() as array<int>)")), holds), F.lit(1)))
        at = at.select("point_id", *AXES, *[F.coalesce(low[a], F.col(f"l{a}")).alias(f"l{a}") for a in AXES], F.concat("node", F.coalesce(F.col("child").cast("string"), F.lit(""))).alias("node"))
        spark, path = at.sparkSession, folder(at.sparkSession)
        at = keep(at, "descended", path)
        if before:
            delete(spark, before)
        before = path
    return at.select("point_id", "node", (F.length("node") - 1).alias("level"))
