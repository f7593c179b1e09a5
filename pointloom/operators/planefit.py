"""Least-squares planes by group: moments in Spark, the smallest eigenvector in closed form."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from .scratch import keep
from .stats import plane_moments


def fit_planes(groups: DataFrame, *keys: str, least: int = 3) -> DataFrame:
    """groups (keys, x, y, z) -> keys, n, cx, cy, cz, nx, ny, nz, off_plane (mean squared distance); groups of fewer than `least` points give none.

    The normal's component of largest size is positive. Points alike in all directions give (1, 0, 0); on a line, where
    every normal across it is as good, one across its largest component is taken.
    """
    return _planes(plane_moments(groups, *keys), *keys, least=least)


def _planes(moments: DataFrame, *keys: str, least: int) -> DataFrame:
    m = moments.where(F.col("n") >= max(3, least))
    xx, xy, xz, yy, yz, zz = (F.col(c) for c in ("xx", "xy", "xz", "yy", "yz", "zz"))
    m = m.withColumn("q", (xx + yy + zz) / 3)
    q = F.col("q")
    off = xy * xy + xz * xz + yz * yz
    m = m.withColumn("p", F.sqrt(((xx - q) ** 2 + (yy - q) ** 2 + (zz - q) ** 2 + 2 * off) / 6))
    p = F.when(F.col("p") == 0, 1.0).otherwise(F.col("p"))
    a, b, c = (xx - q) / p, (yy - q) / p, (zz - q) / p
    d, e, f = xy / p, xz / p, yz / p
    half = (a * (b * c - f * f) - d * (d * c - f * e) + e * (d * f - b * e)) / 2
    angle = F.acos(F.least(F.greatest(half, F.lit(-1.0)), F.lit(1.0))) / 3 + 2 * math.pi / 3
    m = m.withColumn("low", q + 2 * F.col("p") * F.cos(angle))
    low = F.col("low")
    rows = [(xx - low, xy, xz), (xy, yy - low, yz), (xz, yz, zz - low)]

    def across(u: tuple, v: tuple) -> Column:
        x, y, z = u[1] * v[2] - u[2] * v[1], u[2] * v[0] - u[0] * v[2], u[0] * v[1] - u[1] * v[0]
        return F.struct((x * x + y * y + z * z).alias("size"), x.alias("x"), y.alias("y"), z.alias("z"))

    m = m.withColumn("v", F.greatest(across(rows[0], rows[1]), across(rows[0], rows[2]), across(rows[1], rows[2])))
    # On a line all products vanish but for the cosine's rounding: turn the line's direction, the largest row, by a right angle.
    line = F.greatest(*[F.struct((r[0] * r[0] + r[1] * r[1] + r[2] * r[2]).alias("size"), *[x.alias(n) for x, n in zip(r, "xyz", strict=True)]) for r in [(xx, xy, xz), (xy, yy, yz), (xz, yz, zz)]])
    m = m.withColumn("line", line)
    flat = F.col("v.size") <= F.col("p") ** 4 * 1e-14
    lx, ly, lz = (F.col(f"line.{k}") for k in "xyz")
    side = F.when(F.abs(lx) <= F.abs(lz), F.struct(F.lit(0.0).alias("x"), (-lz).alias("y"), ly.alias("z"))).otherwise(F.struct((-ly).alias("x"), lx.alias("y"), F.lit(0.0).alias("z")))
    axis = F.struct(F.lit(1.0).alias("x"), F.lit(0.0).alias("y"), F.lit(0.0).alias("z"))
    m = m.withColumn("w", F.when(F.col("p") == 0, axis).when(flat, side).otherwise(F.struct(*[F.col(f"v.{k}").alias(k) for k in "xyz"])))
    x, y, z = (F.col(f"w.{k}") for k in "xyz")
    largest = F.when((F.abs(x) >= F.abs(y)) & (F.abs(x) >= F.abs(z)), x).when(F.abs(y) >= F.abs(z), y).otherwise(z)
    size = F.sqrt(x * x + y * y + z * z) * F.signum(largest)
    nx, ny, nz = x / size, y / size, z / size
    off = xx * nx * nx + yy * ny * ny + zz * nz * nz + 2 * (xy * nx * ny + xz * nx * nz + yz * ny * nz)
    return m.select(*keys, "n", "cx", "cy", "cz", nx.alias("nx"), ny.alias("ny"), nz.alias("nz"), F.greatest(off, F.lit(0.0)).alias("off_plane"))


#: Names of nodes that may be sent to every task: some 4 MB.
_FEW = 100_000


def pick_radius(spacing: float) -> float:
    return max(4 * spacing, 1e-3)


def refined(points: DataFrame, picks: DataFrame, nodes: DataFrame, cube, radius: float, scope: str = "leaf", least: int = 6) -> DataFrame:
    """Planes at picks (query_id, q_x, q_y, q_z) from the points within `radius`; fewer than `least` points give none.

    scope "leaf": only points in the same deepest node of `nodes` as the pick; "all": points of every node. Points and picks
    that have a column `node` are taken to be in that node, others are located.
    """
    from . import joins

    if scope == "all":
        return fit_planes(joins.radius_join(points, picks, radius), "query_id", least=least)
    if scope != "leaf":
        raise ValueError(f"unknown scope {scope!r}")
    if "node" not in points.columns or "node" not in picks.columns:
        nodes = keep(nodes, "nodes")
    if "node" not in points.columns:
        points = by_node(points.join(joins.locate(points, nodes, cube).select("point_id", "node"), "point_id"))
    if "node" not in picks.columns:
        at = picks.select(F.col("query_id").alias("point_id"), *[F.col(f"q_{a}").alias(a) for a in "xyz"])
        picks = picks.join(joins.locate(at, nodes, cube).select(F.col("point_id").alias("query_id"), "node"), "query_id")
    return _planes(_moments_in_node(points, picks, radius), "query_id", least=least)


def by_node(points: DataFrame) -> DataFrame:
    """points (point_id, x, y, z, node) without those that lack a coordinate, written in the order of their nodes.

    What is grouped by node afterwards is nearly whole within a task, and a node of many points is over several.
    """
    inside = points.select("point_id", "node", *"xyz").dropna(subset=list("xyz"))
    return keep(inside.repartitionByRange("node", "point_id").sortWithinPartitions("node"), "by-node")


def _moments_in_node(points: DataFrame, picks: DataFrame, radius: float) -> DataFrame:
    """query_id with the moments of the points that are in the pick's node and within `radius`.

    Where the node's points are all that near, as the farthest corner of their box is, the moments are the node's, which are
    summed up once. Only the other picks are paired with points.
    """
    from . import joins

    names = ["n", "cx", "cy", "cz", "xx", "xy", "xz", "yy", "yz", "zz"]
    met = picks.join(plane_moments(points, "node", box=True), "node")
    corner = sum((F.greatest(F.abs(F.col(f"min_{a}") - F.col(f"q_{a}")), F.abs(F.col(f"max_{a}") - F.col(f"q_{a}"))) ** 2 for a in "xyz"), F.lit(0.0))
    whole = F.coalesce((corner <= radius * radius) & F.lit(radius > 0), F.lit(False))
    met = keep(met.select("query_id", "node", *[f"q_{a}" for a in "xyz"], whole.alias("whole"), *[F.when(whole, F.col(c)).alias(c) for c in names]), "met")
    out = met.where("whole").select("query_id", *names)
    cut = met.where("not whole").select("query_id", "node", *[f"q_{a}" for a in "xyz"])
    own = cut.select("node").distinct()
    many = own.count()
    if many == 0:
        return out
    close = points.join(F.broadcast(own) if many <= _FEW else own, "node", "left_semi")
    return out.unionByName(plane_moments(joins.radius_join(close, cut, radius, "node"), "query_id").select("query_id", *names))
