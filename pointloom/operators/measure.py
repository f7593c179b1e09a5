"""Measurements from ordered picks: every two (distance) or three (angle) picks of a session form one."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window as W, functions as F

from ..functions import geometry as g

ARC_SEGMENTS, RING_SEGMENTS = 16, 48


def grouped_picks(picks: DataFrame, size: int) -> DataFrame:
    """picks (session, event_id, x, y, z) -> session, measurement, p0 .. p<size - 1> and whether it is complete."""
    place = F.row_number().over(W.partitionBy("session").orderBy("event_id")) - 1
    rows = picks.select("session", F.floor(place / size).alias("measurement"), (place % size).alias("k"), F.struct("x", "y", "z").alias("p"))
    points = [F.max(F.when(F.col("k") == i, F.col("p"))).alias(f"p{i}") for i in range(size)]
    return rows.groupBy("session", "measurement").agg(*points, (F.count("*") == size).alias("complete"))


def _at(name: str) -> g.Vector:
    return tuple(F.col(f"{name}.{a}") for a in "xyz")


def distances(picks: DataFrame, centre: tuple[float, float, float], normal: tuple[float, float, float]) -> DataFrame:
    """Length, distance from the plane and distance in it of every measurement; null while incomplete."""
    m = grouped_picks(picks, 2)
    lit = lambda v: tuple(F.lit(float(x)) for x in v)
    whole, off, flat, _ = g.distance_parts(_at("p0"), _at("p1"), lit(centre), lit(normal))
    return m.select("session", "measurement", "complete", whole.alias("distance"), F.when(F.col("complete"), off).alias("perpendicular"), flat.alias("in_plane"))


def angles(picks: DataFrame) -> DataFrame:
    m = grouped_picks(picks, 3)
    return m.select("session", "measurement", "complete", F.when(F.col("complete"), g.angle_degrees(_at("p0"), _at("p1"), _at("p2"))).alias("angle"))


def distance_labels(picks: DataFrame) -> DataFrame:
    """The text of each complete distance and where it stands: the segment's middle."""
    m = grouped_picks(picks, 2).where("complete")
    p, q = _at("p0"), _at("p1")
    x, y, z = g.middle(p, q)
    return m.select("session", "measurement", F.format_string("%.3f m", g.length(g.minus(p, q))).alias("label"), x.alias("x"), y.alias("y"), z.alias("z"))


def distance_segments(picks: DataFrame, centre: tuple[float, float, float], normal: tuple[float, float, float]) -> DataFrame:
    """(session, measurement, part, ends, label, and where it stands): the line of each complete distance, and with a plane
    also those from the first point to its foot and from there to the second."""
    m = grouped_picks(picks, 2).where("complete")
    lit = lambda v: tuple(F.lit(float(x)) for x in v)
    p, q = _at("p0"), _at("p1")
    whole, off, flat, foot = g.distance_parts(p, q, lit(centre), lit(normal))
    parts = []
    for part, text, a, b, size in (("whole", "Dist", p, q, whole), ("perpendicular", "Perp", p, foot, off), ("in_plane", "InPlane", foot, q, flat)):
        ends = [c.alias(f"{e}{k}") for e, v in (("a", a), ("b", b), ("m", g.middle(a, b))) for k, c in zip("xyz", v, strict=True)]
        parts.append(F.struct(F.lit(part).alias("part"), F.format_string(f"{text}: %.3f m", size).alias("label"), *ends))
    return m.select("session", "measurement", F.explode(F.array(*parts)).alias("s")).select("session", "measurement", "s.*")


def angle_arcs(picks: DataFrame, segments: int = ARC_SEGMENTS) -> DataFrame:
    """(session, measurement, step, x, y, z): the points of the arc between both rays; none where they are parallel."""
    m = grouped_picks(picks, 3).where("complete")
    a, v, b = _at("p0"), _at("p1"), _at("p2")
    ra, rb = g.minus(a, v), g.minus(b, v)
    la, lb = g.length(ra), g.length(rb)
    ua, ub = tuple(c / F.nullif(la, F.lit(0.0)) for c in ra), tuple(c / F.nullif(lb, F.lit(0.0)) for c in rb)
    cosine = F.least(F.greatest(g.dot(ua, ub), F.lit(-1.0)), F.lit(1.0))
    across = g.minus(ub, tuple(c * cosine for c in ua))
    size = g.length(across)
    radius = F.least(la, lb) * 0.2
    m = m.where(size > 1e-9).select("session", "measurement", F.explode(F.sequence(F.lit(0), F.lit(segments))).alias("step"), F.acos(cosine).alias("angle"), radius.alias("radius"), *[c.alias(f"v{k}") for c, k in zip(v, "xyz", strict=True)], *[c.alias(f"u{k}") for c, k in zip(ua, "xyz", strict=True)], *[(c / size).alias(f"w{k}") for c, k in zip(across, "xyz", strict=True)])
    turn = F.col("angle") * F.col("step") / segments
    return m.select("session", "measurement", "step", *[(F.col(f"v{k}") + F.col("radius") * (F.cos(turn) * F.col(f"u{k}") + F.sin(turn) * F.col(f"w{k}"))).alias(k) for k in "xyz"])


def ring(centre: tuple[float, float, float], normal: tuple[float, float, float], radius: float, spark, segments: int = RING_SEGMENTS) -> DataFrame:
    """The polygon around a plane fit's normal."""
    import numpy as np

    n = np.array(normal) / np.linalg.norm(normal)
    u = np.cross(n, (1, 0, 0) if abs(n[0]) < 0.9 else (0, 1, 0))
    u = u / np.linalg.norm(u)
    w = np.cross(n, u)
    turn = F.col("id") * (2 * math.pi / segments)
    return spark.range(segments).select(F.col("id").alias("step"), *[(F.lit(float(c)) + radius * (F.cos(turn) * float(a) + F.sin(turn) * float(b))).alias(k) for k, c, a, b in zip("xyz", centre, u, w, strict=True)])


def session_gap(events: DataFrame, seconds: float = 0.15) -> DataFrame:
    """Hover events after which nothing came for `seconds`: those that are refined."""
    after = F.lead("ts").over(W.partitionBy("session").orderBy("event_id"))
    wait = (F.unix_micros(after.cast("timestamp")) - F.unix_micros(F.col("ts").cast("timestamp"))) / 1e6
    return events.withColumn("wait", wait).where(F.col("wait").isNull() | (F.col("wait") >= seconds)).drop("wait")
