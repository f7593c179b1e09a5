import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from pointloom.functions import geometry as g
from pointloom.operators import joins, lod, measure, planefit


def frame(spark, xyz, **more):
    return spark.createDataFrame(pd.DataFrame({"point_id": np.arange(len(xyz))} | {a: np.asarray(xyz, float)[:, k] for k, a in enumerate("xyz")} | more))


def test_distance_to_a_plane(spark):
    lit = lambda v: tuple(F.lit(float(x)) for x in v)
    whole, off, flat, foot = g.distance_parts(lit((1, 2, 5)), lit((0, 0, 0)), lit((0, 0, 0)), lit((0, 0, 1)))
    r = spark.range(1).select(whole, off, flat, *foot).first()
    assert list(r) == pytest.approx([math.sqrt(30), 5, math.sqrt(5), 1, 2, 0])


def test_angles(spark):
    lit = lambda v: tuple(F.lit(float(x)) for x in v)
    angle = lambda a, b, c: spark.range(1).select(g.angle_degrees(lit(a), lit(b), lit(c))).first()[0]
    assert angle((1, 0, 0), (0, 0, 0), (0, 1, 0)) == pytest.approx(90)
    assert angle((1, 0, 0), (0, 0, 0), (2, 0, 0)) == pytest.approx(0)
    assert angle((0, 0, 0), (0, 0, 0), (2, 0, 0)) == pytest.approx(90)


def test_picks_are_grouped(spark):
    p = frame(spark, [(0, 0, 0), (3, 4, 0), (1, 1, 1)], session=1, event_id=[1, 2, 3])
    got = measure.distances(p, (0, 0, 0), (0, 0, 1)).orderBy("measurement").collect()
    assert [(r["complete"], r["distance"]) for r in got] == [(True, 5.0), (False, None)]


@pytest.mark.parametrize("kind", ["plane", "noise", "line", "same", "two"])
def test_plane_fit(spark, kind):
    rng = np.random.default_rng(3)
    n = np.array([0.36, 0.48, 0.8])
    xyz = rng.normal(0, 1, (40, 3))
    if kind in ("plane", "noise"):
        xyz = xyz - np.outer(xyz @ n, n) + (rng.normal(0, 1e-3, (40, 1)) * n if kind == "noise" else 0)
    elif kind == "line":
        xyz = np.outer(np.arange(40.0), (1, 2, 3))
    elif kind == "same":
        xyz = np.zeros((40, 3))
    elif kind == "two":
        xyz = xyz[:2]
    got = planefit.fit_planes(frame(spark, xyz, k=1), "k").collect()
    if kind == "two":
        return None if got == [] else pytest.fail("two points have no plane")
    v = np.array([got[0][c] for c in ("nx", "ny", "nz")])
    assert np.linalg.norm(v) == pytest.approx(1) and v[np.argmax(abs(v))] > 0
    if kind in ("plane", "noise"):
        assert abs(v @ n) == pytest.approx(1, abs=1e-5)
    elif kind == "line":
        assert v @ np.array([1, 2, 3]) == pytest.approx(0, abs=1e-9)
    else:
        assert list(v) == [1, 0, 0]


def test_nearest_against_brute_force(spark):
    rng = np.random.default_rng(9)
    xyz = np.concatenate((rng.random((200, 3)), rng.random((60, 3)) * 1e-3, [(50.0, 50.0, 50.0)]))
    p = frame(spark, xyz)
    q = p.select(F.col("point_id").alias("query_id"), *[F.col(a).alias(f"q_{a}") for a in "xyz"])
    got = {}
    for r in joins.nearest(p, q, 5).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r["point_id"])
    d = ((xyz[:, None] - xyz[None]) ** 2).sum(axis=2)
    assert got == {i: np.lexsort((np.arange(len(xyz)), d[i]))[:5].tolist() for i in range(len(xyz))}
    assert joins.radius_join(p, q, 0.0).count() == 0
    assert joins.nearest(p.limit(0), q, 3).count() == 0
    assert joins.nearest(p.limit(3), q.limit(4), 9).count() == 12


def test_camera(spark):
    c = g.Camera((0, -10, 0), (0, 0, 0), fov=90.0, aspect=1.0)
    d = spark.range(1).select(*c.ray(F.lit(49.5), F.lit(-0.5), 100, 100)).first()
    assert math.degrees(math.atan2(d[2], d[1])) == pytest.approx(45)
    inside = spark.createDataFrame([(-1.0, -1.0, -1.0, 1.0, 1.0, 1.0), (-1.0, -30.0, -1.0, 1.0, -20.0, 1.0), (99.0, 0.0, 0.0, 100.0, 1.0, 1.0)], "min_x double, min_y double, min_z double, max_x double, max_y double, max_z double")
    assert [r[0] for r in inside.select(lod.in_frustum(c.planes())).collect()] == [True, False, False]
    fit = g.Camera.fitting((0, 0, 0), (2, 2, 2))
    assert np.linalg.norm(np.subtract(fit.position, (1, 1, 1))) > math.sqrt(3)
    px, py, _ = spark.range(1).select(*g.pixel((F.lit(0.0), F.lit(0.0), F.lit(0.0)), c.matrix(), 100, 100)).first()
    assert (px, py) == pytest.approx((50, 50))


def test_selection_equals_traversal(spark):
    rng = np.random.default_rng(6)
    names, rows = ["r"], []
    while len(names) < 120:
        names.append(names[rng.integers(len(names))] + str(rng.integers(8)))
    names = sorted(set(names))
    camera = g.Camera((0, -30, 0), (0, 0, 0))
    for n in names:
        low = rng.uniform(-20, 20, 3)
        rows.append((n, *map(float, low), *map(float, low + rng.uniform(1, 10)), float(rng.uniform(0, 0.2))))
    boxed = spark.createDataFrame(rows, "node string, min_x double, min_y double, min_z double, max_x double, max_y double, max_z double, spacing double")
    told = {r["node"]: (r["v"], r["e"]) for r in boxed.select("node", lod.in_frustum(camera.planes()).alias("v"), lod.screen_error(camera, 768, F.col("spacing")).alias("e")).collect()}
    want = {n for n in names if told[n][0] and all(told.get(n[:k], (False, 0))[0] and told[n[:k]][1] > 1 for k in range(1, len(n)) if n[:k] in told) and all(n[:k] in told for k in range(1, len(n)))}
    assert {r["node"] for r in lod.select_nodes(boxed, camera, 1.0, 768).collect()} == want


def test_budget_never_evicts_what_is_touched(spark):
    r = spark.createDataFrame([("a", 1, True), ("b", 2, True), ("c", 3, True), ("d", 4, True)], "node string, last_touch long, touched boolean")
    assert lod.victims(r, 2).count() == 0
    r = spark.createDataFrame([("a", 1, False), ("b", 2, False)], "node string, last_touch long, touched boolean")
    assert [x["node"] for x in lod.victims(r, 1).collect()] == ["a"]


def test_arc_has_none_for_parallel_rays(spark):
    p = frame(spark, [(1, 0, 0), (0, 0, 0), (2, 0, 0), (1, 0, 0), (0, 0, 0), (0, 1, 0)], session=1, event_id=np.arange(6))
    got = measure.angle_arcs(p).collect()
    assert {r["measurement"] for r in got} == {1} and len(got) == 17
    assert all(math.hypot(r["x"], r["y"]) == pytest.approx(0.2) for r in got)
    assert measure.ring((0, 0, 0), (0, 0, 1), 2.0, spark).where("abs(x * x + y * y - 4) > 1e-9 or abs(z) > 1e-9").count() == 0
