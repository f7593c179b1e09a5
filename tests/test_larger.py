"""What shows only on larger tables: pairs of neighbours in one node, points on pixel edges and on middles."""

import datetime

import duckdb
import numpy as np
from pyspark.sql import functions as F

from pointloom.functions.spatial import Cube
from pointloom.operators import joins, octree, planefit
from pointloom.plans import catalogue

from .test_octree import frame


def test_refined_planes_pair_within_a_node(spark, monkeypatch):
    """At a radius that takes in every point, a pick meets its own node's points and no others."""
    rng = np.random.default_rng(3)
    xyz = np.concatenate((rng.random((1500, 3)), np.full((100, 3), 0.3)))  # the last are one leaf, over the cap
    p, cube = frame(spark, xyz), Cube.around(frame(spark, xyz))
    coded = octree.with_codes(p, cube)
    leafed = octree.with_leaves(octree.with_chunks(coded, octree.chunk_plan(coded, 2, 400), 2), 64)
    names = octree.nodes(octree.leaves(leafed))
    own = {r["point_id"]: r["node"] for r in joins.locate(p, names, cube).collect()}
    picks = p.where("point_id % 20 = 0").select(F.col("point_id").alias("query_id"), *[F.col(a).alias(f"q_{a}") for a in "xyz"])
    made = []
    join = joins.radius_join
    monkeypatch.setattr(joins, "radius_join", lambda *a: made.append(join(*a)) or made[-1])
    for radius in (0.2, 5.0):
        made.clear()
        got = {r["query_id"]: r for r in planefit.refined(p, picks, names, cube, radius).collect()}
        want = {}
        for k in range(0, len(xyz), 20):
            near = [i for i in own if own[i] == own[k] and ((xyz[i] - xyz[k]) ** 2).sum() <= radius * radius]
            if len(near) >= 6:
                want[k] = near
        assert got.keys() == want.keys()
        for k, near in want.items():
            r = got[k]
            low = np.linalg.eigvalsh(np.cov(xyz[near].T, bias=True))[0]
            assert r["n"] == len(near) and np.allclose([r["cx"], r["cy"], r["cz"], r["off_plane"]], [*xyz[near].mean(axis=0), max(low, 0)], atol=1e-7)
        assert sum(m.count() for m in made) <= 100 * len(want)
        assert radius < 5 or not made


def orders_at(spark, folder, rows):
    """A table of orders (price, days from 1995, customer) in a folder, and its path for SQL."""
    made = [(k, c, float(p), datetime.datetime(1995, 1, 1) + datetime.timedelta(days=d)) for k, (p, d, c) in enumerate(rows)]
    spark.createDataFrame(made, "o_orderkey long, o_custkey long, o_totalprice double, o_orderdate timestamp").write.parquet(f"{folder}/orders.parquet")
    return str(folder)


def same_as_sql(spark, name, folder):
    con = duckdb.connect()
    con.execute(f"create view orders as select * from '{folder}/orders.parquet/*.parquet'")
    got = catalogue.QUERIES[name](spark, folder)
    columns = sorted(got.columns)
    want = con.execute(f"select {', '.join(columns)} from ({catalogue.ORACLES[name]})").fetchall()
    assert sorted(map(tuple, got.select(*columns).collect())) == sorted(want)


def test_points_on_the_edge_of_a_pixel(spark, tmp_path):
    """Points whose row is 384 but for rounding."""
    rows = [(4207.09, 1439, 410), (98859.87, 2279, 10), (288468.81, 1523, 370), (391015.44, 1754, 260), (339329.36, 2069, 110), (451119.39, 914, 660), (315232.93, 809, 710), (437102.58, 704, 760)]
    folder = orders_at(spark, tmp_path, rows)
    same_as_sql(spark, "screen_project", folder)
    same_as_sql(spark, "screen_ray", folder)


def test_points_on_a_middle(spark, tmp_path):
    """Points on the middles of a cube of 256, of coarse and fine nodes, and its highest one."""
    rng = np.random.default_rng(6)
    rows = [(0.0, 0, 0), (256_000.0, 0, 0), (128_000.0, 640, 320), (128_000.0, 1280, 160), (64_000.0, 320, 640)]
    rows += [(float(p) * 1000, int(d) * 10, int(c) * 10) for p, d, c in zip(rng.integers(0, 257, 300), rng.integers(0, 220, 300), rng.integers(0, 99, 300), strict=True)]
    same_as_sql(spark, "point_location_closed", orders_at(spark, tmp_path, rows))


def test_closed_location_takes_the_half_that_exists(spark):
    names = spark.createDataFrame([("r",), ("r0",), ("r7",), ("r07",), ("r70",)], "node string")
    p = frame(spark, [(4, 4, 4), (4, 1, 1), (8, 8, 8), (4.0, 4.0, 3.0), (9, 9, 9)])
    got = {r["point_id"]: r["node"] for r in joins.locate(p, names, Cube(0.0, 0.0, 0.0, 8.0), "closed").collect()}
    assert got == {0: "r70", 1: "r0", 2: "r7", 3: "r07", 4: "r7"}
    some = spark.createDataFrame([("r",), ("r7",), ("r70",)], "node string")
    got = {r["point_id"]: r["node"] for r in joins.locate(frame(spark, [(3, 3, 3), (5, 5, 5)]), some, Cube(0.0, 0.0, 0.0, 8.0), "closed").collect()}
    assert got == {0: "r", 1: "r70"}
