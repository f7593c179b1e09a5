import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from pointloom.functions import spatial
from pointloom.functions.spatial import Cube
from pointloom.operators import octree, sampling
from pointloom.plans import build
from pointloom.plans.options import BuildOptions


def frame(spark, xyz):
    return spark.createDataFrame([(k, *map(float, p)) for k, p in enumerate(xyz)], "point_id long, x double, y double, z double")


def test_cells_of_a_cube_of_eight(spark):
    cube = Cube(0.0, 0.0, 0.0, 8.0)
    p = frame(spark, [(0.5, 0.5, 0.5), (4, 0, 0), (7.99, 7.99, 7.99), (8, 8, 8), (-1, -1, -1)])
    assert [r[0] for r in p.orderBy("point_id").select(spatial.cell_index(cube, 8)).collect()] == [0, 4, 511, 511, 0]


def test_naming(spark):
    code = spatial.morton(F.lit(3).cast("long"), F.lit(1).cast("long"), F.lit(2).cast("long"))
    assert spark.range(1).select(F.lpad(F.conv(code.cast("string"), 10, 8), 2, "0")).first()[0] == "56"
    mid = spatial.octant(F.lit(4.0), F.lit(4.0), F.lit(4.0), [4.0, 4.0, 4.0])
    assert spark.range(1).select(mid).first()[0] == 7


def test_morton_round_trip(spark):
    rng = np.random.default_rng(0)
    cells = rng.integers(0, 1 << 21, (200, 3))
    rows = spark.createDataFrame(pd.DataFrame(cells, columns=list("abc")))
    got = [r[0] for r in rows.select(spatial.morton(F.col("a"), F.col("b"), F.col("c"))).collect()]
    want = [sum(((int(v) >> i) & 1) << (3 * i + 2 - k) for k, v in enumerate(c) for i in range(21)) for c in cells]
    assert sorted(got) == sorted(want)


def test_node_boxes(spark):
    cube = Cube(0.0, 0.0, 0.0, 8.0)
    names = spark.createDataFrame([("r0",), ("r03",), ("r04",), ("r047",)], "node string")
    got = {r[0]: tuple(r)[1:] for r in names.select("node", *spatial.box_of("node", cube)).collect()}
    assert got == {"r0": (0, 0, 0, 4), "r03": (0, 2, 2, 2), "r04": (2, 0, 0, 2), "r047": (3, 1, 1, 1)}


def test_skeleton(spark):
    names = spark.createDataFrame([("r",), ("r03",), ("r047",)], "chunk string")
    assert {r[0] for r in octree.skeleton(names).collect()} == {"r", "r0", "r03", "r04", "r047"}


def test_chunks_of_two_clusters(spark):
    p = frame(spark, [(0, 0, 0), (0.01, 0, 0), (0, 0.01, 0), (8, 8, 8), (7.99, 8, 8), (8, 7.99, 8), (8, 8, 7.99)])
    cube = Cube.around(p)
    coded = octree.with_codes(p, cube)
    chunked = octree.with_chunks(coded, octree.chunk_plan(coded, 7, 2), 7)
    assert {(r[0], r[1]) for r in chunked.groupBy("chunk").count().collect()} == {("r0000000", 3), ("r7777777", 4)}
    whole = octree.with_chunks(coded, octree.chunk_plan(coded, 7, 1000), 7)
    assert {r[0] for r in whole.select("chunk").distinct().collect()} == {"r"}


def recursive_leaves(codes, name, level, cap, limit):
    if len(codes) <= cap or level >= limit:
        return {name: len(codes)} if len(codes) else {}
    out = {}
    for d in range(8):
        own = [c for c in codes if (c >> (3 * (20 - level))) & 7 == d]
        out |= recursive_leaves(own, f"{name}{d}", level + 1, cap, limit)
    return out


@pytest.mark.parametrize("cap", [1, 4, 20])
def test_leaves_equal_the_recursive_build(spark, cap):
    rng = np.random.default_rng(cap)
    xyz = np.concatenate((rng.random((150, 3)), rng.random((80, 3)) * 0.01, np.repeat(rng.random((1, 3)), 30, axis=0)))
    p = frame(spark, xyz)
    cube = Cube.around(p)
    coded = octree.with_codes(p, cube)
    chunked = octree.with_chunks(coded, octree.chunk_plan(coded, 7, 100), 7)
    got = {r[0]: r[2] for r in octree.leaves(octree.with_leaves(chunked, cap)).collect()}
    want = {}
    by = {}
    for r in chunked.collect():
        by.setdefault(r["chunk"], []).append(r["morton"])
    for name, codes in by.items():
        want |= recursive_leaves(codes, name, len(name) - 1, cap, min(len(name) - 1 + 20, 21))
    assert got == want


def test_poisson_chain_and_random_points():
    x = np.stack((np.arange(6) * 0.4, np.zeros(6), np.zeros(6)), axis=1)
    order = sampling._centre_order(x, np.arange(6), np.array([1.0, 1.0, 1.0]))
    assert sampling.poisson_accept(x, 1.0, order).sum() == 2
    rng = np.random.default_rng(5)
    p = rng.random((300, 3)) * 10
    for order in (np.arange(300), sampling._centre_order(p, np.arange(300), np.full(3, 5.0))):
        keep = sampling.poisson_accept(p, 0.5, order)
        d = np.sqrt(((p[:, None] - p[None]) ** 2).sum(axis=2))
        inside = d[keep][:, keep] + np.eye(keep.sum()) * 9
        assert inside.min() >= 0.5
        assert (d[~keep][:, keep].min(axis=1) < 0.5).all()
    assert sampling.poisson_accept(p, 0.0, np.arange(300)).all()
    assert not len(sampling.poisson_accept(p[:0], 1.0, np.arange(0)))


def test_scan_without_guard_accepts_all_near_the_centre():
    rng = np.random.default_rng(2)
    p = rng.normal(0, 0.05, (50, 3))
    order = sampling._centre_order(p, np.arange(50), np.zeros(3))
    assert sampling._as_written(p, 1.0, order, np.zeros(3)).sum() > sampling.poisson_accept(p, 1.0, order).sum() == 1


@pytest.mark.parametrize("how", ["poisson", "random", "poisson_average"])
def test_dataset_keeps_every_point_once(spark, tmp_path, how):
    rng = np.random.default_rng(1)
    p = frame(spark, rng.random((2000, 3)) * 100).withColumn("classification", F.lit(2))
    seen = []
    d = build.build_dataset(p, str(tmp_path / "d"), options=BuildOptions(max_points_per_chunk=500, first_chunk_size=100, sampling=how), progress=lambda s, share: seen.append((s, share)))
    assert [s for s, _ in seen] == list(build.STAGES)
    assert d.points.select("point_id").distinct().count() == d.points.count() == 2000
    nodes = d.nodes.toPandas().set_index("node")
    assert nodes.num_points.sum() == 2000 and nodes.level.max() == d.metadata["hierarchy"]["depth"] > 0
    assert ((nodes.child_mask == 0) == (nodes.is_leaf == 1)).all()
    for name, row in nodes.iterrows():
        for k in range(8):
            assert bool(int(row.child_mask) >> k & 1) == (f"{name}{k}" in nodes.index)
    assert d.metadata["points"] == 2000
    assert {r["component"] for r in d.attributes.collect()} == {"x", "y", "z", "classification"}


def test_points_of_one_node_keep_their_spacing(spark):
    rng = np.random.default_rng(4)
    p = frame(spark, rng.random((1500, 3)) * 8)
    leafed, cube, total = build.prepared(p, BuildOptions(max_points_per_chunk=200, first_chunk_size=20))
    owned = sampling.lod_owners(leafed, cube, 4).join(p, "point_id").toPandas()
    assert len(owned) == 1500 and (owned.owner_level <= owned.leaf_level).all()
    for (level, _), g in owned[owned.owner_level < owned.leaf_level].groupby(["owner_level", owned.morton // 8 ** (20 - owned.owner_level.clip(1).astype("int64")) // 8]):
        x = g[["x", "y", "z"]].to_numpy()
        d = ((x[:, None] - x[None]) ** 2).sum(axis=2) + np.eye(len(x)) * 1e9
        assert d.min() >= (cube.edge / 4 / 2**level) ** 2 * (1 - 1e-12)


def test_empty_and_single_point(spark):
    empty = frame(spark, np.zeros((0, 3)))
    leafed, cube, total = build.prepared(empty, BuildOptions())
    assert total == 0 and cube.edge == 0 and leafed.count() == 0
    leafed, cube, total = build.prepared(frame(spark, [(1, 2, 3)]), BuildOptions())
    assert leafed.count() == 1 and cube.edge == 0
    assert sampling.lod_owners(leafed, cube, 128).count() == 1


def test_options():
    o = BuildOptions()
    assert [o.grid_size(n) for n in (10, 99_999_999, 100_000_000, 499_999_999, 500_000_000)] == [128, 128, 256, 256, 512]
    assert [o.chunk_cap(n) for n in (10, 100, 10**9)] == [0, 5, 10_000_000]
    with pytest.raises(ValueError):
        BuildOptions(min_grid_size=100)
