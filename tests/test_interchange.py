import numpy as np
from pyspark.sql import functions as F

from pointloom.operators import kdtree
from pointloom.plans import build
from pointloom.plans.options import BuildOptions
from pointloom.sources import interchange

from .test_octree import frame


def test_written_and_read_again(spark, tmp_path):
    rng = np.random.default_rng(8)
    p = frame(spark, np.concatenate((rng.random((800, 3)) * 100, rng.random((700, 3)) * 0.05))).withColumns({c: (F.col("point_id") * k % 65536).cast("int") for c, k in (("r", 1), ("g", 7), ("b", 77))})
    d = build.build_dataset(p, str(tmp_path / "d"), options=BuildOptions(max_points_per_chunk=300, first_chunk_size=20))
    folder = str(tmp_path / "bin")
    meta = interchange.write(d.points, d.nodes, d.metadata, folder, neighbours=True)
    assert meta["hierarchy"]["firstChunkSize"] % 22 == 0 and (tmp_path / "bin" / "hierarchy.bin").stat().st_size % 22 == 0
    assert (tmp_path / "bin" / "octree.bin").stat().st_size == 1500 * 18
    nodes = interchange.read_nodes(spark, folder)
    want = {(r["node"], r["child_mask"], r["num_points"]) for r in d.nodes.collect()}
    assert {(r["node"], r["child_mask"], r["num_points"]) for r in nodes.collect()} == want
    assert max(len(n) for n, _, _ in want) > 6  # deeper than one batch
    got = interchange.read_points(nodes, folder).toPandas().sort_values(["r", "g", "b"]).reset_index(drop=True)
    own = d.points.toPandas().sort_values(["r", "g", "b"]).reset_index(drop=True)
    assert len(got) == 1500 and (got.node == own.node).all()
    assert np.abs(got[["x", "y", "z"]].to_numpy() - own[["x", "y", "z"]].to_numpy()).max() <= 0.001 + 1e-9
    box = got.merge(nodes.toPandas(), on="node")
    assert all(((box[a] >= box[f"min_{a}"] - 0.0011) & (box[a] <= box[f"max_{a}"] + 1e-9)).all() for a in "xyz")
    assert interchange.read_points(nodes.where("node = 'r'"), folder).count() == next(n for name, _, n in want if name == "r")
    index = interchange.read_neighbour_index(spark, folder)
    sizes = {r["node"]: r["size"] for r in index.collect()}
    assert sizes == {name: 8 + 25 * n for name, _, n in want if n}
    trees = interchange.read_neighbours(index, folder).toPandas()
    assert len(trees) == 1500 and (trees.groupby("node").entry.max() + 1).sum() == 1500
    for name, tree in trees.groupby("node"):
        assert sorted(tree.point) == list(range(len(tree)))


def test_neighbour_trees_against_brute_force():
    rng = np.random.default_rng(3)
    for n in (0, 1, 2, 3, 10, 257):
        xyz = np.round(rng.random((n, 3)), 1).astype(np.float32)  # many equal coordinates
        tree = kdtree.unpack(kdtree.pack(kdtree.build(xyz)))
        assert len(tree) == n and (not n or tree.dtype.itemsize == 25)
        for q in rng.random((20, 3)):
            near = np.flatnonzero(((xyz - q.astype(np.float32)) ** 2).sum(axis=1) <= np.float32(0.3) ** 2)
            assert kdtree.within(tree, q, 0.3).tolist() == near.tolist()
        assert len(kdtree.within(tree, (0, 0, 0), 0.0)) == 0
