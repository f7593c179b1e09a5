"""Handlers, hooks, leaves, location and cameras."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from pointloom.functions.codec import Attribute
from pointloom.functions.geometry import Camera
from pointloom.functions.spatial import Cube
from pointloom.operators import attributes, joins, lod, octree, projects, sampling
from pointloom.sources import registry

from .test_octree import frame


def test_handlers_by_name(spark):
    p = spark.createDataFrame([(1, 1.0, 2.0, 3.0, 5, 9), (2, -1.0, 0.5, 3.5, 250, 7)], "point_id long, x double, y double, z double, classification int, intensity int")
    assert attributes.attributes_of(p) == ["position", "classification", "intensity"]
    got = {(r["attribute"], r["component"]): (r["min_value"], r["max_value"], r["histogram"]) for r in attributes.statistics(p, attributes.attributes_of(p)).collect()}
    assert got["position", "x"] == (-1.0, 1.0, None) and got["intensity", "intensity"] == (7.0, 9.0, None)
    low, high, bins = got["classification", "classification"]
    assert (low, high, len(bins), bins[5], bins[250], sum(bins)) == (5.0, 250.0, 256, 1, 1, 2)

    class Doubled(attributes.Handler):
        def decode(self, name, source):
            return [F.col(c) * 2 for c in self.columns(name)]

    attributes.register("intensity", Doubled())
    try:
        assert [r[0] for r in p.select(*attributes.handler_of("intensity").decode("intensity", Attribute("intensity"))).collect()] == [18, 14]
    finally:
        del attributes.HANDLERS["intensity"]
    assert attributes.handler_of("other") is attributes.SCALAR
    with pytest.raises(ValueError):
        attributes.statistics(p, [])


def test_readers_and_strategies_can_be_added(spark, tmp_path):
    registry.register_reader(".XYZ", lambda spark, path, options: spark.range(int(options["rows"])))
    try:
        assert registry.read_points(spark, "/a/b.xyz", rows="3").count() == 3
    finally:
        del registry.READERS[".xyz"]
    for path in ("/a/b.pcd", "/a/b"):
        with pytest.raises(ValueError):
            registry.read_points(spark, path)
    paths = spark.createDataFrame([("/a/B.LAS",), ("/a/b.las.gz",), ("/a/.las",), ("/a.las/b",)], "path string")
    assert [r[0] for r in paths.where(registry.has_extension("path", ".Las")).collect()] == ["/a/B.LAS"]
    assert paths.where(registry.has_extension("path", "")).count() == 4
    lod.STRATEGIES["none"] = lambda boxed: boxed.limit(0)
    try:
        assert lod.select(paths, "none").count() == 0
    finally:
        del lod.STRATEGIES["none"]


@pytest.mark.parametrize("cap", [1, 3, 20, 400])
@pytest.mark.parametrize("digits", [None, 2, 21])
def test_leaves_against_counts(spark, cap, digits):
    rng = np.random.default_rng(cap)
    xyz = np.concatenate((rng.random((200, 3)), rng.random((100, 3)) * 1e-3, np.full((9, 3), 0.4)))
    p = frame(spark, xyz)
    coded = octree.with_codes(p, Cube(0.0, 0.0, 0.0, 1.0))
    chunked = octree.with_chunks(coded, octree.chunk_plan(coded, 3, 120), 3)
    rows = octree.with_leaves(chunked, cap, digits).collect()
    assert len(rows) == len(xyz)
    codes = [r["morton"] for r in rows]
    for r in rows:
        limit = min(r["chunk_level"] + 20, 21)
        want = next(k for k in range(r["chunk_level"], limit + 1) if k == limit or sum(c >> 3 * (21 - k) == r["morton"] >> 3 * (21 - k) for c in codes) <= cap)
        assert r["leaf_level"] == want


def test_nearest_of_clustered_points(spark):
    rng = np.random.default_rng(5)
    xyz = np.concatenate((rng.random((150, 3)) * 100, rng.random((150, 3)) * 0.01, np.zeros((12, 3)), [[100, 100, 100]]))
    at = np.concatenate((xyz[::9], [[-50, 3, 3], [100, 100, 100], [400, 0, 50]]))
    q = spark.createDataFrame([(k, *map(float, v)) for k, v in enumerate(at)], "query_id long, q_x double, q_y double, q_z double")
    got = {}
    for r in joins.nearest(frame(spark, xyz), q, 6).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["point_id"]))
    for k, v in enumerate(at):
        d = ((xyz - v) ** 2).sum(axis=1)
        assert [i for _, i in sorted(got[k])] == np.lexsort((np.arange(len(xyz)), d))[:6].tolist()


def test_location_on_a_boundary(spark):
    names = spark.createDataFrame([("r",), ("r0",), ("r7",), ("r07",)], "node string")
    p = frame(spark, [(4, 4, 4), (1, 1, 1), (7, 7, 7), (3, 3, 3)])
    cube = Cube(0.0, 0.0, 0.0, 8.0)
    at = lambda how: {r["point_id"]: r["node"] for r in joins.locate(p, names, cube, how).collect()}
    assert at("upper") == {0: "r7", 1: "r0", 2: "r7", 3: "r07"}
    assert at("lower") == {0: "r07", 1: "r0", 2: "r7", 3: "r07"}


def test_merge_tasks(spark):
    roots = spark.createDataFrame([("r00", 10), ("r01", 20), ("r1", 500), ("r20", 90), ("r21", 30)], "chunk string, num_points long")
    assert {r["chunk"]: r["task"] for r in octree.merge_tasks(roots, 100).collect()} == {"r00": "r0", "r01": "r0", "r1": "r1", "r20": "r20", "r21": "r21"}
    assert {r["task"] for r in octree.merge_tasks(roots, 10_000).collect()} == {"r"}


def test_victims_go_by_touch_then_name(spark):
    rng = random.Random(4)
    rows = [(f"n{k:02}", rng.randrange(4), rng.random() < 0.2) for k in range(40)]
    resident = spark.createDataFrame(rows, "node string, last_touch long, touched boolean")
    free = sorted((t, n) for n, t, now in rows if not now)
    for budget in (0, 10, 25, 39, 60):
        assert sorted(r["node"] for r in lod.victims(resident, budget).collect()) == sorted(n for _, n in free[: max(0, 40 - budget)])
    wanted = spark.createDataFrame([("n00",), ("new",)], "node string")
    got = {r["node"]: r["loaded"] for r in lod.active_set(resident, wanted, 60).collect()}
    assert len(got) == 41 and got["new"] is False and got["n00"] is True


def test_cameras_move():
    c = Camera((10.0, 0.0, 0.0), (0.0, 0.0, 0.0))
    assert c.zoomed(1).position[0] == pytest.approx(8.5) and c.zoomed(-1).position[0] == pytest.approx(11.8)
    assert c.zoomed(100).position[0] == pytest.approx(0.5) and c.zoomed(-100).position[0] == pytest.approx(5000)
    assert c.orbited(90, 0).position == pytest.approx((0, 10, 0), abs=1e-9)
    o = c.orbited(30, 40)
    assert math.dist(o.position, o.target) == pytest.approx(10) and abs(np.dot(o.axes()[0], o.up)) < 1e-9
    p = c.panned(2, 3)
    assert np.subtract(p.position, c.position) == pytest.approx(np.subtract(p.target, c.target)) and math.dist(p.position, c.position) == pytest.approx(math.sqrt(13))


def test_data_folder(monkeypatch, tmp_path):
    monkeypatch.setenv("POINTLOOM_HOME", str(tmp_path / "own"))
    assert projects.ProjectFolder().create("A b")["path"].startswith(str(tmp_path / "own"))
    monkeypatch.delenv("POINTLOOM_HOME")
    monkeypatch.setenv("HOME", str(tmp_path))
    assert projects.data_folder() == tmp_path / ".pointloom"


@pytest.mark.parametrize("limit", [10**7, 10])
def test_groups_at_once_equal_one_after_another(monkeypatch, limit):
    monkeypatch.setattr(sampling, "_PAIRS", limit)
    rng = np.random.default_rng(2)
    group = np.sort(rng.integers(0, 12, 900))
    xyz = np.concatenate((rng.random((600, 3)), np.round(rng.random((300, 3)), 1))) * 4 - 2
    place = rng.permutation(900)
    for spacing in (0.0, 0.05, 0.3, 1.0, 9.0):
        want = np.zeros(900, bool)
        for g in np.unique(group):
            own = np.flatnonzero(group == g)
            want[own] = sampling.poisson_accept(xyz[own], spacing, np.argsort(place[own]))
        assert (sampling.accept_groups(group, xyz, spacing, place) == want).all()
