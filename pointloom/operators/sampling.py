"""Level-of-detail sampling: Poisson-disk, greedy in input order, and every second row.

Every point ends in exactly one node. From the deepest level up, the points that a level's nodes offer are sampled in their
parent's node; those accepted go on, the others stay where they were.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F
from pyspark.sql.types import BooleanType, StructField, StructType

from ..functions.spatial import Cube
from . import scratch
from .octree import prefix


def poisson_accept(xyz: np.ndarray, spacing: float, order: np.ndarray) -> np.ndarray:
    """Which points stay when, in `order`, a point is refused if an accepted one is nearer than spacing.

    Accepted points are hashed into cells of edge `spacing`, so that only 27 cells are looked at. spacing <= 0 accepts all.
    """
    n = len(xyz)
    if spacing <= 0:
        return np.ones(n, bool)
    keep = np.zeros(n, bool)
    cells = np.floor(xyz / spacing).astype(np.int64)
    grid: dict[tuple[int, int, int], list[int]] = {}
    near = [(a, b, c) for a in (-1, 0, 1) for b in (-1, 0, 1) for c in (-1, 0, 1)]
    limit = spacing * spacing
    points = xyz.tolist()
    for i in order.tolist():
        cx, cy, cz = cells[i].tolist()
        x, y, z = points[i]
        for a, b, c in near:
            if any((points[j][0] - x) ** 2 + (points[j][1] - y) ** 2 + (points[j][2] - z) ** 2 < limit for j in grid.get((cx + a, cy + b, cz + c), ())):
                break
        else:
            keep[i] = True
            grid.setdefault((cx, cy, cz), []).append(i)
    return keep


#: Points that are sampled at a time, and candidate pairs of near points that are held; beyond these, point after point.
_POINTS, _PAIRS = 20_000, 8_000_000
_HALF = [(a, b, c) for a in (-1, 0, 1) for b in (-1, 0, 1) for c in (-1, 0, 1) if (a, b, c) >= (0, 0, 0)]


def _near_pairs(group: np.ndarray, xyz: np.ndarray, spacing: float) -> tuple[np.ndarray, np.ndarray] | None:
    """Pairs of points of one group that are nearer than spacing; None where too many points share cells."""
    cell = np.floor(xyz / spacing).astype(np.int64)
    start = np.append(True, group[1:] != group[:-1])
    number = np.cumsum(start) - 1
    cell -= np.minimum.reduceat(cell, np.flatnonzero(start), axis=0)[number] - 1
    size = cell.max(axis=0) + 2
    if float(size.astype(float).prod()) * (number[-1] + 1) > 2.0**62:
        return None
    key = ((number * size[0] + cell[:, 0]) * size[1] + cell[:, 1]) * size[2] + cell[:, 2]
    order = np.argsort(key, kind="stable")
    ranked = key[order]
    us, vs = [], []
    total = 0
    for a, b, c in _HALF:
        own = (a, b, c) == (0, 0, 0)
        other = key + (a * size[1] + b) * size[2] + c
        lo, hi = np.searchsorted(ranked, other, "left"), np.searchsorted(ranked, other, "right")
        n = hi - lo
        total += int(n.sum())
        if total > _PAIRS:
            return None
        u = np.repeat(np.arange(len(key)), n)
        v = order[np.arange(len(u)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)]
        close = ((xyz[u] - xyz[v]) ** 2).sum(axis=1) < spacing * spacing
        if own:
            close &= u < v
        us.append(u[close])
        vs.append(v[close])
    return np.concatenate(us), np.concatenate(vs)


def accept_groups(group: np.ndarray, xyz: np.ndarray, spacing: float, place: np.ndarray) -> np.ndarray:
    """poisson_accept for many groups at once, whose points are next to each other; `place` orders the points.

    In rounds: points without an earlier undecided point near are accepted, and what is near them is refused.
    """
    if spacing <= 0 or not len(xyz):
        return np.ones(len(xyz), bool)
    pairs = _near_pairs(group, xyz, spacing)
    keep = np.zeros(len(xyz), bool)
    if pairs is None:
        edge = np.flatnonzero(np.append(True, group[1:] != group[:-1])).tolist() + [len(group)]
        for lo, hi in zip(edge, edge[1:], strict=False):
            keep[lo:hi] = poisson_accept(xyz[lo:hi], spacing, np.argsort(place[lo:hi], kind="stable"))
        return keep
    first = np.where(place[pairs[0]] < place[pairs[1]], *pairs)
    last = pairs[0] + pairs[1] - first
    open_ = np.ones(len(xyz), bool)
    while len(first):
        blocked = np.zeros(len(xyz), bool)
        blocked[last] = True
        now = open_ & ~blocked
        keep |= now
        open_ &= ~now
        open_[last[now[first]]] = False
        left = open_[first] & open_[last]
        first, last = first[left], last[left]
    return keep | open_


#: Fixed value: comparisons after which the scan as written gives up and accepts.
_SCANNED = 10_001


def _centre_order(xyz: np.ndarray, ids: np.ndarray, centre: np.ndarray) -> np.ndarray:
    return np.lexsort((ids, ((xyz - centre) ** 2).sum(axis=1)))


def _as_written(xyz: np.ndarray, spacing: float, order: np.ndarray, centre: np.ndarray) -> np.ndarray:
    """The scan without a guard: it stops where the distance to the centre falls under candidate minus spacing, squared.

    Near the centre that difference is negative and its square large, so candidates within half the spacing are accepted.
    """
    keep = np.zeros(len(xyz), bool)
    if spacing <= 0:
        return np.ones(len(xyz), bool)
    far = np.sqrt(((xyz - centre) ** 2).sum(axis=1))
    accepted: list[int] = []
    for i in order.tolist():
        stop = (far[i] - spacing) ** 2
        for j in reversed(accepted[-_SCANNED:]):
            if far[j] ** 2 < stop:
                accepted.append(i)
                keep[i] = True
                break
            if ((xyz[j] - xyz[i]) ** 2).sum() < spacing * spacing:
                break
        else:
            accepted.append(i)
            keep[i] = True
    return keep


def sample_groups(offered: DataFrame, spacing: float, cube: Cube, level: int, sampling: str = "poisson", compat: str = "strict") -> DataFrame:
    """offered (node code `group`, point_id, x, y, z, ...) with `accepted`, one group at a time.

    sampling: "random" is every second row by point_id, "poisson_average" is greedy by point_id, all else Poisson-disk by
    distance from the node's centre.
    """
    if sampling == "random":
        place = F.row_number().over(W.partitionBy("group").orderBy("point_id"))
        return offered.withColumn("accepted", (place - 1) % 2 == 0)
    edge = cube.edge / 2**level
    low = np.array([cube.x, cube.y, cube.z])

    def kept(table: pa.Table) -> np.ndarray:
        xyz = np.stack([table.column(a).to_numpy() for a in "xyz"], axis=1)
        ids, code = table.column("point_id").to_numpy(), table.column("group").to_numpy()
        at = np.stack([sum(((code >> (3 * k + bit)) & 1) << k for k in range(level)) + np.zeros(len(code), np.int64) for bit in (2, 1, 0)], axis=1)
        centre = low + (at + 0.5) * edge
        if compat == "as_written" and sampling != "poisson_average":
            own = np.zeros(len(xyz), bool)
            cut = np.flatnonzero(np.append(True, code[1:] != code[:-1])).tolist() + [len(code)]
            for lo, hi in zip(cut, cut[1:], strict=False):
                own[lo:hi] = _as_written(xyz[lo:hi], spacing, _centre_order(xyz[lo:hi], ids[lo:hi], centre[lo]), centre[lo])
            return own
        order = np.argsort(ids, kind="stable") if sampling == "poisson_average" else _centre_order(xyz, ids, centre)
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        return accept_groups(code, xyz, spacing, place)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def out(table: pa.Table) -> Iterator[pa.RecordBatch]:
            if len(table):
                yield from table.append_column("accepted", pa.array(kept(table))).combine_chunks().to_batches()

        for b in batches:
            held.append(b)
            if sum(x.num_rows for x in held) >= _POINTS:
                table = pa.Table.from_batches(held)
                code = table.column("group").to_numpy()
                whole = int(np.searchsorted(code, code[-1]))  # the last group may go on
                yield from out(table.slice(0, whole))
                held = table.slice(whole).to_batches()
        if held:
            yield from out(pa.Table.from_batches(held))

    dealt = offered.repartition("group").sortWithinPartitions("group")
    return dealt.mapInArrow(run, StructType([*offered.schema.fields, StructField("accepted", BooleanType())]))


def lod_owners(leafed: DataFrame, cube: Cube, grid_size: int, sampling: str = "poisson", compat: str = "strict") -> DataFrame:
    """leafed (point_id, morton, x, y, z, leaf_level) -> (point_id, morton, leaf_level, owner_level).

    Each level's table is written to the shared folder, so lineage does not grow with the depth. Only accepted points go on,
    about an eighth where the data are dense.
    """
    root = scratch.folder(leafed.sparkSession)
    rows = scratch.keep(leafed.select("point_id", "morton", "x", "y", "z", "leaf_level"), "leafed", root)
    depth = rows.agg(F.max("leaf_level")).first()[0]
    done = []
    moving = rows.where(f"leaf_level = {depth if depth is not None else 0}")
    for level in range((depth or 0) - 1, -1, -1):
        spacing = cube.edge / grid_size / 2**level
        offered = moving.withColumn("group", prefix("morton", level))
        told = scratch.keep(sample_groups(offered, spacing, cube, level, sampling, compat).drop("group"), f"level{level}", root)
        done.append(told.where("not accepted").select("point_id", "morton", "leaf_level", F.lit(level + 1).alias("owner_level")))
        moving = told.where("accepted").drop("accepted").union(rows.where(f"leaf_level = {level}"))
    done.append(moving.select("point_id", "morton", "leaf_level", F.lit(0).alias("owner_level")))
    out = done[0]
    for more in done[1:]:
        out = out.union(more)
    return out


def spacing_of_levels(cube: Cube, grid_size: int, depth: int) -> list[tuple[int, float]]:
    return [(k, cube.edge / grid_size / 2**k) for k in range(depth + 1)]

