"""View-dependent selection of nodes, set at a time, and picking by projection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions import geometry as g
from ..functions import spatial
from ..functions.geometry import Camera
from .scratch import keep

PICK_RADIUS = 4


def in_frustum(planes: list[tuple[float, float, float, float]]) -> Column:
    """Over boxes (min_x .. max_z): the corner farthest along each plane's normal is inside."""
    out = F.lit(True)
    for a, b, c, d in planes:
        far = [F.col(f"{'max' if v >= 0 else 'min'}_{axis}") * v for axis, v in zip(spatial.AXES, (a, b, c), strict=True)]
        out = out & (far[0] + far[1] + far[2] + d >= 0)
    return out


def screen_error(camera: Camera, height: int, spacing: Column) -> Column:
    """spacing in pixels at the middle of the box; half the diagonal where there is no spacing, unbounded at the eye."""
    middle = [(F.col(f"min_{a}") + F.col(f"max_{a}")) / 2 for a in spatial.AXES]
    d2 = sum(((m - p) ** 2 for m, p in zip(middle, camera.position, strict=True)), F.lit(0.0))
    half = F.sqrt(sum(((F.col(f"max_{a}") - F.col(f"min_{a}")) ** 2 for a in spatial.AXES), F.lit(0.0))) / 2
    world = F.when(spacing <= 0, half).otherwise(spacing)
    return F.when(d2 < 1e-10, F.lit(1.7976931348623157e308)).otherwise(world * camera.factor(height) / F.sqrt(d2))


def with_boxes(nodes: DataFrame, cube: spatial.Cube, grid_size: int) -> DataFrame:
    """nodes (node, level) with their cube as min_x .. max_z and their spacing."""
    x, y, z, edge = spatial.box_of("node", cube)
    out = nodes.withColumns({f"min_{a}": c for a, c in zip(spatial.AXES, (x, y, z), strict=True)} | {"edge": edge})
    return out.withColumns({f"max_{a}": F.col(f"min_{a}") + F.col("edge") for a in spatial.AXES} | {"spacing": F.col("edge") / grid_size}).drop("edge")


def select_nodes(boxed: DataFrame, camera: Camera, threshold: float = 1.0, height: int = 768) -> DataFrame:
    """Nodes in the frustum all of whose ancestors are in it too and coarser than `threshold` pixels."""
    seen = keep(boxed.withColumn("visible", in_frustum(camera.planes())).withColumn("error", screen_error(camera, height, F.col("spacing"))), "seen")
    split = seen.select("node", (F.col("visible") & (F.col("error") > threshold)).alias("passes"))
    above = seen.where("visible").select("node", F.explode_outer(spatial.ancestors("node", proper=True)).alias("ancestor"))
    told = above.join(split.toDF("ancestor", "passes"), "ancestor", "left").groupBy("node").agg(F.min(F.when(F.col("ancestor").isNull(), F.lit(True)).otherwise(F.coalesce("passes", F.lit(False)))).alias("all_pass"))
    return seen.join(told.where("all_pass").select("node"), "node", "left_semi")


def all_nodes(records: DataFrame) -> DataFrame:
    """Every node of a hierarchy (node_type), whatever the camera; the records that only stand for a further batch go."""
    return records.where("node_type <> 2")


#: Selections by name: boxed nodes and a camera -> nodes. Others can be registered.
STRATEGIES = {"screen_error": select_nodes, "all": lambda boxed, camera=None, **_: all_nodes(boxed)}


def select(boxed: DataFrame, strategy: str, *args, **options) -> DataFrame:
    return STRATEGIES[strategy](boxed, *args, **options)


def visible_points(selected: DataFrame) -> DataFrame:
    """selected (node, num_points): how many points are shown; 0 of none."""
    return selected.agg(F.coalesce(F.sum("num_points"), F.lit(0)).cast("long").alias("points"))


def overall_box(boxes: DataFrame) -> DataFrame:
    """boxes (min_x .. max_z): the box around all, null of none."""
    return boxes.agg(*[f(f"{k}_{a}").alias(f"{k}_{a}") for a in spatial.AXES for k, f in (("min", F.min), ("max", F.max))])


def active_set(resident: DataFrame, wanted: DataFrame, budget: int) -> DataFrame:
    """(node, loaded): what stays resident (node, last_touch, touched) within the budget, and what is to be loaded."""
    stays = resident.join(victims(resident, budget).select("node"), "node", "left_anti").select("node", F.lit(True).alias("loaded"))
    return stays.union(wanted.join(resident.select("node"), "node", "left_anti").select("node", F.lit(False)))


def victims(resident: DataFrame, budget: int) -> DataFrame:
    """resident (node, last_touch, touched): the least recently touched ones over the budget, never one touched now.

    A cut by touch is found from counts, so that only the nodes of the last touch that goes are numbered in one task.
    """
    over = resident.agg((F.count("*") - budget).alias("over"))
    free = resident.where("not touched").select("node", "last_touch")
    counts = free.groupBy("last_touch").agg(F.count("*").alias("n"))
    cut = F.sum("n").over(W.orderBy("last_touch").rowsBetween(W.unboundedPreceding, W.currentRow))
    whole = counts.select("last_touch", "n", (cut - F.col("n")).alias("before")).join(F.broadcast(over), F.col("before") < F.col("over"))  # one row
    place = F.row_number().over(W.partitionBy("last_touch").orderBy("node"))
    return free.join(whole, "last_touch").withColumn("place", place + F.col("before")).where("place <= over").select("node", "last_touch")


def on_screen(points: DataFrame, camera: Camera, width: int, height: int) -> DataFrame:
    """Points in front of the camera and within the screen, with px, py and depth."""
    m = camera.matrix()
    at = tuple(F.col(a) for a in spatial.AXES)
    w = g.projected(at, m)[3]
    px, py, depth = g.pixel(at, m, width, height)
    out = points.where(w > 1e-6).withColumns({"px": F.floor(px), "py": F.floor(py), "depth": depth})
    return out.where((F.col("px") >= 0) & (F.col("px") < width) & (F.col("py") >= 0) & (F.col("py") < height) & F.col("depth").between(-1.0, 1.0))


def pick(points: DataFrame, camera: Camera, column: int, row: int, width: int, height: int) -> DataFrame:
    """The point seen nearest to a click: the front point of each pixel, the nearest pixel within the window, ties by row."""
    near = on_screen(points, camera, width, height).where((F.abs(F.col("px") - column) <= PICK_RADIUS) & (F.abs(F.col("py") - row) <= PICK_RADIUS))
    front = near.groupBy("px", "py").agg(F.min(F.struct("depth", "point_id")).alias("front"))
    d2 = (F.col("px") - column) ** 2 + (F.col("py") - row) ** 2
    return front.select(F.struct(d2.cast("long").alias("d2"), "py", "px", F.col("front.point_id").alias("point_id")).alias("s")).agg(F.min("s").alias("s")).where("s is not null").select("s.point_id", F.col("s.px").alias("px"), F.col("s.py").alias("py"), F.col("s.d2").alias("d2"))
