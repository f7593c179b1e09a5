"""From points to a stored dataset: points, nodes, chunks and attributes as Parquet, one metadata document; and back."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import spatial
from ..functions.spatial import Cube
from ..operators import attributes, octree, sampling, scratch
from .options import BuildOptions

STAGES = ("bounds", "chunks", "leaves", "sampling", "writing")
VERSION = "2.0"


@dataclass
class Dataset:
    points: DataFrame
    nodes: DataFrame
    chunks: DataFrame
    attributes: DataFrame
    metadata: dict


def prepared(points: DataFrame, options: BuildOptions) -> tuple[DataFrame, Cube, int]:
    """Points with codes, chunks and leaves; the cube; the number of points."""
    cube = Cube.around(points)
    total = points.count()
    coded = octree.with_codes(points, cube)
    level = options.grid_level(total)
    plan = octree.chunk_plan(coded, level, options.chunk_cap(total))
    return octree.with_leaves(octree.with_chunks(coded, plan, level), options.first_chunk_size), cube, total


def metadata(name: str, cube: Cube, total: int, depth: int, options: BuildOptions, attributes: list[dict]) -> dict:
    high = [cube.low(a) + cube.edge for a in spatial.AXES]
    return {
        "version": VERSION, "name": name, "description": "", "points": total, "projection": "", "offset": [cube.low(a) for a in spatial.AXES], "scale": [0.001] * 3,
        "spacing": cube.edge / options.grid_size(total), "boundingBox": {"min": [cube.low(a) for a in spatial.AXES], "max": high}, "encoding": "DEFAULT",
        "hierarchy": {"firstChunkSize": options.first_chunk_size, "stepSize": options.step_size, "depth": depth}, "attributes": attributes,
    }


def build_dataset(points: DataFrame, path: str, name: str = "dataset", options: BuildOptions | None = None, progress: Callable[[str, float], None] = lambda stage, share: None) -> Dataset:
    """points (point_id unique, x, y, z, ...) -> a dataset in `path`; each stage is reported when it is done.

    Files of points are partitioned by the batch (first step_size + 1 characters of the node) and sorted by Morton code.
    """
    options = options or BuildOptions()
    spark = points.sparkSession
    leafed, cube, total = prepared(points, options)
    progress("bounds", 1.0)
    leafed.write.mode("overwrite").parquet(f"{path}/_leafed")
    leafed = spark.read.schema(leafed.schema).parquet(f"{path}/_leafed")
    leafed.groupBy("chunk", F.col("chunk_level").alias("level")).agg(F.count("*").alias("num_points")).write.mode("overwrite").parquet(f"{path}/chunks")
    progress("chunks", 1.0)
    every = scratch.keep(octree.nodes(octree.leaves(leafed)), "_nodes", path)
    progress("leaves", 1.0)
    owned = sampling.lod_owners(leafed, cube, options.grid_size(total), options.sampling).select("point_id", "owner_level")
    owned = leafed.join(owned, "point_id").withColumn("node", spatial.path(F.col("morton"), F.col("owner_level")))
    owned = owned.withColumn("batch", F.substring("node", 1, options.step_size + 1))
    # A batch is dealt over several tasks by the chunk as well, and AQE cuts what is still large.
    owned.repartition("batch", "chunk").sortWithinPartitions("batch", "morton").write.mode("overwrite").partitionBy("batch").parquet(f"{path}/points")
    owned = spark.read.parquet(f"{path}/points")
    progress("sampling", 1.0)
    nodes = every.join(octree.child_masks(every), "node").join(octree.tight_boxes(owned), "node", "left").withColumn("num_points", F.coalesce("num_points", F.lit(0)))
    nodes.withColumn("spacing", F.lit(cube.edge / options.grid_size(total)) / F.pow(F.lit(2.0), F.col("level"))).write.mode("overwrite").parquet(f"{path}/nodes")
    attributes.statistics(points, attributes.attributes_of(points)).write.mode("overwrite").parquet(f"{path}/attributes")
    depth = spark.read.parquet(f"{path}/nodes").agg(F.max("level")).first()[0] or 0
    kept = [r.asDict() for r in spark.read.parquet(f"{path}/attributes").collect()]  # one row an attribute
    spark.createDataFrame([(json.dumps(metadata(name, cube, total, depth, options, kept)),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/metadata")
    for old in ("_leafed", "_nodes"):
        scratch.delete(spark, f"{path}/{old}")
    progress("writing", 1.0)
    return open_dataset(spark, path)


def open_dataset(spark: SparkSession, path: str) -> Dataset:
    read = lambda t: spark.read.parquet(f"{path}/{t}")
    return Dataset(read("points"), read("nodes"), read("chunks"), read("attributes"), json.loads(spark.read.text(f"{path}/metadata").first()[0]))
