"""The binary exchange form of a dataset: metadata.json, hierarchy.bin and octree.bin.

A node's record has 22 bytes: type, child mask, points, and the address and size of its rows in octree.bin. Records stand
in the order by length, then name. Nodes of depth step_size and below are in one batch for each ancestor of that depth;
the first batch has the nodes above, and a record of type PROXY with address and size of each further batch. Rows are 12
bytes of position (int32, scaled), and 6 of colour where there is one. With neighbour trees, kdtree.bin holds one for each
node with points, and kdtree_index.bin for each the length of the name (one byte), the name, address and size.

All addresses follow from sums over the nodes, so that tasks write into the files at their own places; only the nodes of
the first batch, and a number for each batch, pass through the driver. The folder is one that driver and executors share.
"""

from __future__ import annotations

import json
import struct
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from ..functions import spatial
from ..functions.codec import Attribute, encode
from ..functions.spatial import Cube
from ..operators import kdtree
from ..operators.scratch import keep

NORMAL, LEAF, PROXY = 0, 1, 2
RECORD = struct.Struct("<BBIQQ")


def _addressed(rows: DataFrame, size: str, address: str) -> DataFrame:
    """rows (node, batch, size) with the sum of the sizes before; summed within batches, then over batches."""
    order = W.partitionBy("batch").orderBy(F.length("node"), "node")
    rows = rows.withColumn("within", F.sum(size).over(order.rowsBetween(W.unboundedPreceding, 0)) - F.col(size))
    totals = rows.groupBy("batch").agg(F.sum(size).alias("total"))
    start = F.sum("total").over(W.orderBy(F.length("batch"), "batch").rowsBetween(W.unboundedPreceding, 0)) - F.col("total")
    return rows.join(totals.select("batch", start.alias("start")), "batch").withColumn(address, F.col("start") + F.col("within")).drop("start", "within")


def hierarchy(nodes: DataFrame, step_size: int, stride: int) -> DataFrame:
    """nodes (node, child_mask, num_points) with batch, and address and size of their rows."""
    depth = F.length("node") - 1
    rows = nodes.select("node", "child_mask", "num_points", F.when(depth < step_size, F.lit("r")).otherwise(F.substring("node", 1, step_size + 1)).alias("batch"), (F.col("num_points") * stride).alias("size"))
    return _addressed(rows, "size", "address")


def _make(path: Path, size: int) -> str:
    with path.open("wb") as f:
        f.truncate(size)
    return str(path)


def _put(path: str, at: int, data: bytes) -> None:
    with open(path, "r+b") as f:
        f.seek(at)
        f.write(data)


def write(points: DataFrame, nodes: DataFrame, metadata: dict, folder: str, scale: float = 0.001, neighbours: bool = False) -> dict:
    """points (node, x, y, z, and r, g, b or not), nodes (node, child_mask, num_points) -> the files; returns the metadata."""
    out = Path(folder)
    out.mkdir(parents=True, exist_ok=True)
    low = metadata["boundingBox"]["min"]
    colour = {"r", "g", "b"} <= set(points.columns)
    stride, step = 12 + 6 * colour, metadata["hierarchy"]["stepSize"]
    kind = np.dtype([(f"q{a}", "<i4") for a in "xyz"] + [(c, "<u2") for c in "rgb"] * colour)
    raw = points.select("node", *[encode(F.col(a), Attribute(a, "int32", scale, low[k])).alias(f"q{a}") for k, a in enumerate("xyz")], *(["r", "g", "b"] if colour else []))

    placed = hierarchy(nodes, step, stride)
    full = F.col("num_points") > 0
    placed = placed.withColumn("tree_size", F.when(full, F.col("num_points") * kdtree.ENTRY.itemsize + 8).otherwise(0)).withColumn("name_size", F.when(full, F.length("node") + 17).otherwise(0))
    placed = keep(_addressed(_addressed(placed, "tree_size", "tree_address"), "name_size", "name_address"), "placed")
    totals = placed.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("size", "tree_size", "name_size")]).first()
    rows_at = _make(out / "octree.bin", totals["size"])
    trees_at, names_at = (_make(out / f, totals[c]) if neighbours else "" for f, c in (("kdtree.bin", "tree_size"), ("kdtree_index.bin", "name_size")))

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        own = pdf.iloc[0]
        rows = np.zeros(len(pdf), kind)
        for c in kind.names:
            rows[c] = pdf[c]
        _put(rows_at, int(own.address), rows.tobytes())
        if neighbours:
            xyz = np.stack([rows[f"q{a}"] * scale + low[k] for k, a in enumerate("xyz")], axis=1)
            _put(trees_at, int(own.tree_address), kdtree.pack(kdtree.build(xyz)))
            name = own.node.encode()
            _put(names_at, int(own.name_address), struct.pack("<B", len(name)) + name + struct.pack("<QQ", int(own.tree_address), int(own.tree_size)))
        return pd.DataFrame({"points": [len(pdf)]})

    where_to = placed.select("node", "address", "tree_address", "tree_size", "name_address")
    raw.join(where_to, "node").groupBy("node").applyInPandas(pack, "points long").agg(F.sum("points")).collect()

    fields = ["node", "child_mask", "num_points", "address", "size"]
    counts = {r["batch"]: r["n"] for r in placed.groupBy("batch").agg(F.count("*").alias("n")).collect()}  # 8 ** step_size at most
    top = placed.where("batch = 'r'").select(*fields).collect()  # those above step_size
    packed = lambda r: struct.pack("<BBIQQ", *record(r))  # noqa: E731  a Struct does not travel
    record = lambda r: (LEAF if r.child_mask == 0 else NORMAL, int(r.child_mask), int(r.num_points), int(r.address), int(r.size))
    further = sorted(b for b in counts if b != "r")
    cursor, where = (len(top) + len(further)) * RECORD.size, {}
    for b in further:
        where[b] = (cursor, counts[b] * RECORD.size)
        cursor += where[b][1]
    first = [(r.node, *record(r)) for r in top] + [(b, PROXY, 0, 0, *where[b]) for b in further]
    nodes_at = _make(out / "hierarchy.bin", cursor)
    _put(nodes_at, 0, b"".join(RECORD.pack(*rest) for _, *rest in sorted(first, key=lambda r: (len(r[0]), r[0]))))

    def put_batch(pdf: pd.DataFrame) -> pd.DataFrame:
        own = sorted(pdf.itertuples(), key=lambda r: (len(r.node), r.node))
        _put(nodes_at, where[pdf["batch"].iloc[0]][0], b"".join(map(packed, own)))
        return pd.DataFrame({"nodes": [len(own)]})

    placed.where("batch <> 'r'").select("batch", *fields).groupBy("batch").applyInPandas(put_batch, "nodes long").agg(F.sum("nodes")).collect()
    attributes = [{"name": "position", "description": "", "size": 12, "numElements": 3, "elementSize": 4, "type": "int32", "min": low, "max": metadata["boundingBox"]["max"], "scale": [scale] * 3, "offset": low}]
    if colour:
        attributes.append({"name": "rgb", "description": "", "size": 6, "numElements": 3, "elementSize": 2, "type": "uint16", "min": [0] * 3, "max": [65535] * 3, "scale": [1] * 3, "offset": [0] * 3})
    metadata = metadata | {"scale": [scale] * 3, "offset": low, "attributes": attributes, "hierarchy": metadata["hierarchy"] | {"firstChunkSize": len(first) * RECORD.size}}
    (out / "metadata.json").write_text(json.dumps(metadata, indent=2))
    return metadata


def read_neighbour_index(spark: SparkSession, folder: str) -> DataFrame:
    """(node, address, size) of the neighbour trees; empty where there are none. Names have no fixed length, so one task
    reads the file, of some 30 bytes a node."""
    path = str(Path(folder) / "kdtree_index.bin")

    def read(pdfs):
        for _ in pdfs:
            data, at, rows = Path(path).read_bytes() if Path(path).exists() else b"", 0, []
            while at < len(data):
                end = at + 1 + data[at]
                if end + 16 > len(data):
                    raise ValueError("the index of neighbour trees ends within an entry")
                rows.append((data[at + 1 : end].decode(), *struct.unpack_from("<QQ", data, end)))
                at = end + 16
            yield pd.DataFrame(rows, columns=["node", "address", "size"])

    return spark.range(1).repartition(1).mapInPandas(read, "node string, address long, size long")


def read_neighbours(index: DataFrame, folder: str) -> DataFrame:
    """index (node, address, size), such as a selection's -> the entries of its trees: node, entry, point, x, y, z, axis, left, right."""
    path = str(Path(folder) / "kdtree.bin")

    def read(pdfs):
        for pdf in pdfs:
            with open(path, "rb") as f:
                for r in pdf.itertuples():
                    f.seek(r.address)
                    e = kdtree.unpack(f.read(r.size))
                    yield pd.DataFrame({"node": r.node, "entry": np.arange(len(e))} | {c: e[c].astype("float64" if c in "xyz" else "int64") for c in e.dtype.names})

    return index.mapInPandas(read, "node string, entry long, point long, x double, y double, z double, axis long, left long, right long")


def _batch(data: bytes, root: str) -> list[tuple]:
    """Records of one batch by the order in which children follow their parents: (name, type, mask, points, address, size)."""
    if len(data) % RECORD.size or not data:
        raise ValueError("a batch of the hierarchy is no whole number of records")
    names, out = [root], []
    for k, r in enumerate(RECORD.iter_unpack(data)):
        if k >= len(names):
            raise ValueError("more records than children")
        kind, mask, n, address, size = r
        out.append((names[k], kind, mask, n if size else 0, address, size))
        if kind != PROXY:
            names += [f"{names[k]}{c}" for c in range(8) if mask >> c & 1]
    return out


def read_metadata(folder: str) -> dict:
    return json.loads((Path(folder) / "metadata.json").read_text())


def read_nodes(spark: SparkSession, folder: str) -> DataFrame:
    """node, level, node_type, child_mask, num_points, address, size, spacing and the node's cube (min_x .. max_z).

    The first batch is read by the driver; every further batch is decoded by a task.
    """
    meta = read_metadata(folder)
    path = str(Path(folder) / "hierarchy.bin")
    with open(path, "rb") as f:
        first = _batch(f.read(meta["hierarchy"]["firstChunkSize"]), "r")
    schema = "node string, node_type int, child_mask int, num_points long, address long, size long"
    top = spark.createDataFrame([r for r in first if r[1] != PROXY], schema)
    proxies = spark.createDataFrame([(r[0], r[4], r[5]) for r in first if r[1] == PROXY], "name string, address long, size long")

    def decode(pdfs):
        for pdf in pdfs:
            rows = []
            with open(path, "rb") as f:
                for r in pdf.itertuples():
                    f.seek(r.address)
                    rows += _batch(f.read(r.size), r.name)
            yield pd.DataFrame(rows, columns=["node", "node_type", "child_mask", "num_points", "address", "size"])

    nodes = top.union(proxies.mapInPandas(decode, schema))
    low, high = meta["boundingBox"]["min"], meta["boundingBox"]["max"]
    x, y, z, edge = spatial.box_of("node", Cube(*low, high[0] - low[0]))
    level = F.length("node") - 1
    out = nodes.withColumn("level", level).withColumn("spacing", F.lit(meta["spacing"]) / F.pow(F.lit(2.0), level))
    return out.withColumns({f"min_{a}": c for a, c in zip("xyz", (x, y, z), strict=True)} | {f"max_{a}": c + edge for a, c in zip("xyz", (x, y, z), strict=True)})


def read_points(nodes: DataFrame, folder: str) -> DataFrame:
    """nodes (node, address, size), such as a selection -> node, x, y, z and colours: only these nodes' rows are read."""
    meta = read_metadata(folder)
    known = {a["name"]: a for a in meta["attributes"]}
    colour = "rgb" in known
    kind = np.dtype([("p", "<i4", 3)] + [("c", "<u2", 3)] * colour)
    scale, offset = np.array(known["position"]["scale"]), np.array(known["position"]["offset"])
    path = str(Path(folder) / "octree.bin")

    def decode(pdfs):
        for pdf in pdfs:
            for r in pdf.itertuples():
                rows = np.fromfile(path, kind, count=r.size // kind.itemsize, offset=r.address)
                xyz = rows["p"] * scale + offset
                yield pd.DataFrame({"node": r.node} | {a: xyz[:, k] for k, a in enumerate("xyz")} | ({c: rows["c"][:, k].astype("int32") for k, c in enumerate("rgb")} if colour else {}))

    return nodes.where("size > 0").select("node", "address", "size").mapInPandas(decode, "node string, x double, y double, z double" + (", r int, g int, b int" if colour else ""))
