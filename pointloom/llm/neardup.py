"""MinHash near-duplicates by a multi-index Hamming join.

A document's set of distinct five-word shingles is sketched by SYMBOLS minhash values of 16 bits, so that a key of four or
more symbols is met by chance only among more documents than there are. The distance of two
sketches is the number of symbols that differ; pairs within DISTANCE are all found: with CHUNKS chunks at least one
chunk has at most DISTANCE // CHUNKS = 1 error, and each chunk is indexed once for each place where that error may be.
At a Jaccard similarity of 0.85 a symbol differs with a probability under 0.15, so a linked pair is outside DISTANCE
with a probability under 1e-5. Below 0.85 the WIDE sketch holds the same bound at 0.80. Every link is then confirmed on the full shingle sets.

Documents with equal sets are one class from the start. Within an index bucket, members are first compared with the
bucket's smallest id only (as many pairs as rows); what these links join needs no further comparison, and only pairs
whose components still differ are compared afterwards, in blocks of bounded size. Members of one family carry what they
lack and have beyond the family's reference text, which gives the exact similarity of any two of them within the task;
only other pairs are confirmed by a join of their texts. So a group of n near copies moves about n rows, and no link
between different components is lost.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import _text
from ._spark import Scratch, blocks
from .components import connected_components

SYMBOLS, DISTANCE, CHUNKS = 64, 23, 12
#: Rows of one bucket that are compared in one task.
BLOCK_ROWS = 2048
#: Shingles by which a family's member may differ from the reference and still carry the difference.
MOST_CHANGES = 512
_U = np.uint64


class Plan(NamedTuple):
    """A sketch's symbols, the distance within which pairs are found, and the chunks that are indexed."""

    symbols: int
    distance: int
    chunks: int

    def edges(self) -> np.ndarray:
        return np.linspace(0, self.symbols, self.chunks + 1).round().astype(int)


USUAL, WIDE = Plan(SYMBOLS, DISTANCE, CHUNKS), Plan(96, 37, 19)
_FACTORS = np.random.default_rng(85).integers(1, 1 << 63, WIDE.symbols, dtype=np.uint64) * _U(2) + _U(1)
_EDGES = USUAL.edges()

_SKETCH = "doc_id long, n_shingles long, k1 long, k2 long, sketch binary"


def shingle_sets(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    h, first, *_ = _text.words(texts)
    return _text.unique_by_text(*_text.shingles(h, first))


def plan_of(similarity: int) -> Plan:
    return USUAL if similarity >= 85 else WIDE


def _sketch(values: np.ndarray, at: np.ndarray, symbols: int = SYMBOLS) -> np.ndarray:
    out = np.zeros((len(at) - 1, symbols), dtype=np.uint16)
    rows = np.flatnonzero(np.diff(at) > 0)
    if len(rows):
        for k in range(symbols):
            out[rows, k] = (np.minimum.reduceat(values * _FACTORS[k], at[rows]) >> _U(20)).astype(np.uint16)
    return out


def _totals(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    total = np.zeros(len(values) + 1, dtype=np.uint64)
    np.cumsum(values, out=total[1:])
    return (total[at[1:]] - total[at[:-1]]).view(np.int64)


def _sketcher(symbols: int):
    def sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        np.seterr(over="ignore")
        for b in blocks(batches):
            values, at = shingle_sets(b.column("text").to_pylist())
            sketch = _sketch(values, at, symbols)
            yield pa.RecordBatch.from_arrays([
                b.column("doc_id"), pa.array(np.diff(at)), pa.array(_totals(_text.mix(values + _U(1)), at)), pa.array(_totals(_text.mix(values ^ _U(0x5851F42D4C957F2D)), at)),
                pa.array([x.tobytes() for x in sketch], pa.binary()),
            ], names=["doc_id", "n_shingles", "k1", "k2", "sketch"])

    return sketches


def _confirmer(similarity: int):
    """Keeps (u, v) whose texts have 100 * |A & B| >= similarity * |A | B| on full shingle sets."""

    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        np.seterr(over="ignore")
        for whole in batches:
            for b in blocks([whole], "text_u"):
                us, ui = np.unique(b.column("u").to_numpy(), return_index=True)
                vs, vi = np.unique(b.column("v").to_numpy(), return_index=True)
                left, lat = shingle_sets(b.column("text_u").take(pa.array(ui)).to_pylist())
                right, rat = shingle_sets(b.column("text_v").take(pa.array(vi)).to_pylist())
                keep = np.zeros(b.num_rows, dtype=bool)
                for k, (i, j) in enumerate(zip(np.searchsorted(us, b.column("u").to_numpy()), np.searchsorted(vs, b.column("v").to_numpy()), strict=True)):
                    x, y = left[lat[i] : lat[i + 1]], right[rat[j] : rat[j + 1]]
                    if len(x) and len(y) and 100 * min(len(x), len(y)) >= similarity * max(len(x), len(y)):
                        place = np.minimum(np.searchsorted(y, x), len(y) - 1)
                        both = int(np.count_nonzero(y[place] == x))
                        keep[k] = 100 * both >= similarity * (len(x) + len(y) - both)
                yield b.select(["u", "v"]).filter(pa.array(keep))

    return confirm


def _keys(plan: Plan) -> list:
    """One index key for each chunk and each place of its one allowed error."""
    out, edges = [], plan.edges()
    for c in range(plan.chunks):
        lo, hi = int(edges[c]), int(edges[c + 1])
        for hole in range(lo, hi):
            out.append(F.struct(F.lit(hole).alias("hole"), F.xxhash64(F.lit(hole), F.expr(f"substring(sketch, {2 * lo + 1}, {2 * (hole - lo)})"), F.expr(f"substring(sketch, {2 * hole + 3}, {2 * (hi - hole - 1)})")).alias("key")))
    return out


def _changes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(u, text_u, v, text_v) -> (id, ref, lacks, beyond): shingles of the reference u that v lacks, and those of v beyond it."""
    np.seterr(over="ignore")
    for b in blocks(batches, "text_v"):
        us, ui = np.unique(b.column("u").to_numpy(), return_index=True)
        left, lat = shingle_sets(b.column("text_u").take(pa.array(ui)).to_pylist())
        right, rat = shingle_sets(b.column("text_v").to_pylist())
        lacks, beyond = [], []
        for k, i in enumerate(np.searchsorted(us, b.column("u").to_numpy())):
            x, y = left[lat[i] : lat[i + 1]], right[rat[k] : rat[k + 1]]
            less, more = np.setdiff1d(x, y, assume_unique=True), np.setdiff1d(y, x, assume_unique=True)
            small = len(less) + len(more) <= MOST_CHANGES
            lacks.append(less.tobytes() if small else None)
            beyond.append(more.tobytes() if small else None)
        yield pa.RecordBatch.from_arrays([b.column("v"), b.column("u"), pa.array(lacks, pa.binary()), pa.array(beyond, pa.binary())], names=["id", "ref", "lacks", "beyond"])


class _Exact:
    """Exact similarity of two members of one family from their changes; joins those that are linked."""

    def __init__(self, b: pa.Table, similarity: int):
        self.n, self.ref = b.column("n_shingles").to_numpy(), b.column("ref").to_numpy(zero_copy_only=False)
        self.lacks, self.beyond = b.column("lacks"), b.column("beyond")
        self.known = b.column("lacks").is_valid().to_numpy(zero_copy_only=False) if b.num_rows else np.zeros(0, bool)
        self.sets: dict[int, tuple[frozenset, frozenset]] = {}
        self.similarity = similarity
        self.up: dict[int, int] = {}

    def top(self, x: int) -> int:
        while (y := self.up.get(x, x)) != x:
            self.up[x] = self.up.get(y, y)
            x = y
        return x

    def of(self, i: int) -> tuple[frozenset, frozenset]:
        if i not in self.sets:
            self.sets[i] = tuple(frozenset(np.frombuffer(c[i].as_py(), np.uint64).tolist()) for c in (self.lacks, self.beyond))
        return self.sets[i]

    def linked(self, i: int, j: int) -> bool:
        (less, more), (less2, more2) = self.of(i), self.of(j)
        whole = int(self.n[i]) + len(less) - len(more)  # of the reference
        both = whole - len(less) - len(less2) + len(less & less2) + len(more & more2)
        return 100 * both >= self.similarity * (int(self.n[i]) + int(self.n[j]) - both)


def _pairs_of(b: pa.Table, similarity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs within the groups (rows next to each other) of different components, within the plan's distance: u, v, confirmed.

    A pair that several index keys bring together is looked at for the first of these keys only. Where a group is made of
    two blocks, pairs are between the blocks. Pairs of one family are decided here and given only where they join something.
    """
    plan = plan_of(similarity)
    edges = plan.edges()
    sketch = np.frombuffer(b"".join(b.column("sketch").to_pylist()), dtype=np.uint16).reshape(b.num_rows, plan.symbols)
    ids, comp, hole, key, lo, hi, side, n = (b.column(c).to_numpy() for c in ("id", "component", "hole", "key", "lo", "hi", "side", "n_shingles"))
    new = np.ones(len(ids), bool)
    new[1:] = (key[1:] != key[:-1]) | (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1])
    start = np.flatnonzero(new)
    last = np.append(start[1:], len(ids))[np.cumsum(new) - 1]
    own = last - np.arange(len(ids)) - 1
    total = np.cumsum(own)
    exact = _Exact(b, similarity)
    us, vs, sure = [], [], []
    at = 0
    while at < len(ids):
        to = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + 400_000, "right")))
        some = own[at:to]
        i = np.repeat(np.arange(at, to), some)
        j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(some) - some, some)
        keep = (comp[i] != comp[j]) & ((lo[i] == hi[i]) | (side[i] != side[j])) & (100 * np.minimum(n[i], n[j]) >= similarity * np.maximum(n[i], n[j]))
        i, j = i[keep], j[keep]
        differ = sketch[i] != sketch[j]
        keep = differ.sum(axis=1) <= plan.distance
        i, j, differ = i[keep], j[keep], differ[keep]
        at = to
        if not len(i):
            continue
        errors = np.add.reduceat(differ.astype(np.int8), edges[:-1], axis=1)
        chunk = np.argmax(errors <= 1, axis=1)
        inside = (np.arange(plan.symbols)[None, :] >= edges[chunk][:, None]) & (np.arange(plan.symbols)[None, :] < edges[chunk + 1][:, None])
        wrong = np.argmax(differ & inside, axis=1)
        first = np.where(errors[np.arange(len(i)), chunk] == 0, edges[chunk], wrong)
        keep = first == hole[i]
        i, j = i[keep], j[keep]
        family = exact.known[i] & exact.known[j] & (exact.ref[i] == exact.ref[j])
        for x, y in zip(i[family].tolist(), j[family].tolist(), strict=True):
            a, c = exact.top(int(comp[x])), exact.top(int(comp[y]))
            if a != c and exact.linked(x, y):
                exact.up[a] = c
                us.append(int(ids[x]))
                vs.append(int(ids[y]))
                sure.append(True)
        us += ids[i[~family]].tolist()
        vs += ids[j[~family]].tolist()
        sure += [False] * int((~family).sum())
    u, v = np.array(us, np.int64), np.array(vs, np.int64)
    return np.minimum(u, v), np.maximum(u, v), np.array(sure, bool)


def _comparer(similarity: int):
    """Rows come sorted by group; a group (two blocks at most) is held whole, whichever batches it came in."""

    def out(table: pa.Table) -> pa.RecordBatch:
        u, v, sure = _pairs_of(table.combine_chunks(), similarity)
        return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v), pa.array(sure)], names=["u", "v", "sure"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        for b in batches:
            if not b.num_rows:
                continue
            held.append(b)
            table = pa.Table.from_batches(held)
            group = [table.column(c).to_numpy() for c in ("key", "lo", "hi")]
            same = np.logical_and.reduce([g == g[-1] for g in group])
            cut = len(same) - int(np.argmin(same[::-1])) if not same.all() else 0
            if cut:
                yield out(table.slice(0, cut))
                held = table.slice(cut).to_batches()
        if held:
            yield out(pa.Table.from_batches(held))

    return compare


def near_duplicates(docs: DataFrame, similarity: int = 85) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for each row of docs (doc_id, text; other columns are not read).

    similarity: percent, 80 at least. Null, empty and white-space texts have empty sets and are linked with nothing.
    Repeated rows keep a row each; a row without doc_id is linked with nothing, has a null component and is kept.
    Texts of any length are whole; of equal sets the smallest id stands for all. An empty table gives an empty table.
    """
    if similarity < 80:
        raise ValueError("the sketch distance guarantees pairs of 80 percent at least")
    plan = plan_of(similarity)
    spark: SparkSession = docs.sparkSession
    scratch = Scratch(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = scratch.keep(docs.mapInArrow(_sketcher(plan.symbols), _SKETCH), "sketches")
    known = rows.where("doc_id is not null and n_shingles > 0")
    classes = scratch.keep(known.groupBy("k1", "k2", "n_shingles").agg(F.min("doc_id").alias("rep")), "sets")
    rows = scratch.keep(rows.join(classes, ["k1", "k2", "n_shingles"], "left").select("doc_id", "n_shingles", "rep", F.when(F.col("doc_id") == F.col("rep"), F.col("sketch")).alias("sketch")), "classes")
    scratch.drop("sketches", "sets")

    # Sets that differ have at most 5/6 in common when one of them has five shingles or fewer.
    least = 6 if similarity > 83 else 1
    reps = rows.where(f"sketch is not null and n_shingles >= {least}").select(F.col("rep").alias("id"), "n_shingles", "sketch").dropDuplicates(["id"])
    reps = scratch.keep(reps, "reps")  # a plain table, so that the joins on a family's head can split it
    index = reps.select("id", F.inline(F.array(*_keys(plan))))
    heads = index.groupBy("key").agg(F.min("id").alias("head"), F.count("*").alias("n")).where("n > 1")
    shared = scratch.keep(index.join(heads, "key").select("hole", "key", "n", "head", "id"), "shared")

    sketches = reps.select(F.col("id"), "sketch", "n_shingles")
    # Two links a document at most: to the smallest head of its buckets, and to the head that it meets most often.
    met = shared.where("id <> head").groupBy("id", "head").agg(F.count("*").alias("times"))
    ends = met.groupBy("id").agg(F.min("head").alias("low"), F.max(F.struct("times", -F.col("head"))).alias("most"))
    ends = scratch.keep(ends, "ends")
    star = ends.select(F.explode(F.array_distinct(F.array("low", -F.col("most.col2")))).alias("u"), F.col("id").alias("v"))
    star = star.join(sketches.toDF("u", "su", "nu"), "u").join(sketches.toDF("v", "sv", "nv"), "v")
    star = star.where(f"100 * least(nu, nv) >= {similarity} * greatest(nu, nv)").select("u", "v")
    wanted = shared.select("id").distinct()
    texts = scratch.keep(docs.join(wanted.withColumnRenamed("id", "doc_id"), "doc_id", "left_semi").dropDuplicates(["doc_id"]), "texts")

    def confirmed(pairs: DataFrame) -> DataFrame:
        with_text = pairs.join(texts.toDF("u", "text_u"), "u").join(texts.toDF("v", "text_v"), "v")
        return with_text.mapInArrow(_confirmer(similarity), "u long, v long")

    links = scratch.keep(confirmed(star), "links1")
    joined = scratch.keep(connected_components(links, scratch, "cc1_"), "joined")

    # Buckets in which components still differ: compare across components, in blocks.
    member = shared.join(joined, "id", "left").select("hole", "key", "n", "id", F.coalesce("component", "id").alias("component"))
    mixed = member.groupBy("key").agg(F.min("component").alias("a"), F.max("component").alias("b")).where("a <> b").select("key")
    # A family's reference: the smallest head, and that one's in turn.
    low = ends.select("id", "low")
    refs = low.join(low.toDF("low", "lower"), "low", "left").select("id", F.coalesce("lower", "low").alias("ref"))
    alone = member.join(mixed, "key", "left_semi").select("id").distinct()
    refs = alone.join(refs, "id", "left").select(F.coalesce("ref", "id").alias("u"), F.col("id").alias("v"))
    changes = refs.join(texts.toDF("u", "text_u"), "u").join(texts.toDF("v", "text_v"), "v").mapInArrow(_changes, "id long, ref long, lacks binary, beyond binary")
    changes = scratch.keep(changes, "changes")
    rest = member.join(mixed, "key").join(sketches, "id").join(changes, "id").withColumn("parts", F.ceil(F.col("n") / BLOCK_ROWS).cast("int"))
    rest = rest.withColumn("own", F.pmod(F.xxhash64("id"), "parts").cast("int")).withColumn("mate", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    rest = rest.select("hole", "key", F.least("own", "mate").alias("lo"), F.greatest("own", "mate").alias("hi"), F.when(F.col("own") <= F.col("mate"), 0).otherwise(1).alias("side"), "id", "component", "n_shingles", "sketch", "ref", "lacks", "beyond")
    grouped = rest.repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi")
    pairs = scratch.keep(grouped.mapInArrow(_comparer(similarity), "u long, v long, sure boolean"), "pairs")
    more = scratch.keep(confirmed(pairs.where("not sure").select("u", "v")).union(pairs.where("sure").select("u", "v")), "links2")
    final = joined
    if more.take(1):  # links between components of the first round
        label = joined.withColumnRenamed("component", "label")
        between = more.join(label.toDF("u", "lu"), "u", "left").join(label.toDF("v", "lv"), "v", "left")
        between = between.select(F.coalesce("lu", "u").alias("u"), F.coalesce("lv", "v").alias("v"))
        merged = scratch.keep(connected_components(between, scratch, "cc2_"), "merged")
        moved = joined.join(merged.toDF("component", "to"), "component", "left").select("id", F.coalesce("to", "component").alias("component"))
        fresh = merged.join(joined.select("id"), "id", "left_anti").select("id", "component")
        final = scratch.keep(moved.union(fresh), "final")
    scratch.drop("shared", "texts", "reps")
    out = rows.join(final.toDF("rep", "component"), "rep", "left")
    component = F.coalesce("component", "rep", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))
