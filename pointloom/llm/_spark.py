"""Small helpers shared by the training-data operators: materialisation in the shared folder, row blocks."""

from __future__ import annotations

import atexit
import gc
import tempfile
import threading
import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager, suppress

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Bytes of text that one vectorised kernel call works on; bounds a worker's scratch memory.
BLOCK_BYTES = 1_000_000


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which driver and executors share; where it is unset, one of local mode's own."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        found = spark.sparkContext._jsc.sc().getCheckpointDir()
        if found.isDefined():
            return found.get()
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="pointloom-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def free_name(frame: DataFrame, name: str) -> str:
    """name, with signs added until no column of the frame has it, whatever the case."""
    taken = {c.lower() for c in frame.columns}
    while name.lower() in taken:
        name += "_"
    return name


def _delete(spark: SparkSession, path: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(place, True)


_roots: list[tuple[SparkSession, str]] = []


@atexit.register
def _clear() -> None:
    """Frames read their scratch tables until the program ends; then the folders go."""
    for spark, root in _roots:
        with suppress(Exception):  # the JVM may be gone
            _delete(spark, root)


class Scratch:
    """Tables written to the shared folder, so that lineage ends there and a lost executor costs nothing but a reread."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.root = f"{shared_folder(spark).rstrip('/')}/pointloom-{uuid.uuid4().hex}"
        self.written = 0
        _roots.append((spark, self.root))

    def keep(self, frame: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}"
        frame.write.mode("overwrite").parquet(path)
        self.written += 1
        if self.written % 3 == 0:
            self.settle()
        return self.spark.read.schema(frame.schema).parquet(path)

    def settle(self) -> None:
        """Let the driver drop plans that nobody holds any more, and Spark the shuffle files of these."""
        gc.collect()
        self.spark.sparkContext._jvm.System.gc()

    def drop(self, *names: str) -> None:
        """Delete tables that no later step reads."""
        for name in names:
            _delete(self.spark, f"{self.root}/{name}")


def blocks(batches: Iterable[pa.RecordBatch], column: str = "text", size: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches into slices of about `size` bytes of `column`, at row ends; a longer text is a slice of its own."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        col = batch.column(column)
        if not pa.types.is_string(col.type) and not pa.types.is_large_string(col.type) and not pa.types.is_binary(col.type) and not pa.types.is_large_binary(col.type):
            yield batch
            continue
        import pyarrow.compute as pc

        lengths = pc.fill_null(pc.binary_length(col), 0).to_numpy(zero_copy_only=False)
        at = total = 0
        for i, n in enumerate(lengths):
            if total and total + n > size:
                yield batch.slice(at, i - at)
                at, total = i, 0
            total += int(n)
        yield batch.slice(at)


class Kept:
    """What a Python worker keeps from task to task, such as a tokenizer's cache; dropped when the worker is idle.

    Workers outlive their stage, and memory that they hold is missing in the next one.
    """

    def __init__(self, make: Callable, idle_seconds: float = 2.0):
        self.make, self.idle = make, idle_seconds
        self.held: dict = {}
        self.timer: threading.Timer | None = None

    @contextmanager
    def use(self, key) -> Iterator:
        if self.timer:
            self.timer.cancel()
        kept = self.held.get(key)
        if kept is None:
            kept = self.held[key] = self.make(key)
        try:
            yield kept
        finally:
            self.timer = threading.Timer(self.idle, self.drop)
            self.timer.daemon = True
            self.timer.start()

    def drop(self) -> None:
        self.held = {}
        gc.collect()
