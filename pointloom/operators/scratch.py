"""Tables written to the folder that driver and executors share, where a plan would otherwise be computed again."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """A new name in the folder of spark.checkpoint.dir; in local mode, as in tests, one of its own where that is unset."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="pointloom-")
    return f"{found.rstrip('/')}/levels-{uuid.uuid4().hex}"


def delete(spark: SparkSession, path: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(place, True)


def keep(frame: DataFrame, name: str, root: str | None = None) -> DataFrame:
    """frame as written to, and read from, a folder of its own, or `name` in `root`."""
    path = f"{root or folder(frame.sparkSession)}/{name}"
    frame.write.mode("overwrite").parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)
