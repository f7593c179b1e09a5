"""Point tables derived from the tabular sources; every one has point_id, x, y, z."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def points_of_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = lambda k: F.col("embedding")[k].cast("double")
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("point_id"), at(0).alias("x"), at(1).alias("y"), at(2).alias("z"), F.col("label").alias("classification"))


def points_of_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.datediff(F.to_date("o_orderdate"), F.lit("1995-01-01"))
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("point_id"), (F.col("o_totalprice") / 1000.0).alias("x"), (day / 10.0).alias("y"), (F.col("o_custkey") % 1000 / 10.0).alias("z"))


def points_of_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    """No unique key: point_id is the order's."""
    rgb = [(F.col("l_suppkey") * k % 65536).cast("int").alias(c) for c, k in (("r", 7919), ("g", 104729), ("b", 1299709))]
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("point_id"), F.col("l_quantity").alias("x"), (F.col("l_extendedprice") / 1000.0).alias("y"), (F.col("l_discount") * 100.0).alias("z"),
        (F.col("l_partkey") % 65536).cast("int").alias("intensity"), F.col("l_linenumber").alias("classification"), *rgb,
    )


def clicks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Picks of viewers: one session per user, in the order of event_id."""
    e = table(spark, sf_dir, "events").where("event_type = 'click'")
    return e.select("event_id", F.col("user_id").alias("session"), "ts", F.col("value").alias("x"), F.minute("ts").cast("double").alias("y"), F.col("user_id").cast("double").alias("z"))


def grid_points(spark: SparkSession, side: int = 10) -> DataFrame:
    """The deterministic side ** 3 integer grid used as a fixture: class 2, colours from the row number."""
    i = F.col("id")
    return spark.range(side**3).select(
        i.alias("point_id"), (i % side).cast("double").alias("x"), (F.floor(i / side) % side).cast("double").alias("y"), F.floor(i / (side * side)).cast("double").alias("z"),
        F.lit(2).cast("short").alias("classification"), *[(i * k % 256 * 257).cast("int").alias(c) for c, k in (("r", 1), ("g", 3), ("b", 7))],
    )
