"""ASCII rooms: lines of x y z r g b, one file for each room, bad lines counted and left out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.codec import colour_8_to_16

#: area and room from a path such as .../Area_1/office_2/office_2.txt
MEMBER = r"Area_(\d+)/([A-Za-z]+_\d+)/\2\.txt$"


def parse_lines(lines: DataFrame, line: str = "value") -> DataFrame:
    """lines with x, y, z, r, g, b (16-bit colours) and whether the line is bad; white space separates."""
    parts = F.split(F.trim(line), r"\s+")
    number = lambda k: F.expr(f"try_cast(parts[{k}] as double)")
    out = lines.withColumn("parts", parts).withColumns({n: F.when(F.size("parts") >= 6, number(k)) for k, n in enumerate(("x", "y", "z", "r", "g", "b"))})
    out = out.withColumn("bad", F.greatest(*[F.col(c).isNull().cast("int") for c in ("x", "y", "z", "r", "g", "b")]) == 1)
    return out.withColumns({c: colour_8_to_16(F.col(c).cast("int")) for c in "rgb"}).drop("parts")


def read_rooms(spark: SparkSession, path: str) -> DataFrame:
    """All lines of the room files under a folder, with area and room; files of other names are skipped."""
    lines = spark.read.option("recursiveFileLookup", "true").text(path).withColumn("file", F.input_file_name())
    lines = lines.where(F.col("file").rlike(MEMBER)).select("value", F.regexp_extract("file", MEMBER, 1).cast("int").alias("area"), F.regexp_extract("file", MEMBER, 2).alias("room"))
    return parse_lines(lines)
