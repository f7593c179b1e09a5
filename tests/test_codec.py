import pytest
from pyspark.sql import functions as F

from pointloom.functions import codec
from pointloom.functions.codec import Attribute


def one(spark, *columns):
    return list(spark.range(1).select(*[c.alias(f"c{k}") for k, c in enumerate(columns)]).first())


def test_clamp_to_unsigned_byte(spark):
    a = Attribute("classification", "uint8")
    assert one(spark, codec.encode(F.lit(300.0), a), codec.encode(F.lit(-10.0), a)) == [255, 0]


def test_requantise_with_another_offset(spark):
    got = [one(spark, codec.recode(F.lit(raw), Attribute("p", "int32", 0.001), Attribute("p", "int32", 0.001, off)))[0] for raw, off in ((12345, 10.0), (67890, 20.0), (-100, -1.0))]
    assert got == [2345, 47890, 900]


def test_equal_layouts_pass_the_bare_column():
    c = object()
    assert codec.recode(c, Attribute("p"), Attribute("p")) is c


def test_truncates_towards_zero_and_handles_nan_and_range(spark):
    a = Attribute("v", "int16")
    assert one(spark, codec.encode(F.lit(1.9), a), codec.encode(F.lit(-1.9), a), codec.encode(F.lit(float("nan")), a), codec.encode(F.lit(1e99), a)) == [1, -1, 0, 32767]
    assert one(spark, codec.encode(F.lit(1e99), Attribute("v", "int64")), codec.encode(F.lit(-1e99), Attribute("v", "int64"))) == [2**63 - 1, -(2**63)]


def test_unknown_type():
    with pytest.raises(ValueError):
        Attribute("v", "undefined")


def test_colours_slugs_and_numbers(spark):
    assert one(spark, codec.colour_8_to_16(F.lit(300)), codec.colour_8_to_16(F.lit(-1)), codec.colour_share(F.lit(None).cast("int"))) == [65535, 0, 0.8]
    assert one(spark, codec.slug(F.lit("My scan (1)!")), codec.slug(F.lit("***")), codec.thousands(F.lit(49000000))) == ["My_scan_1", "project", "49,000,000"]
