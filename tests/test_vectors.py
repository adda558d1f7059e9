"""Public vectors of the hashes, and the range sharder's config."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from cellstore.functions import codec
from cellstore.operators.sharding import ModSharder, RangeSharder


def test_hash_vectors(spark):
    want = {"": 0x00000000, "a": 0x3C2569B2, "test": 0xBA6BD213, "abcd": 0x43ED676A, "Hello, world!": 0xC0363E43}
    df = spark.createDataFrame([(k,) for k in want], "k string")
    rows = df.select("k", codec.murmur3_32("k").alias("h"), ModSharder().shard_of("k", 8).alias("s"), codec.crc32c(F.lit("123456789")).alias("c")).collect()
    assert {r.k: r.h for r in rows} == want
    assert {r.k: r.s for r in rows} == {"": 0, "a": 2, "test": 3, "abcd": 2, "Hello, world!": 3}
    assert {r.c for r in rows} == {0xE3069283}


def test_range_sharder():
    by = RangeSharder(["m", "s"])
    assert RangeSharder.from_config(by.config).boundaries == ["m", "s"]
    for bad in ([], ["s", "m"], ["m", "m"]):
        with pytest.raises(ValueError):
            RangeSharder(bad)
