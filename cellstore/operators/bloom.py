"""Bloom filters of segments as tables of set bits, and their stored form. For pruning, `segments.write` has Parquet's own."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.codec import bloom_probes

BITS, PROBES = 1 << 20, 4
#: Stored form: magic i64, k u8, bits i32 (big-endian), then the bits, the low one of each byte first. Fixed value: the magic number.
HEADER, MAGIC = ">qBi", 0xBF1DBEAD0B11


def build(keys: DataFrame, key: str, by: list[str], bits: int = BITS, k: int = PROBES) -> DataFrame:
    """The set bits of each group's filter: at most `bits` rows a group, made distinct before the shuffle."""
    return keys.select(*by, F.explode(bloom_probes(key, bits, k)).alias("bit")).distinct()


def might_contain(asked: DataFrame, key: str, filters: DataFrame, by: list[str], bits: int = BITS, k: int = PROBES) -> DataFrame:
    """asked with `maybe`: false means that the group surely lacks the key."""
    probed = asked.select(*asked.columns, F.explode(F.array_distinct(bloom_probes(key, bits, k))).alias("bit"))
    met = probed.join(filters.withColumn("_set", F.lit(1)), [*by, "bit"], "left")
    return met.groupBy(*asked.columns).agg(F.min(F.coalesce("_set", F.lit(0))).alias("_all")).select(*asked.columns, (F.col("_all") == 1).alias("maybe"))


def fill(filters: DataFrame, by: list[str], bits: int = BITS, k: int = PROBES) -> DataFrame:
    """Bits set and the false-positive rate that they imply."""
    n = filters.groupBy(*by).agg(F.count("*").alias("bits_set"))
    return n.withColumn("rate", F.round(F.pow(F.col("bits_set") / bits, F.lit(float(k))), 12))


def serialise(filters: DataFrame, by: list[str], bits: int = BITS, k: int = PROBES) -> DataFrame:
    """A row for each group: filter, in the stored form. A group has `bits` rows at most."""
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in filters.select(*by).schema)

    def run(table: pa.Table) -> pa.Table:
        have = np.zeros(-(-bits // 8) * 8, np.uint8)
        have[table.column("bit").to_numpy()] = 1
        data = struct.pack(HEADER, MAGIC, k, bits) + np.packbits(have, bitorder="little").tobytes()
        return table.select(by).slice(0, 1).append_column("filter", pa.array([data], pa.binary()))

    return filters.select(*by, "bit").groupBy(*by).applyInArrow(run, f"{kinds}, filter binary")


def load(stored: DataFrame, by: list[str], column: str = "filter") -> DataFrame:
    """The set bits of stored filters; a wrong magic number or length is an error. A null filter has none."""
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in stored.select(*by).schema)

    head = struct.calcsize(HEADER)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, data in enumerate(batch.column(column).to_pylist()):
                if data is None:
                    continue
                magic, _, bits = struct.unpack_from(HEADER, data) if len(data) >= head else (0, 0, 0)
                if magic != MAGIC or len(data) != head + -(-bits // 8):
                    raise ValueError("not a Bloom filter")
                found = np.flatnonzero(np.unpackbits(np.frombuffer(data, np.uint8, offset=head), bitorder="little")[:bits])
                own = [batch.column(c).take(pa.array(np.full(len(found), i))) for c in by]
                yield pa.RecordBatch.from_arrays([*own, pa.array(found, pa.int64())], [*by, "bit"])

    return stored.select(*by, column).mapInArrow(run, f"{kinds}, bit long")
