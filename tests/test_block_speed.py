"""Blocks: checksums of one value and shared prefixes agree with plain ones and cost little for each byte; decoded entries are handed on in few batches."""

from __future__ import annotations

import random
import time

import numpy as np
from pyspark.sql import functions as F

from cellstore.functions import codec
from cellstore.operators import blocks


def test_checksum_equals_the_one_byte_by_byte():
    rng = random.Random(1)
    for n in (*range(12), 255, 1023, 1024, 1025, 1026, 1027, 1028, 2047, 2048, 2051, 5000):
        data = rng.randbytes(n)
        assert codec.crc32c_bytes(data) == int(codec.crc32c_rows(np.frombuffer(data, np.uint8).reshape(1, -1))[0])


def test_checksum_does_not_take_a_step_of_numpy_for_each_byte():
    data = random.Random(2).randbytes(1 << 20)
    start = time.process_time()
    codec.crc32c_bytes(data)
    assert time.process_time() - start < 1  # byte by byte 5 s and more


def test_shared_length():
    for a, b, n in ((b"", b"", 0), (b"a", b"", 0), (b"abc", b"abd", 2), (b"abc", b"abcd", 3), (b"abc", b"abc", 3), (b"\0\0a", b"\0\0b", 2), (b"\0", b"\1", 0), (b"\0\0", b"\0\0\0", 2), (b"k" * 70_000 + b"a", b"k" * 70_000 + b"b", 70_000)):
        assert blocks.shared_length(a, b) == n == blocks.shared_length(b, a)


def test_round_trip_over_batches(spark, monkeypatch):
    rows = spark.range(3000).select((F.col("id") % 3).alias("segment"), F.format_string("key-%05d", "id").alias("k"), F.repeat(F.lit("v"), (F.col("id") % 9).cast("int")).alias("v"), "id")
    made = blocks.encode_blocks(rows, "k", "v", [F.col("id")], block_size=300).cache()
    want = sorted((i % 3, f"key-{i:05d}", "v" * (i % 9)) for i in range(3000))
    for told_rows, told_bytes in ((10_000, 1 << 22), (50, 1 << 22), (10_000, 1), (10_000, 1000)):
        monkeypatch.setattr(blocks, "TOLD_ROWS", told_rows)
        monkeypatch.setattr(blocks, "TOLD_BYTES", told_bytes)
        got = blocks.decode_blocks(made).collect()
        assert sorted((r.segment, bytes(r.key).decode(), bytes(r.value).decode()) for r in got) == want
        by = {}
        for r in got:
            by.setdefault((r.segment, r.block), []).append(r.place)
        assert all(sorted(p) == list(range(len(p))) for p in by.values()) and len(by) == made.count()
