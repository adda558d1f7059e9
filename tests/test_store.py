"""The store on disk, its log, blocks, and record files."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from cellstore.operators import blocks, cells
from cellstore.operators.sharding import ModSharder, RangeSharder
from cellstore.sources import legacy
from cellstore.sources.store import Store
from cellstore.streaming import log

SCHEMA = log.SCHEMA


def ops(spark, *rows):
    return spark.createDataFrame([(r, 0, c, t, "DELETE" if v is None else "PUT", v, q) for r, c, t, v, q in rows], SCHEMA)


def values(df):
    return {(r.row_key, r.column_key): r.value for r in cells.get_as_of(df).collect()}


def test_open_append_flush_reopen(spark, tmp_path):
    by, at = RangeSharder(["m"]), f"{tmp_path}/store"
    store = Store(spark, at, by, 2)
    assert store.cells().count() == 0 and store.flush() is None and store.manifest().count() == 0
    store.append(ops(spark, ("a", "c", 1, "old", 1), ("z", "c", 1, "zed", 2)))
    assert values(store.cells()) == {("a", "c"): "old", ("z", "c"): "zed"}
    assert store.flush() == 0 and store.flush() is None
    store.append(ops(spark, ("a", "c", 1, "new", 3), ("z", "c", 2, None, 4)))
    again = Store(spark, at, by, 2)
    assert values(again.cells()) == {("a", "c"): "new"}
    assert again.close() == 1
    assert values(Store(spark, at, by, 2).cells()) == {("a", "c"): "new"}
    assert [(r.number, r.entries, r.tombstones, r.last_seq) for r in again.manifest().orderBy("number").collect()] == [(0, 2, 0, 2), (1, 2, 1, 4)]
    files = again.segment_rows().select("number", "shard", "file").collect()
    assert all(f"/segments/{r.number}/shard={r.shard}/" in r.file for r in files) and len(files) == 4
    for other in (Store, lambda *a: Store(*a, ModSharder(), 2), lambda *a: Store(*a, RangeSharder(["n"]), 2), lambda *a: Store(*a, RangeSharder(["m"]), 3)):
        with pytest.raises(ValueError):
            other(spark, at)


def test_a_segment_without_a_manifest_row_does_not_count(spark, tmp_path):
    store = Store(spark, f"{tmp_path}/store")
    store.append(ops(spark, ("a", "c", 1, "v", 1)))
    ops(spark, ("ghost", "c", 1, "v", 1)).withColumn("shard", F.lit(0)).write.partitionBy("shard").parquet(f"{tmp_path}/store/segments/0")
    assert set(values(store.cells())) == {("a", "c")}
    assert store.flush() == 0 and set(values(store.cells())) == {("a", "c")}


def test_log_stream(spark, tmp_path):
    at = f"{tmp_path}/log"
    log.append(ops(spark, ("a", "c", 1, "old", 1), ("b", "c", 1, "x", 2)), at)
    log.append(ops(spark, ("a", "c", 2, "new", 3), ("b", "c", 1, None, 4)), at)
    query = log.keep_table(log.tail(spark, at), "newest_cells", f"{tmp_path}/checkpoint")
    query.processAllAvailable()
    query.stop()
    got = {r.row_key: (r.ts, r.entry_type, r.value) for r in spark.table("newest_cells").collect()}
    assert got == {"a": (2, "PUT", "new"), "b": (1, "DELETE", None)}
    for bad in (("a", "c", None, "v", 1), (None, "c", 1, "v", 1), ("a", "c", 1, "v", None)):
        with pytest.raises(ValueError):
            log.append(ops(spark, bad), at)


def test_record_files(spark, tmp_path):
    rows = [("a", "c", 1, "v", 1), ("ä" * 300, "", 2**62, "", 2), ("b", "c", -5, None, 3)]
    told = legacy.write(ops(spark, *rows).coalesce(1), f"{tmp_path}/records").collect()
    assert [r.records for r in told] == [3]
    got = legacy.read(spark, f"{tmp_path}/records").orderBy("seq").collect()
    assert [(r.row_key, r.column_key, r.ts, None if r.value is None else bytes(r.value).decode()) for r in got] == [r[:4] for r in rows]
    assert legacy.encode([("a", "b", 1, False, b"xy")]).hex() == "0001610001620000000000000001" + "00" + "000000027879"
    data = legacy.encode([("a", "b", 1, False, b"xy"), ("c", "d", 2, True, None)])
    assert len(list(legacy.decode(data))) == 2 and len(list(legacy.decode(data[:-3]))) == 1
    with pytest.raises(ValueError):
        legacy.write(ops(spark, ("a", "c", 1, "v", 1)).withColumn("value", F.lit(None).cast("string")), f"{tmp_path}/bad")
    with pytest.raises(ValueError):
        legacy.encode([("k" * 70_000, "", 1, True, None)])


def test_blocks(spark):
    b = blocks.Builder(restart=3)
    entries = [(f"key-{i:04d}".encode(), bytes([i]) * (i % 7)) for i in range(20)] + [("ü".encode(), b""), ("üa".encode(), b"z" * 1000)]
    shared = [b.add(k, v) for k, v in entries]
    assert shared[:4] == [0, 7, 7, 0] and b.estimate() == len(b.out) + 8 * len(b.restarts) + 8
    data = b.finish()
    assert list(blocks.decode(data)) == entries
    for broken in (data[:-1], data[:20] + bytes([data[20] ^ 1]) + data[21:], b"", data[:10]):
        with pytest.raises(ValueError):
            list(blocks.decode(broken))
    small = blocks.Builder()
    small.add(b"k", b"v")
    assert blocks.HEADER.unpack_from(small.finish())[3] == 0  # stored as it is: zstd isn't smaller
    assert list(blocks.decode(blocks.Builder().finish())) == []
    for n in (0, 127, 128, 300, 2**40):
        assert blocks.get_varint(blocks.put_varint(n), 0) == (n, len(blocks.put_varint(n)))
