"""Hand-derived micro-fixtures: reads, scans, compaction, sharding, integers, hashes."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from cellstore.functions import codec
from cellstore.operators import cells, segments
from cellstore.operators.sharding import FingerprintSharder, ModSharder, RangeSharder, sharder

OPS = [("a", "c1", 10, "v10"), ("a", "c1", 20, "v20"), ("a", "c1", 30, None), ("a", "c1", 40, "v40"), ("a", "c2", 20, "x"), ("a", "c2", 20, "y"), ("b", "c1", 15, "z"), ("aa", "c1", 15, "w")]


@pytest.fixture(scope="module")
def ops(spark):
    rows = [(r, 0, c, t, "DELETE" if v is None else "PUT", v, i + 1) for i, (r, c, t, v) in enumerate(OPS)]
    return spark.createDataFrame(rows, "row_key string, family_id int, column_key string, ts long, entry_type string, value string, seq long")


@pytest.mark.parametrize("row, column, ts, want", [("a", "c1", 25, "v20"), ("a", "c1", 35, None), ("a", "c1", 45, "v40"), ("a", "c1", 20, "v20"), ("a", "c1", 5, None), ("a", "c2", 20, "y")])
def test_get(ops, row, column, ts, want):
    got = cells.get_point(cells.last_write_wins(ops), row, column, ts).collect()
    assert [r.value for r in got] == ([want] if want else [])


def test_ceiling_passes_over_deletions(ops):
    at = lambda ts: {(r.row_key, r.column_key): r.value for r in cells.get_ceiling(ops, ts).collect()}
    assert at(25) == {("a", "c1"): "v40"} and at(5)["a", "c1"] == "v10" and at(45) == {}


def test_put_delete_merge(ops):
    more = cells.delete(cells.put(ops, "n", "c1", 1, "new", 9), "n", "c1", 2, 10)
    assert more.count() == 10 and cells.get_point(more, "n", "c1", 1).first().value == "new" and cells.get_point(more, "n", "c1", 2).count() == 0
    assert cells.merge(ops, "n", "c1", 1, "m", 9).filter("entry_type = 'MERGE'").count() == 1
    with pytest.raises(ValueError):
        cells.put(ops, "n", "c1", 1, None, 9)


def test_counts_scans_and_compaction(ops):
    lww = cells.last_write_wins(ops)
    assert segments.entries(lww).first()[0] == 7 and segments.unique_keys(lww).first()[0] == 4
    key = lambda rows: [(r.row_key, r.column_key, r.ts) for r in rows]
    order = [("a", "c1", 40), ("a", "c1", 30), ("a", "c1", 20), ("a", "c1", 10), ("a", "c2", 20), ("aa", "c1", 15), ("b", "c1", 15)]
    assert key(cells.scan(ops).collect()) == order
    assert [r.pos for r in cells.scan_positions(ops).orderBy("pos").collect()] == list(range(7))
    assert sorted(key(cells.scan_range(ops, "a", "b").collect())) == sorted(order[:6]) == sorted(key(cells.scan_prefix(ops, "a").collect()))
    assert cells.scan_range(ops, "b", "a").count() == 0
    assert {(r.row_key, r.column_key, r.ts, r.value) for r in cells.compact_major(ops).collect()} == {("a", "c1", 40, "v40"), ("a", "c2", 20, "y"), ("aa", "c1", 15, "w"), ("b", "c1", 15, "z")}


def test_one_key_asked_at_many_times(spark, ops):
    asked = spark.createDataFrame([("a", 0, "c1", t) for t in (5, 10, 25, 30, 35, 40, 99)] + [("a", 0, "c2", 20), ("q", 0, "c1", 9)], "row_key string, family_id int, column_key string, at long")
    got = {(r.row_key, r.column_key, r["at"]): r.value for r in cells.multi_get_as_of(ops, asked.union(asked)).collect()}
    assert got == {("a", "c1", 10): "v10", ("a", "c1", 25): "v20", ("a", "c1", 40): "v40", ("a", "c1", 99): "v40", ("a", "c2", 20): "y"}


def test_flush_fold(ops):
    """Memtables of two keys: an overwrite doesn't count, a deletion counts but doesn't flush."""
    got = segments.fold_flushes(ops.withColumn("t", F.lit(0)), ["t"], 2).orderBy("seq").collect()
    # a deletion makes the third key; the next put, the fourth, flushes; of the overwrite at 6 only one counts
    assert [r.segment for r in got] == [0, 0, 0, 0, 1, 1, 1, 1]
    assert [r.segment for r in segments.fold_flushes(ops.withColumn("t", F.lit(0)), ["t"], 1).orderBy("seq").collect()] == [0, 0, 1, 1, 2, 2, 2, 3]


def test_range_shards(spark):
    by = RangeSharder(["m", "s"])
    rows = spark.createDataFrame([(k,) for k in "amrsz"], "k string").select("k", by.shard_of("k", 3).alias("s")).collect()
    assert {r.k: r.s for r in rows} == {"a": 0, "m": 1, "r": 1, "s": 2, "z": 2}
    with pytest.raises(ValueError):
        by.shard_of("k", 4)
    for bad in (None, b"", b"\0\0", b"\0\0\0\0", b"\0\0\0\2\0\0\0\1m"):
        with pytest.raises(ValueError):
            RangeSharder.from_config(bad)
    assert sharder("mod").name == "mod" and sharder("range:v1", by.config).boundaries == ["m", "s"]
    with pytest.raises(ValueError):
        sharder("other")
    for kind in (ModSharder(), FingerprintSharder()):
        with pytest.raises(ValueError):
            kind.shard_of("k", 0)


def test_varints(spark):
    want = {0: "00", 127: "7F", 128: "8001", 300: "AC02", 2**35 - 1: "FFFFFFFF7F", 2**35: "808080808001", 2**36: "808080808002", 2**63 - 1: "FFFFFFFFFFFFFFFF7F"}
    df = spark.createDataFrame([(n,) for n in want], "n long")
    rows = df.select("n", codec.varint("n").alias("c")).select("n", F.hex("c").alias("h"), codec.read_varint("c").alias("back")).collect()
    assert {r.n: r.h for r in rows} == want and all(r.n == r.back for r in rows)
    with pytest.raises(Exception, match="negative"):
        spark.createDataFrame([(-1,)], "n long").select(codec.varint("n")).collect()


def test_composite_keys(spark):
    rows = [("r" * n, f, "q" * m, t) for n, f, m, t in ((0, 0, 0, 0), (1, 127, 1, 5), (127, 128, 127, 10**15), (128, 300, 128, 1), (200, 2**31 - 1, 20_000, 2**62), (17_000, 1, 0, 3))]
    df = spark.createDataFrame(rows, "row string, family int, q string, ts long").select(codec.composite_key("row", "family", "q", "ts").alias("k"))
    got = df.select(*[c.alias(n) for n, c in codec.split_composite("k").items()]).collect()
    assert sorted(map(tuple, got)) == sorted(rows)
    for cut in ("substring(k, 1, octet_length(k) - 1)", "concat(k, X'00')", "substring(k, 1, 3)"):
        with pytest.raises(Exception, match="composite"):
            bad = df.select(F.expr(cut).alias("k"))
            bad.select(*[c.alias(n) for n, c in codec.split_composite("k").items()]).collect()


def test_hashes_and_bloom(spark):
    from cellstore.operators import bloom

    r = spark.createDataFrame([("a", "ab")], "a string, ab string").select(codec.poly31("a").alias("a0"), codec.poly31("ab").alias("b0"), codec.poly31("a", 4).alias("a4")).first()
    assert tuple(r) == (97, 3105, 221)
    keys = spark.createDataFrame([(0, f"key {i}") for i in range(50)] + [(1, "ä"), (1, "")], "g int, k string")

    def plain(key, bits, probes):
        h = [0, 4]
        for b in key.encode():
            h = [(x * 31 + b) % 2**32 for x in h]
        signed = lambda x: x - 2**32 if x >= 2**31 else x
        return {signed((h[0] + i * h[1]) % 2**32) % bits for i in range(probes)}

    for bits, probes in ((1 << 20, 4), (1000, 7), (64, 1)):
        built = bloom.build(keys, "k", ["g"], bits, probes)
        want = {(r.g, b) for r in keys.collect() for b in plain(r.k, bits, probes)}
        assert {(r.g, r.bit) for r in built.collect()} == want
        stored = bloom.serialise(built, ["g"], bits, probes)
        assert {(r.g, r.bit) for r in bloom.load(stored, ["g"]).collect()} == want
        head = stored.first()["filter"][:13]
        assert head == (0xBF1DBEAD0B11).to_bytes(8, "big") + bytes([probes]) + bits.to_bytes(4, "big")
        assert all(r.maybe for r in bloom.might_contain(keys, "k", built, ["g"], bits, probes).collect())
    with pytest.raises(Exception, match="Bloom"):
        bloom.load(spark.createDataFrame([(0, b"\0" * 20)], "g int, filter binary"), ["g"]).collect()


def test_vectors_of_hashes_over_bytes():
    import numpy as np

    low = lambda x: int(codec.murmur3_128_low(np.frombuffer(x, np.uint8).reshape(1, -1))[0])
    assert low(b"") == 0 and low(b"hello") == 0xCBD8A7B341BD9B02 and low(b"The quick brown fox jumps over the lazy dog") == 0xE34BBC7BBC071B6C
    assert codec.crc32c_bytes(b"") == 0 and codec.crc32c_bytes(b"123456789") == 0xE3069283 and codec.crc32c_bytes(bytes(32)) == 0x8A9136AA
