"""Queries of the cell store over the test tables, and independent SQL that gives the same rows.

Fixtures as cells: `events` (row = user, column = type, every seventh event a deletion), `orders` (row = customer, column = priority,
status F a deletion; some full keys repeat), `pages` (row = URL).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import codec
from ..operators import blocks, bloom, cells, segments, sharding
from ..sources import legacy
from ..sources.shared import shared_path
from ..sources.store import Store

AS_OF = 1_705_276_800_000_000  # 2024-01-15
ORDERS_AT = 915_148_800_000_000  # 1999-01-01
BOUNDS = ["2", "4", "7"]


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def event_cells(spark: SparkSession, sf: str) -> DataFrame:
    df = table(spark, sf, "events").withColumn("_us", cells.micros("ts"))
    return cells.to_cells(df, F.col("user_id").cast("string"), F.col("event_type"), F.col("_us"), F.col("value"), F.col("event_id") % 7 == 0, F.col("event_id"))


def order_cells(spark: SparkSession, sf: str) -> DataFrame:
    df = table(spark, sf, "orders").withColumn("_us", cells.micros("o_orderdate"))
    return cells.to_cells(df, F.col("o_custkey").cast("string"), F.col("o_orderpriority"), F.col("_us"), F.col("o_totalprice"), F.col("o_orderstatus") == "F", F.col("o_orderkey"))


def page_cells(spark: SparkSession, sf: str) -> DataFrame:
    df = table(spark, sf, "pages")
    return cells.to_cells(df, F.col("url"), F.lit("html"), F.lit(0).cast("long"), F.col("html"), F.lit(False), F.col("page_id"))


def _scan_range_sharded(s: SparkSession, sf: str) -> DataFrame:
    by = sharding.RangeSharder(BOUNDS)
    stored = event_cells(s, sf).withColumn("shard", by.shard_of("row_key", 4))
    return sharding.scan_range_sharded(stored, by, "3", "5").select("row_key", "column_key", "ts", "value", "shard")


def _pages_encoded(s: SparkSession, sf: str) -> DataFrame:
    return table(s, sf, "pages").withColumns({"family": F.lit(3), "us": F.col("page_id") * 1_000_003})


def _bloom(s: SparkSession, sf: str) -> DataFrame:
    return bloom.build(table(s, sf, "pages").withColumn("segment", F.col("page_id") % 4), "url", ["segment"])


def _might_contain(s: SparkSession, sf: str) -> DataFrame:
    pages = table(s, sf, "pages")
    asked = pages.select((F.col("page_id") % 4).alias("segment"), F.col("url").alias("key")).union(pages.select((F.col("page_id") % 4).alias("segment"), F.concat("url", F.lit("?absent")).alias("key")))
    return bloom.might_contain(asked.distinct(), "key", _bloom(s, sf), ["segment"])


def _blocks(s: SparkSession, sf: str) -> DataFrame:
    flushed = segments.assign_segments(cells.last_write_wins(event_cells(s, sf)).filter("entry_type = 'PUT'"))
    return segments.with_blocks(flushed)


def _merged(s: SparkSession, sf: str) -> DataFrame:
    ops = order_cells(s, sf)
    return cells.compact_merge(ops.filter("seq % 3 = 0"), ops.filter("seq % 3 = 1"), ops.filter("seq % 3 = 2"))


def _merge_fold(s: SparkSession, sf: str) -> DataFrame:
    ops = event_cells(s, sf).withColumn("entry_type", F.when((F.col("entry_type") == "PUT") & (F.col("seq") % 3 == 0), "MERGE").otherwise(F.col("entry_type")))
    return cells.fold_merges(ops).select("row_key", "column_key", "ts", F.round("value", 4).alias("value"), "n_merges")


def _multi_get(s: SparkSession, sf: str) -> DataFrame:
    asked = table(s, sf, "events").select(F.col("user_id").cast("string").alias("row_key"), F.lit(0).alias("family_id"), F.col("event_type").alias("column_key"), cells.micros("ts").alias("at")).distinct()
    return cells.multi_get_as_of(event_cells(s, sf), asked).select("row_key", "column_key", "at", "ts", "value")


def _format_roundtrip(s: SparkSession, sf: str) -> DataFrame:
    """Writes a sharded segment with zstd and a native Bloom filter, and reads it again."""
    path = shared_path(s, "segment")
    segments.write(event_cells(s, sf), path, 4, sharding.RangeSharder(BOUNDS).shard_of("row_key", 4))
    return s.read.parquet(path).select("row_key", "column_key", "ts", "value", F.col("shard").cast("long").alias("shard"))


def _flushed(s: SparkSession, sf: str) -> DataFrame:
    """Overwrites and deletions among the operations; four tablets, memtables of 250 keys."""
    ops = order_cells(s, sf).withColumn("tablet", F.col("row_key").cast("long") % 4)
    ops = ops.withColumn("ts", F.col("ts") - F.col("ts") % (90 * 86_400_000_000))  # so that keys repeat
    return segments.fold_flushes(ops, ["tablet"], 250)


def _sized(s: SparkSession, sf: str) -> DataFrame:
    flushed = segments.assign_segments(cells.last_write_wins(event_cells(s, sf)).filter("entry_type = 'PUT'"))
    keyed = flushed.withColumns({"key": F.concat_ws("/", "row_key", "column_key", F.col("ts").cast("string")), "text": F.col("seq").cast("string")})
    return blocks.encode_blocks(keyed, "key", "text", blocks.cell_order(), block_size=1024)


def _block_roundtrip(s: SparkSession, sf: str) -> DataFrame:
    text = lambda c: F.col(c).cast("string")
    return blocks.decode_blocks(_sized(s, sf)).select("segment", text("key").alias("key"), text("value").alias("value"))


def _legacy_roundtrip(s: SparkSession, sf: str) -> DataFrame:
    """Operations as record files, read again."""
    path = shared_path(s, "records").removeprefix("file:")
    legacy.write(event_cells(s, sf), path)
    read = legacy.read(s, path)
    return read.select("row_key", "column_key", "ts", "entry_type", F.col("value").cast("string").cast("double").alias("value"))


def _filled_store(s: SparkSession, sf: str) -> Store:
    """Operations in three appends, with a flush after each but the last."""
    store = Store(s, shared_path(s, "store"), sharding.RangeSharder(BOUNDS), 4)
    ops = order_cells(s, sf).withColumn("value", F.col("value").cast("string"))
    for k in range(3):
        store.append(ops.filter(f"seq * 3 div (SELECT max(o_orderkey) + 1 FROM parquet.`{sf}/orders.parquet`) = {k}"))
        if k < 2:
            store.flush()
    return store


def _store_cells(s: SparkSession, sf: str) -> DataFrame:
    return _filled_store(s, sf).cells().withColumn("value", F.col("value").cast("double"))


def _store_manifest(s: SparkSession, sf: str) -> DataFrame:
    return _filled_store(s, sf).manifest().select("number", "entries", "tombstones", "min_row", "max_row", "min_ts", "max_ts", "last_seq", "sharder", "shards")


def _file_paths(s: SparkSession, sf: str) -> DataFrame:
    """The file of each row is in the folder of the row's shard."""
    path = shared_path(s, "segment")
    segments.write(event_cells(s, sf), path, 4, sharding.RangeSharder(BOUNDS).shard_of("row_key", 4))
    rows = s.read.parquet(path).select("shard", F.regexp_extract(F.col("_metadata.file_path"), "/shard=([0-9]+)/[^/]*[.]parquet$", 1).cast("long").alias("folder"))
    return rows.groupBy("folder").agg(F.count("*").alias("n"), F.min("shard").cast("long").alias("shard"))


def _composite_roundtrip(s: SparkSession, sf: str) -> DataFrame:
    keyed = event_cells(s, sf).select(codec.composite_key("row_key", "family_id", "column_key", "ts").alias("k"))
    parts = codec.split_composite("k")
    return keyed.select(*[c.alias(n) for n, c in parts.items()])


def _pivot(s: SparkSession, sf: str) -> DataFrame:
    return cells.pivot_wide(event_cells(s, sf), ["click", "purchase"], AS_OF)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    e, o, p = event_cells, order_cells, page_cells
    by = sharding.RangeSharder(BOUNDS)
    brief = ["row_key", "column_key", "ts", "value"]
    return {
        "put_lww": lambda s, d: cells.last_write_wins(o(s, d)),
        "delete_tombstone": lambda s, d: cells.last_write_wins(o(s, d)).filter("entry_type = 'DELETE'").groupBy("row_key", "column_key").agg(F.count("*").alias("n"), F.max("ts").alias("newest")),
        "wal_replay": lambda s, d: cells.replay(o(s, d).filter("seq % 2 = 0").unionByName(o(s, d).filter("seq % 2 = 1"))),
        "get_as_of": lambda s, d: cells.get_as_of(e(s, d), AS_OF).select(*brief),
        "get_latest": lambda s, d: cells.get_as_of(o(s, d)).select(*brief),
        "get_ceiling": lambda s, d: cells.get_ceiling(o(s, d), ORDERS_AT).select(*brief),
        "get_point": lambda s, d: cells.get_point(e(s, d), "42", "click", 1_893_456_000_000_000).select(*brief),
        "get_versions": lambda s, d: cells.get_versions(e(s, d)).select(*brief, "entry_type", "version"),
        "get_across_segments": lambda s, d: cells.get_as_of(_merged(s, d), ORDERS_AT).select(*brief),
        "scan_full": lambda s, d: cells.scan_positions(e(s, d)).select("pos", *brief),
        "scan_range": lambda s, d: cells.scan_range(e(s, d), "2", "5").select(*brief, "entry_type"),
        "scan_prefix": lambda s, d: cells.scan_prefix(p(s, d), "http://blog.").select("row_key", "column_key", F.length("value").cast("long").alias("chars")),
        "segment_entries": lambda s, d: segments.entries(e(s, d)),
        "segment_unique_keys": lambda s, d: segments.unique_keys(e(s, d)),
        "segment_metadata": lambda s, d: segments.metadata(e(s, d), 4, by.name, by.config),
        "shard_range": lambda s, d: e(s, d).select("row_key", by.shard_of("row_key", 4).alias("shard")).distinct(),
        "shard_range_sizes": lambda s, d: e(s, d).groupBy(by.shard_of("row_key", 4).alias("shard")).agg(F.count("*").alias("n")),
        "shard_mod": lambda s, d: p(s, d).select("row_key", sharding.ModSharder().shard_of("row_key", 8).alias("shard")),
        "shard_fingerprint": lambda s, d: p(s, d).select("row_key", sharding.FingerprintSharder().shard_of("row_key", 8).alias("shard")),
        "shard_names": lambda s, d: e(s, d).select(by.shard_of("row_key", 4).alias("shard")).distinct().select("shard", sharding.shard_name("cells", F.col("shard"), 4).alias("name")),
        "scan_range_sharded": _scan_range_sharded,
        "flush_segments": lambda s, d: segments.segment_stats(segments.assign_segments(e(s, d).filter("entry_type = 'PUT'"))),
        "block_index": lambda s, d: segments.block_index(_blocks(s, d)),
        "shared_prefix": lambda s, d: _blocks(s, d).select("segment", "block", "place", "key", "ts", "shared"),
        "varint_encode": lambda s, d: table(s, d, "orders").select("o_orderkey", F.hex(codec.varint("o_orderkey * 97")).alias("coded")),
        "varint_decode": lambda s, d: table(s, d, "orders").select("o_orderkey", codec.varint("o_orderkey * 97").alias("coded")).select("o_orderkey", codec.read_varint("coded").alias("value")),
        "inverted_ts": lambda s, d: e(s, d).select("seq", codec.inverted_ts(F.col("ts")).alias("inverted")),
        "composite_key": lambda s, d: _pages_encoded(s, d).withColumn("q", F.lit("html")).select("page_id", F.hex(codec.composite_key("url", "family", "q", "us")).alias("k")),
        "composite_key_roundtrip": _composite_roundtrip,
        "crc32c": lambda s, d: table(s, d, "pages").select("page_id", codec.crc32c(F.col("url")).alias("crc")),
        "poly31_hash": lambda s, d: table(s, d, "pages").select("page_id", codec.poly31("url").alias("h0"), codec.poly31("url", 4).alias("h4")),
        "bloom_build": _bloom,
        "bloom_might_contain": _might_contain,
        "bloom_bytes": lambda s, d: bloom.serialise(_bloom(s, d), ["segment"]).select("segment", F.octet_length("filter").cast("long").alias("size"), F.sha2("filter", 256).alias("sha256")),
        "bloom_reload": lambda s, d: bloom.load(bloom.serialise(_bloom(s, d), ["segment"]), ["segment"]),
        "flush_fold": lambda s, d: _flushed(s, d).select("tablet", "seq", "segment"),
        "block_sizes": lambda s, d: _sized(s, d).select("segment", "block", F.col("first_key").cast("string").alias("first_key"), "entries", "estimate"),
        "block_roundtrip": _block_roundtrip,
        "legacy_roundtrip": _legacy_roundtrip,
        "store_cells": _store_cells,
        "store_manifest": _store_manifest,
        "file_paths": _file_paths,
        "bloom_fpr": lambda s, d: bloom.fill(_bloom(s, d), ["segment"]),
        "compact_minor": lambda s, d: cells.compact_minor(o(s, d), 7),
        "compact_merge": _merged,
        "compact_major": lambda s, d: cells.compact_major(o(s, d)).select(*brief, "seq"),
        "as_of_after_major": lambda s, d: cells.get_as_of(cells.compact_major(o(s, d))).select(*brief),
        "format_roundtrip": _format_roundtrip,
        "pivot_wide": _pivot,
        "unpivot_cells": lambda s, d: cells.unpivot(table(s, d, "part").select(F.col("p_partkey").cast("string").alias("k"), F.col("p_size").cast("double").alias("p_size"), "p_retailprice"), "k", ["p_size", "p_retailprice"]).select("row_key", "column_key", "value"),
        "multi_get_as_of": _multi_get,
        "merge_fold": _merge_fold,
    }


_E = "e AS (SELECT user_id::varchar AS row_key, 0 AS family_id, event_type AS column_key, epoch_us(ts) AS ts, CASE WHEN event_id % 7 = 0 THEN 'DELETE' ELSE 'PUT' END AS entry_type, CASE WHEN event_id % 7 <> 0 THEN value END AS value, event_id AS seq FROM events)"
_O = "o AS (SELECT o_custkey::varchar AS row_key, 0 AS family_id, o_orderpriority AS column_key, epoch_us(o_orderdate) AS ts, CASE WHEN o_orderstatus = 'F' THEN 'DELETE' ELSE 'PUT' END AS entry_type, CASE WHEN o_orderstatus <> 'F' THEN o_totalprice END AS value, o_orderkey AS seq FROM orders)"
_SAME = "b.row_key = a.row_key AND b.column_key = a.column_key"
_LWW = f"w AS (SELECT * FROM o AS a WHERE NOT EXISTS (SELECT 1 FROM o AS b WHERE {_SAME} AND b.ts = a.ts AND b.seq > a.seq))"
_MAJOR = f"m AS (SELECT * FROM w AS a WHERE entry_type <> 'DELETE' AND NOT EXISTS (SELECT 1 FROM w AS b WHERE {_SAME} AND b.entry_type = 'DELETE' AND b.ts >= a.ts))"
_CODES = "list_transform(range(1, octet_length(encode({c})) + 1), lambda i: ('0x' || substr(hex(encode({c})), 2 * i - 1, 2))::bigint)"
_POLY = "list_reduce(list_prepend({seed}::bigint, " + _CODES.replace("{c}", "url") + "), lambda h, b: (h * 31 + b) % 4294967296)"


def _newest(of: str, where: str) -> str:
    return f"SELECT row_key, column_key, ts, value FROM {of} AS a WHERE {where.format(t='a')} AND entry_type <> 'DELETE' AND NOT EXISTS (SELECT 1 FROM {of} AS b WHERE {_SAME} AND {where.format(t='b')} AND (b.ts > a.ts OR (b.ts = a.ts AND b.seq > a.seq)))"


def _varint(n: str) -> str:
    byte = lambda i, more: f"lpad(to_hex((({n}) >> {7 * i} & 127) | {128 if more else 0}), 2, '0')"
    cases = " ".join(f"WHEN {n} < {1 << 7 * w} THEN {' || '.join(byte(i, i < w - 1) for i in range(w))}" for w in range(1, 5))
    return f"upper(CASE {cases} ELSE {' || '.join(byte(i, i < 4) for i in range(5))} END)"


_BITS = f"""h AS (SELECT page_id % 4 AS segment, url, {_POLY.format(seed=0)} AS h1, {_POLY.format(seed=4)} AS h2 FROM pages),
bits AS (SELECT DISTINCT segment, (h1 + i * h2) % 4294967296 % 1048576 AS bit FROM h, range(4) AS r(i))"""
_BLOCKS = """s AS (SELECT *, (row_number() OVER (ORDER BY seq) - 1) // 1001 AS segment FROM e WHERE entry_type = 'PUT'),
k AS (SELECT *, row_key || '/' || column_key AS key, row_number() OVER (PARTITION BY segment ORDER BY row_key, column_key, ts DESC) - 1 AS n FROM s),
l AS (SELECT k.*, n // 64 AS block, n % 64 AS place, lag(key) OVER (PARTITION BY segment ORDER BY n) AS prev FROM k),
f AS (SELECT segment, block, place, key, ts, CASE WHEN place % 16 = 0 OR prev IS NULL THEN 0 ELSE
  list_min(list_filter(range(1, least(length(prev), length(key)) + 2), lambda i: i > least(length(prev), length(key)) OR substr(prev, i, 1) <> substr(key, i, 1))) - 1 END::bigint AS shared FROM l)"""
_NUMBER = 4294967296
_BIG = "18446744073709551616::uhugeint"


def _rotl32(x: str, r: int) -> str:
    return f"((({x}) * {1 << r}) % {_NUMBER} + ({x}) // {1 << 32 - r})"


def _murmur32(codes: str) -> str:
    """SQL of the 32-bit Murmur3 of a list of bytes; c holds the list."""
    word = "c[4 * j + 1] + c[4 * j + 2] * 256 + c[4 * j + 3] * 65536 + c[4 * j + 4] * 16777216"
    mixed = lambda k: f"({_rotl32(f'(({k})::hugeint * 3432918353 % {_NUMBER})', 15)} * 461845907 % {_NUMBER})"
    step = f"(({_rotl32(f'xor(h, {mixed("k")})', 13)}) * 5 + 3864292196) % {_NUMBER}"
    body = f"list_reduce(list_prepend(0::hugeint, list_transform(range(len(c) // 4), lambda j: ({word})::hugeint)), lambda h, k: {step})"
    tail = "list_sum(list_transform(range(len(c) // 4 * 4, len(c)), lambda j: c[j + 1] * (CASE j % 4 WHEN 0 THEN 1 WHEN 1 THEN 256 ELSE 65536 END)))"
    return f"SELECT *, xor(xor({body}, {mixed(f'coalesce({tail}, 0)')}), len(c)::hugeint) AS f0 FROM (SELECT *, {codes} AS c FROM pages)"


def _final32() -> str:
    step = lambda x, r: f"xor({x}, {x} // {1 << r})"
    return f"m0 AS ({_murmur32(_CODES.replace('{c}', 'url'))}), m1 AS (SELECT *, {step('f0', 16)} * 2246822507 % {_NUMBER} AS f1 FROM m0), m2 AS (SELECT *, {step('f1', 13)} * 3266489909 % {_NUMBER} AS f2 FROM m1), m3 AS (SELECT *, {step('f2', 16)} AS hash FROM m2)"


def _murmur128() -> str:
    """SQL of both halves of the 128-bit Murmur3: t4 has h1 and h2 after the last mixing."""
    mul = lambda a, k: f"(({a}) * {k}::uhugeint % {_BIG})"
    rot = lambda x, r: f"((({x}) * {1 << r}::uhugeint) % {_BIG} + ({x}) // {1 << 64 - r}::uhugeint)"
    c1, c2 = 0x87C37B91114253D5, 0x4CF5AD432745937F
    half = lambda at: "(" + " + ".join(f"c[16 * j + {at + i}]::uhugeint * {1 << 8 * i}::uhugeint" for i in range(8)) + ")"
    k1, k2 = lambda k: mul(rot(mul(k, c1), 31), c2), lambda k: mul(rot(mul(k, c2), 33), c1)
    h1 = f"(({rot(f'xor(a.h1, {k1("b.k1")})', 27)} + a.h2) % {_BIG} * 5::uhugeint + {0x52DCE729}::uhugeint) % {_BIG}"
    h2 = f"(({rot(f'xor(a.h2, {k2("b.k2")})', 31)} + ({h1})) % {_BIG} * 5::uhugeint + {0x38495AB5}::uhugeint) % {_BIG}"
    none = "{'h1': 0::uhugeint, 'h2': 0::uhugeint, 'k1': 0::uhugeint, 'k2': 0::uhugeint}"
    each = f"{{'h1': 0::uhugeint, 'h2': 0::uhugeint, 'k1': {half(1)}, 'k2': {half(9)}}}"
    fold = f"list_reduce(list_prepend({none}, list_transform(range(len(c) // 16), lambda j: {each})), lambda a, b: {{'h1': {h1}, 'h2': {h2}, 'k1': 0::uhugeint, 'k2': 0::uhugeint}})"
    tail = lambda lo, hi: f"coalesce(list_sum(list_transform(range({lo}, {hi}), lambda j: c[len(c) // 16 * 16 + {lo} + (j - {lo}) + 1]::hugeint * (1::hugeint << (8 * (j - {lo}))::int))), 0)::uhugeint"
    n = "len(c) % 16"
    t1, t2 = tail("0", f"least({n}, 8)"), tail("8", f"greatest({n}, 8)")
    mixed = lambda x: f"xor({x}, ({x}) // {1 << 33}::uhugeint)"
    f1, f2 = 0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53
    return (
        f"t0 AS (SELECT *, {_CODES.replace('{c}', 'url')} AS c FROM pages), t1 AS (SELECT *, {fold} AS s, {t1} AS x1, {t2} AS x2 FROM t0), "
        f"t2 AS (SELECT *, xor(xor(s.h1, {k1('x1')}), len(c)::uhugeint) AS g1, xor(xor(s.h2, {k2('x2')}), len(c)::uhugeint) AS g2 FROM t1), "
        f"t3 AS (SELECT *, (g1 + g2) % {_BIG} AS u1, (g1 + g2 + g2) % {_BIG} AS u2 FROM t2), "
        f"t4 AS (SELECT *, {mul(mixed('u1'), f1)} AS v1, {mul(mixed('u2'), f1)} AS v2 FROM t3), t5 AS (SELECT *, {mul(mixed('v1'), f2)} AS w1, {mul(mixed('v2'), f2)} AS w2 FROM t4), "
        f"t6 AS (SELECT *, ({mixed('w1')} + {mixed('w2')}) % {_BIG} AS low FROM t5)"
    )


_BYTE_STEP = "list_reduce(list_prepend(xor(r, b), range(8)), lambda x, i: xor(x // 2, CASE WHEN x % 2 = 1 THEN 2197175160 ELSE 0 END))"
_CRC = "xor(list_reduce(list_prepend(4294967295::bigint, " + _CODES.replace("{c}", "url") + "), lambda r, b: " + _BYTE_STEP + "), 4294967295)"
_ASKED = f"""asked AS (SELECT DISTINCT segment, key FROM (SELECT page_id % 4 AS segment, url AS key FROM pages UNION ALL SELECT page_id % 4, url || '?absent' FROM pages)),
g AS (SELECT segment, key, list_reduce(list_prepend(0::bigint, {_CODES.replace("{c}", "key")}), lambda h, b: (h * 31 + b) % 4294967296) AS h1, list_reduce(list_prepend(4::bigint, {_CODES.replace("{c}", "key")}), lambda h, b: (h * 31 + b) % 4294967296) AS h2 FROM asked),
probes AS (SELECT segment, key, (h1 + i * h2) % 4294967296 % 1048576 AS bit FROM g, range(4) AS r(i))"""
_FOLD = """q AS (SELECT o_custkey % 4 AS tablet, o_orderkey AS seq, o_custkey, o_orderpriority, epoch_us(o_orderdate) - epoch_us(o_orderdate) % 7776000000000 AS ts, o_orderstatus <> 'F' AS put, row_number() OVER (PARTITION BY o_custkey % 4 ORDER BY o_orderkey) AS n FROM orders),
p AS MATERIALIZED (SELECT *, coalesce(lag(n) OVER (PARTITION BY tablet, o_custkey, o_orderpriority, ts ORDER BY n), 0) AS last FROM q),
f(tablet, n, seq, segment, held, since) AS (SELECT tablet, 0::bigint, -1::bigint, 0::bigint, 0::bigint, 1::bigint FROM (SELECT DISTINCT tablet FROM p)
 UNION ALL SELECT tablet, n, seq, segment, CASE WHEN full_ THEN 0 ELSE held END, CASE WHEN full_ THEN n + 1 ELSE since END FROM (
  SELECT p.tablet, p.n, p.seq, f.segment + (f.held = 0 AND f.since = p.n AND p.n > 1)::bigint AS segment, f.since, f.held + (p.last < f.since)::bigint AS held, p.put AND f.held + (p.last < f.since)::bigint > 250 AS full_ FROM f JOIN p ON p.tablet = f.tablet AND p.n = f.n + 1))"""
_SIZED = """s AS (SELECT *, (row_number() OVER (ORDER BY seq) - 1) // 1001 AS segment FROM e WHERE entry_type = 'PUT'),
k AS MATERIALIZED (SELECT segment, row_key || '/' || column_key || '/' || ts AS key, seq::varchar AS val, row_number() OVER (PARTITION BY segment ORDER BY row_key, column_key, ts DESC) AS n FROM s),
l AS MATERIALIZED (SELECT a.*, list_min(list_filter(range(1, least(length(b.key), length(a.key)) + 2), lambda i: i > least(length(b.key), length(a.key)) OR substr(b.key, i, 1) <> substr(a.key, i, 1))) - 1 AS common FROM k AS a LEFT JOIN k AS b ON b.segment = a.segment AND b.n = a.n - 1),
f(segment, n, block, place, size, first_key) AS (SELECT segment, 0::bigint, -1::bigint, 0::bigint, 999999::bigint, '' FROM (SELECT DISTINCT segment FROM l)
 UNION ALL SELECT l.segment, l.n, f.block + (f.size >= 1024)::bigint, CASE WHEN f.size >= 1024 THEN 1 ELSE f.place + 1 END,
  CASE WHEN f.size >= 1024 THEN 8 ELSE f.size END + 3 + length(l.val) + length(l.key) + CASE WHEN f.size >= 1024 OR f.place % 16 = 0 THEN 8 ELSE -l.common END,
  CASE WHEN f.size >= 1024 THEN l.key ELSE f.first_key END FROM f JOIN l ON l.segment = f.segment AND l.n = f.n + 1)"""
_SHARD = "len(list_filter(['2', '4', '7'], lambda b: b <= row_key))::bigint"


def oracle_sql() -> dict[str, str]:
    cfg = sharding.RangeSharder(BOUNDS).config.hex()
    key = f"{_varint('octet_length(encode(url))')} || hex(encode(url)) || {_varint('3')} || {_varint('4')} || hex(encode('html')) || lpad(upper(to_hex(xor(page_id * 1000003, -1)::ubigint)), 16, '0')"
    key = key.replace("xor(page_id * 1000003, -1)::ubigint", "18446744073709551615::hugeint - page_id * 1000003")
    return {
        "put_lww": f"WITH {_O}, {_LWW} SELECT * FROM w",
        "delete_tombstone": f"WITH {_O}, {_LWW} SELECT row_key, column_key, count(*) AS n, max(ts) AS newest FROM w WHERE entry_type = 'DELETE' GROUP BY ALL",
        "wal_replay": f"WITH {_O}, {_LWW} SELECT * FROM w",
        "get_as_of": f"WITH {_E} {_newest('e', '{t}.ts <= ' + str(AS_OF))}",
        "get_latest": f"WITH {_O} {_newest('o', 'true')}",
        "get_ceiling": f"WITH {_O}, {_LWW} SELECT row_key, column_key, ts, value FROM w AS a WHERE ts >= {ORDERS_AT} AND entry_type <> 'DELETE' AND NOT EXISTS (SELECT 1 FROM w AS b WHERE {_SAME} AND b.entry_type <> 'DELETE' AND b.ts >= {ORDERS_AT} AND b.ts < a.ts)",
        "get_point": f"WITH {_E} {_newest('e', '{t}.row_key = ' + chr(39) + '42' + chr(39) + ' AND {t}.column_key = ' + chr(39) + 'click' + chr(39))}",
        "get_versions": f"WITH {_E} SELECT row_key, column_key, ts, value, entry_type, (SELECT count(*) FROM e AS b WHERE {_SAME} AND b.ts >= a.ts) AS version FROM e AS a",
        "get_across_segments": f"WITH {_O} {_newest('o', '{t}.ts <= ' + str(ORDERS_AT))}",
        "scan_full": f"WITH {_E} SELECT row_number() OVER (ORDER BY row_key, column_key, ts DESC) - 1 AS pos, row_key, column_key, ts, value FROM e",
        "scan_range": f"WITH {_E} SELECT row_key, column_key, ts, value, entry_type FROM e WHERE row_key >= '2' AND row_key < '5'",
        "scan_prefix": "SELECT url AS row_key, 'html' AS column_key, length(arg_max(html, page_id)) AS chars FROM pages WHERE starts_with(url, 'http://blog.') GROUP BY url",
        "segment_entries": "SELECT count(*) AS entries FROM events",
        "segment_unique_keys": "SELECT count(*) AS unique_keys FROM (SELECT DISTINCT user_id, event_type FROM events)",
        "segment_metadata": f"WITH {_E} SELECT count(*) AS entries, count(DISTINCT (row_key, column_key)) AS unique_keys, count(*) FILTER (entry_type = 'DELETE') AS tombstones, min(row_key) AS min_row, max(row_key) AS max_row, min(ts) AS min_ts, max(ts) AS max_ts, 4::bigint AS shards, 'range:v1' AS sharder, '{cfg}' AS config_hex, '{segments.CREATED_BY}' AS created_by FROM e",
        "shard_range": f"WITH {_E} SELECT DISTINCT row_key, {_SHARD} AS shard FROM e",
        "shard_range_sizes": f"WITH {_E} SELECT {_SHARD} AS shard, count(*) AS n FROM e GROUP BY 1",
        "shard_names": f"WITH {_E} SELECT DISTINCT {_SHARD} AS shard, format('cells-{{:05d}}-of-00004.sst', {_SHARD}) AS name FROM e",
        "scan_range_sharded": f"WITH {_E} SELECT row_key, column_key, ts, value, {_SHARD} AS shard FROM e WHERE row_key >= '3' AND row_key < '5'",
        "flush_segments": f"WITH {_E}, s AS (SELECT *, (row_number() OVER (ORDER BY seq) - 1) // 1001 AS segment FROM e WHERE entry_type = 'PUT') SELECT segment, count(*) AS entries, count(DISTINCT (row_key, column_key)) AS unique_keys, 0::bigint AS tombstones, min(row_key) AS min_row, max(row_key) AS max_row, min(ts) AS min_ts, max(ts) AS max_ts FROM s GROUP BY segment",
        "block_index": f"WITH {_E}, {_BLOCKS} SELECT segment, block, min(key) AS first_key, count(*) AS entries, sum(length(key) - shared)::bigint AS key_chars FROM f GROUP BY segment, block",
        "shared_prefix": f"WITH {_E}, {_BLOCKS} SELECT * FROM f",
        "varint_encode": f"SELECT o_orderkey, {_varint('(o_orderkey * 97)')} AS coded FROM orders",
        "varint_decode": "SELECT o_orderkey, o_orderkey * 97 AS value FROM orders",
        "inverted_ts": "SELECT event_id AS seq, lpad(upper(to_hex(18446744073709551615::hugeint - epoch_us(ts))), 16, '0') AS inverted FROM events",
        "composite_key": f"SELECT page_id, {key} AS k FROM pages",
        "composite_key_roundtrip": f"WITH {_E} SELECT row_key, family_id, column_key, ts FROM e",
        "poly31_hash": f"SELECT page_id, {_POLY.format(seed=0)} AS h0, {_POLY.format(seed=4)} AS h4 FROM pages",
        "bloom_build": f"WITH {_BITS} SELECT * FROM bits",
        "bloom_bytes": lambda s, d: bloom.serialise(_bloom(s, d), ["segment"]).select("segment", F.octet_length("filter").cast("long").alias("size"), F.sha2("filter", 256).alias("sha256")),
        "bloom_reload": lambda s, d: bloom.load(bloom.serialise(_bloom(s, d), ["segment"]), ["segment"]),
        "flush_fold": lambda s, d: _flushed(s, d).select("tablet", "seq", "segment"),
        "block_sizes": lambda s, d: _sized(s, d).select("segment", "block", F.col("first_key").cast("string").alias("first_key"), "entries", "estimate"),
        "block_roundtrip": _block_roundtrip,
        "legacy_roundtrip": _legacy_roundtrip,
        "store_cells": _store_cells,
        "store_manifest": _store_manifest,
        "file_paths": _file_paths,
        "shard_mod": f"WITH {_final32()} SELECT url AS row_key, ((hash % 2147483648) % 8)::bigint AS shard FROM m3",
        "shard_fingerprint": f"WITH {_murmur128()} SELECT url AS row_key, ((low % 9223372036854775808::uhugeint) % 8)::bigint AS shard FROM t6",
        "crc32c": f"SELECT page_id, {_CRC} AS crc FROM pages",
        "bloom_might_contain": f"WITH {_BITS}, {_ASKED} SELECT segment, key, bool_and(EXISTS (SELECT 1 FROM bits WHERE bits.segment = probes.segment AND bits.bit = probes.bit)) AS maybe FROM probes GROUP BY segment, key",
        "bloom_bytes": f"WITH {_BITS}, b AS (SELECT segment, bit // 8 AS n, sum(1 << (bit % 8)) AS x FROM bits GROUP BY 1, 2), g AS (SELECT segment, r.n FROM (SELECT DISTINCT segment FROM bits), range(131072) AS r(n)), hexed AS (SELECT g.segment, string_agg(lpad(to_hex(coalesce(b.x, 0)::bigint), 2, '0'), '' ORDER BY g.n) AS body FROM g LEFT JOIN b ON b.segment = g.segment AND b.n = g.n GROUP BY g.segment) SELECT segment, 131085::bigint AS size, sha256(unhex('0000BF1DBEAD0B11' || '04' || '00100000' || body)) AS sha256 FROM hexed",
        "bloom_reload": f"WITH {_BITS} SELECT * FROM bits",
        "flush_fold": f"WITH RECURSIVE {_FOLD} SELECT tablet, seq, segment FROM f WHERE n > 0",
        "block_sizes": f"WITH RECURSIVE {_E}, {_SIZED} SELECT segment, block, min(first_key) AS first_key, count(*) AS entries, max(size) AS estimate FROM f WHERE n > 0 GROUP BY segment, block",
        "block_roundtrip": f"WITH {_E}, s AS (SELECT *, (row_number() OVER (ORDER BY seq) - 1) // 1001 AS segment FROM e WHERE entry_type = 'PUT') SELECT segment, row_key || '/' || column_key || '/' || ts AS key, seq::varchar AS value FROM s",
        "legacy_roundtrip": f"WITH {_E} SELECT row_key, column_key, ts, entry_type, value FROM e",
        "store_cells": f"WITH {_O}, {_LWW} SELECT * FROM w",
        "store_manifest": f"WITH {_O}, c AS (SELECT *, seq * 3 // (SELECT max(seq) + 1 FROM o) AS number FROM o), d AS (SELECT * FROM c AS a WHERE number < 2 AND NOT EXISTS (SELECT 1 FROM c AS b WHERE {_SAME} AND b.number = a.number AND b.ts = a.ts AND b.seq > a.seq)) SELECT number, count(*) AS entries, count(*) FILTER (entry_type = 'DELETE') AS tombstones, min(row_key) AS min_row, max(row_key) AS max_row, min(ts) AS min_ts, max(ts) AS max_ts, max(seq) AS last_seq, 'range:v1' AS sharder, 4::bigint AS shards FROM d GROUP BY number",
        "file_paths": f"WITH {_E} SELECT {_SHARD} AS folder, count(*) AS n, {_SHARD} AS shard FROM e GROUP BY ALL",
        "bloom_fpr": f"WITH {_BITS} SELECT segment, count(*) AS bits_set, round(pow(count(*) / 1048576.0::double, 4.0::double), 12) AS rate FROM bits GROUP BY segment",
        "compact_minor": f"WITH {_O}, {_LWW} SELECT *, 7::bigint AS segment FROM w",
        "compact_merge": f"WITH {_O}, {_LWW} SELECT * FROM w",
        "compact_major": f"WITH {_O}, {_LWW}, {_MAJOR} SELECT row_key, column_key, ts, value, seq FROM m",
        "as_of_after_major": f"WITH {_O} {_newest('o', 'true')}",
        "format_roundtrip": f"WITH {_E} SELECT row_key, column_key, ts, value, {_SHARD} AS shard FROM e",
        "pivot_wide": f"WITH {_E}, n AS ({_newest('e', '{t}.ts <= ' + str(AS_OF))}) SELECT row_key, max(value) FILTER (column_key = 'click') AS click, max(value) FILTER (column_key = 'purchase') AS purchase FROM n GROUP BY row_key",
        "unpivot_cells": "SELECT p_partkey::varchar AS row_key, 'p_size' AS column_key, p_size::double AS value FROM part UNION ALL SELECT p_partkey::varchar, 'p_retailprice', p_retailprice FROM part",
        "multi_get_as_of": f"WITH {_E}, q AS (SELECT DISTINCT row_key, column_key, ts AS t FROM e) SELECT q.row_key, q.column_key, q.t AS \"at\", a.ts, a.value FROM q JOIN e AS a ON a.row_key = q.row_key AND a.column_key = q.column_key AND a.ts <= q.t WHERE a.entry_type <> 'DELETE' AND NOT EXISTS (SELECT 1 FROM e AS b WHERE {_SAME} AND b.ts <= q.t AND b.ts > a.ts)",
        "merge_fold": f"WITH {_E}, x AS (SELECT *, CASE WHEN entry_type = 'PUT' AND seq % 3 = 0 THEN 'MERGE' ELSE entry_type END AS kind FROM e), y AS (SELECT a.*, (SELECT max(ts) FROM x AS b WHERE {_SAME} AND b.kind <> 'MERGE') AS base FROM x AS a) SELECT row_key, column_key, max(ts) AS ts, round(sum(coalesce(value, 0)), 4) AS value, count(*) FILTER (kind = 'MERGE') AS n_merges FROM y WHERE base IS NULL OR ts >= base GROUP BY row_key, column_key",
    }
