"""Segments: flushes of a memtable, blocks and their index, metadata, Parquet in and out."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .cells import CELL, KEY

FLUSH_KEYS = 1000
CREATED_BY = "created-by:cellstore"


def assign_segments(ops: DataFrame, flush_keys: int = FLUSH_KEYS, memtable: list[str] | None = None) -> DataFrame:
    """The flush in which each put of a stream of distinct keys leaves the memtable: one happens at flush_keys + 1 keys.

    Exact for puts with distinct keys. memtable names the columns that tell memtables (tablets) apart: each has its own stream, so a
    cluster numbers them side by side. Without it there is one stream, numbered by sorted partitions and their sizes.
    """
    per = flush_keys + 1
    if memtable:
        n = F.row_number().over(Window.partitionBy(*memtable).orderBy("seq")) - 1
        return ops.withColumn("segment", F.floor(n / per).cast("long"))
    from .cells import _positions

    return _positions(ops.orderBy("seq"), ops.sparkSession, "_n").withColumn("segment", F.floor(F.col("_n") / per).cast("long")).drop("_n")


def fold_flushes(ops: DataFrame, memtable: list[str], flush_keys: int = FLUSH_KEYS) -> DataFrame:
    """The flush in which each operation leaves its memtable, with overwrites and deletions: exact for any operations.

    A memtable counts distinct full keys; after a put (not a deletion) that makes them more than flush_keys, it is flushed. memtable names the
    columns that tell memtables (tablets) apart; each is folded in order of arrival, and a cluster folds them side by side. An operation
    whose key was last written in an earlier flush counts again. What is left at the end leaves with the last, partial flush.
    """
    order = Window.partitionBy(*memtable).orderBy("seq")
    placed = ops.withColumn("_n", F.row_number().over(order).cast("long"))
    placed = placed.withColumn("_last", F.coalesce(F.lag("_n").over(Window.partitionBy(*memtable, *KEY).orderBy("_n")), F.lit(0).cast("long")))
    narrow = placed.select(*memtable, "_n", "_last", (F.col("entry_type") != "DELETE").alias("_put"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in narrow.select(*memtable).schema)

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("_n")
        last, put = table.column("_last").to_numpy(), table.column("_put").to_numpy(zero_copy_only=False)
        out, flush, held, since = np.zeros(len(last), np.int64), 0, 0, 1
        for i, (before, is_put) in enumerate(zip(last.tolist(), put.tolist(), strict=True)):
            held += before < since
            out[i] = flush
            if is_put and held > flush_keys:
                flush, held, since = flush + 1, 0, i + 2
        return table.select([*memtable, "_n"]).append_column("segment", pa.array(out))

    flushed = narrow.groupBy(*memtable).applyInArrow(run, f"{kinds}, _n long, segment long")
    return placed.drop("_last").join(flushed, [*memtable, "_n"]).drop("_n")


def segment_stats(segments: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Of each segment: entries (deletions count), keys, deletions, extremes of keys and times."""
    cell = F.struct(*CELL)
    made = segments.groupBy(*(by or ["segment"]), *CELL).agg(F.count("*").alias("n"), F.sum((F.col("entry_type") == "DELETE").cast("long")).alias("d"), F.min("ts").alias("lo"), F.max("ts").alias("hi"))
    return made.groupBy(*(by or ["segment"])).agg(
        F.sum("n").alias("entries"), F.count("*").alias("unique_keys"), F.sum("d").alias("tombstones"),
        F.min(cell)["row_key"].alias("min_row"), F.max(cell)["row_key"].alias("max_row"), F.min("lo").alias("min_ts"), F.max("hi").alias("max_ts"),
    )


def entries(cells: DataFrame) -> DataFrame:
    return cells.agg(F.count("*").alias("entries"))


def unique_keys(cells: DataFrame) -> DataFrame:
    """Distinct (row, family, column)."""
    return cells.select(*CELL).distinct().agg(F.count("*").alias("unique_keys"))


def with_blocks(segments: DataFrame, per_block: int = 64, restart: int = 16) -> DataFrame:
    """Entries in order with block, place in the block, and the prefix shared with the key before (none at a restart).

    A block has a fixed number of entries here (`blocks.cut_blocks` cuts by size); keys are row + column. Windows run within a segment.
    """
    key = F.concat_ws("/", "row_key", "column_key")
    within = Window.partitionBy("segment").orderBy(*CELL, F.desc("ts"))
    df = segments.withColumn("key", key).withColumn("_n", (F.row_number().over(within) - 1).cast("long"))
    df = df.withColumns({"block": F.floor(F.col("_n") / per_block).cast("long"), "place": (F.col("_n") % per_block).cast("long"), "_prev": F.lag("key").over(within)})
    df = df.withColumn("shared", F.when((F.col("place") % restart == 0) | F.col("_prev").isNull(), F.lit(0).cast("long")).otherwise(shared_prefix("_prev", "key")))
    return df.drop("_prev", "_n")


def shared_prefix(a: str, b: str):
    """Length of the common prefix of two string columns."""
    return F.expr(f"cast(coalesce(array_min(filter(sequence(1, least(length({a}), length({b})) + 1), i -> i > least(length({a}), length({b})) OR substring({a}, i, 1) <> substring({b}, i, 1))), 1) - 1 AS bigint)")


def block_index(blocks: DataFrame) -> DataFrame:
    """Of each block its first key, entries and stored key bytes."""
    return blocks.groupBy("segment", "block").agg(F.min("key").alias("first_key"), F.count("*").alias("entries"), F.sum(F.length("key") - F.col("shared")).cast("long").alias("key_chars"))


def write(cells: DataFrame, path: str, shards: int | None = None, shard=None, bloom: str | None = "row_key", ndv: int = 100_000) -> None:
    """A segment: Parquet, zstd, sorted within files, dealt by shard, with a native Bloom filter on a key column."""
    df = cells
    if shard is not None:
        df = df.withColumn("shard", shard).repartition(shards or 1, "shard")
    writer = df.sortWithinPartitions(*([] if shard is None else ["shard"]), *CELL, F.desc("ts")).write.option("compression", "zstd")
    if bloom:
        writer = writer.option(f"parquet.bloom.filter.enabled#{bloom}", "true").option(f"parquet.bloom.filter.expected.ndv#{bloom}", str(ndv))
    (writer.partitionBy("shard") if shard is not None else writer).mode("errorifexists").parquet(path)


def metadata(cells: DataFrame, shards: int, sharder: str, config: bytes = b"") -> DataFrame:
    """The manifest row of a segment."""
    stats = segment_stats(cells.withColumn("segment", F.lit(0)), ["segment"]).drop("segment")
    return stats.withColumns({"shards": F.lit(shards).cast("long"), "sharder": F.lit(sharder), "config_hex": F.lit(config.hex()), "created_by": F.lit(CREATED_BY)})


__all__ = ["KEY", "assign_segments", "block_index", "entries", "fold_flushes", "metadata", "segment_stats", "shared_prefix", "unique_keys", "with_blocks", "write"]
