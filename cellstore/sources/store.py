"""A store on disk: a log of operations, segments, and a manifest that tells which segments count, read as one.

    <path>/log         Parquet, appended
    <path>/segments/n  Parquet, one folder for each flush
    <path>/manifest    Parquet, a row for each segment: number, statistics, sharder, and the last arrival that it holds

A manifest row is the commit of a flush: a segment without one doesn't count, and log entries up to the last arrival of the newest segment are
in segments already. So a flush that fails half way changes nothing, and one that is run again does no harm.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import cells, segments, sharding
from ..streaming import log

CELLS = log.SCHEMA


class Store:
    def __init__(self, spark: SparkSession, path: str, sharder=None, shards: int = 1):
        """Opens the store; an empty path is an empty store. A store with segments of another sharder or number of shards can't be opened."""
        self.spark, self.path, self.shards = spark, path.rstrip("/"), shards
        self.sharder = sharder or sharding.ModSharder()
        for r in self.manifest().select("sharder", "config_hex", "shards").distinct().collect():
            kept = sharding.sharder(r["sharder"], bytes.fromhex(r["config_hex"]))
            if (kept.name, kept.config.hex(), r["shards"]) != (self.sharder.name, self.sharder.config.hex(), shards):
                raise ValueError(f"the store is sharded by {r['sharder']} in {r['shards']}")

    def _read(self, name: str, schema: str) -> DataFrame:
        try:
            return self.spark.read.parquet(f"{self.path}/{name}")
        except AnalysisException as e:
            if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
                return self.spark.createDataFrame([], schema)
            raise

    def manifest(self) -> DataFrame:
        return self._read("manifest", "number long, entries long, unique_keys long, tombstones long, min_row string, max_row string, min_ts long, max_ts long, shards long, sharder string, config_hex string, created_by string, last_seq long")

    def append(self, ops: DataFrame) -> None:
        log.append(ops, f"{self.path}/log")

    def memtable(self) -> DataFrame:
        """What the log holds beyond the segments, the last write of each key."""
        last = self.manifest().agg(F.coalesce(F.max("last_seq"), F.lit(-(1 << 63)).cast("long"))).first()[0]
        return cells.replay(self._read("log", CELLS).filter(F.col("seq") > last))

    def flush(self) -> int | None:
        """Writes the memtable as a segment and commits it; its number, or None if the memtable is empty."""
        held = self.memtable()
        last = held.agg(F.max("seq")).first()[0]
        if last is None:
            return None
        number = self.manifest().agg(F.coalesce(F.max("number") + 1, F.lit(0).cast("long"))).first()[0]
        at = f"{self.path}/segments/{number}"
        part = self.spark._jvm.org.apache.hadoop.fs.Path(at)
        part.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(part, True)  # what a flush that failed has left
        segments.write(held, at, self.shards, self.sharder.shard_of("row_key", self.shards))
        row = segments.metadata(self.spark.read.parquet(at), self.shards, self.sharder.name, self.sharder.config)
        row.withColumns({"number": F.lit(number).cast("long"), "last_seq": F.lit(last).cast("long")}).write.mode("append").parquet(f"{self.path}/manifest")
        return number

    def close(self) -> int | None:
        return self.flush()

    def segment_rows(self) -> DataFrame:
        """Entries of all segments that count, with number and file of each: rows of a segment know their file."""
        out = None
        for r in self.manifest().select("number").distinct().orderBy("number").collect():
            one = self.spark.read.parquet(f"{self.path}/segments/{r['number']}").select("*", F.col("_metadata.file_path").alias("file"), F.lit(r["number"]).cast("long").alias("number"))
            out = one if out is None else out.unionByName(one)
        return out if out is not None else self.spark.createDataFrame([], f"{CELLS}, shard int, file string, number long")

    def cells(self) -> DataFrame:
        """Log and segments as one: the last write of each key."""
        names = [x.split()[0] for x in CELLS.split(", ")]
        return cells.compact_merge(self.segment_rows().select(*names), self.memtable().select(*names))
