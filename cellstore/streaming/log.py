"""The operation log as a stream (extension): append, tail, and the newest version of each cell kept up to date."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from ..operators.cells import CELL

SCHEMA = "row_key string, family_id int, column_key string, ts long, entry_type string, value string, seq long"


def append(ops: DataFrame, path: str) -> None:
    """Adds operations to a log; they are checked before anything is written."""
    bad = ops.filter("row_key IS NULL OR column_key IS NULL OR ts IS NULL OR seq IS NULL OR entry_type NOT IN ('PUT', 'DELETE', 'MERGE') OR (entry_type <> 'DELETE' AND value IS NULL)")
    if not bad.isEmpty():
        raise ValueError("operations without key, time, arrival, type or value can't be logged")
    ops.write.mode("append").parquet(path)


def tail(spark: SparkSession, path: str, files_per_trigger: int = 100) -> DataFrame:
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def newest(log: DataFrame) -> DataFrame:
    """Of each cell the newest entry (time, then arrival); state is one entry a cell. Deletions stay, marked."""
    best = F.max(F.struct("ts", "seq", "entry_type", "value")).alias("_e")
    return log.groupBy(*CELL).agg(best).select(*CELL, "_e.*")


def keep_table(log: DataFrame, name: str, checkpoint: str) -> StreamingQuery:
    """A continuously updated in-memory view, for tests and small stores."""
    return newest(log).writeStream.outputMode("complete").format("memory").queryName(name).option("checkpointLocation", checkpoint).start()
