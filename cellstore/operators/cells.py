"""Cells: a multidimensional map (row, family, column, time) to a value or a deletion marker, as a DataFrame.

Cell schema: row_key string, family_id int, column_key string, ts bigint (micros), entry_type PUT | DELETE | MERGE, value (any type; null
for DELETE), seq bigint (arrival). Order: row, family, column by unsigned bytes, then time descending. Nothing here shuffles
a cell by anything but its own key, so one hot row is still spread over its columns and versions are combined before they move.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import written

CELL = ["row_key", "family_id", "column_key"]
KEY = [*CELL, "ts"]
ENTRY_TYPES = ("PUT", "DELETE", "MERGE")


def micros(ts: str) -> Column:
    """Micros since the epoch of a timestamp column without zone, whatever the session's zone."""
    return F.expr(f"timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', {ts})")


def to_cells(df: DataFrame, row: Column, column: Column, ts: Column, value: Column, deleted: Column, seq: Column, family: int = 0) -> DataFrame:
    """Operations from any table."""
    kind = F.when(deleted, "DELETE").otherwise("PUT")
    return df.select(row.alias("row_key"), F.lit(family).alias("family_id"), column.alias("column_key"), ts.alias("ts"), kind.alias("entry_type"), F.when(~deleted, value).alias("value"), seq.alias("seq"))


def put(cells: DataFrame, row: str, column: str, ts: int, value, seq: int, family: int = 0) -> DataFrame:
    """With one more operation; the value must not be null."""
    if value is None:
        raise ValueError("a put needs a value")
    return _with(cells, row, column, ts, "PUT", value, seq, family)


def delete(cells: DataFrame, row: str, column: str, ts: int, seq: int, family: int = 0) -> DataFrame:
    """With a deletion marker for the cell's versions up to ts."""
    return _with(cells, row, column, ts, "DELETE", None, seq, family)


def merge(cells: DataFrame, row: str, column: str, ts: int, value, seq: int, family: int = 0) -> DataFrame:
    return _with(cells, row, column, ts, "MERGE", value, seq, family)


def _with(cells: DataFrame, row, column, ts, kind, value, seq, family) -> DataFrame:
    one = cells.sparkSession.createDataFrame([(row, family, column, ts, kind, value, seq)], cells.select(*KEY[:3], "ts", "entry_type", "value", "seq").schema)
    return cells.unionByName(one)


def last_write_wins(ops: DataFrame) -> DataFrame:
    """One entry for each full key: the last to arrive. Combined on the map side before the shuffle."""
    rest = [c for c in ops.columns if c not in KEY]
    latest = F.max_by(F.struct(*rest), "seq").alias("_e")
    return ops.groupBy(*KEY).agg(latest).select(*KEY, *[F.col(f"_e.{c}").alias(c) for c in rest])


def replay(log: DataFrame) -> DataFrame:
    """The memtable that a log of operations gives: applied by arrival."""
    return last_write_wins(log)


def fold_merges(cells: DataFrame) -> DataFrame:
    """Extension: MERGE operands above the newest base add up on it; a DELETE restarts at nothing. Numeric values."""
    base = Window.partitionBy(*CELL)
    marked = cells.withColumn("_base", F.max(F.when(F.col("entry_type") != "MERGE", F.col("ts"))).over(base))
    live = marked.filter(F.col("_base").isNull() | (F.col("ts") >= F.col("_base")))
    return live.groupBy(*CELL).agg(F.max("ts").alias("ts"), F.sum(F.coalesce("value", F.lit(0.0))).alias("value"), F.sum((F.col("entry_type") == "MERGE").cast("long")).alias("n_merges"))


# reads


def get_as_of(cells: DataFrame, ts: int | None = None) -> DataFrame:
    """Of each cell the newest version up to ts, unless that is a deletion: then the cell is absent."""
    seen = cells if ts is None else cells.filter(F.col("ts") <= ts)
    newest = seen.groupBy(*CELL).agg(F.max(F.struct("ts", "seq", "entry_type", "value")).alias("_e"))
    return newest.filter("_e.entry_type <> 'DELETE'").select(*CELL, "_e.ts", "_e.value")


def get_ceiling(cells: DataFrame, ts: int) -> DataFrame:
    """Of each cell the oldest version at or after ts, deletions passed over (they mask nothing here)."""
    found = last_write_wins(cells.filter((F.col("ts") >= ts))).filter("entry_type <> 'DELETE'")
    return found.groupBy(*CELL).agg(F.min(F.struct("ts", "value")).alias("_e")).select(*CELL, "_e.ts", "_e.value")


def get_point(cells: DataFrame, row: str, column: str, ts: int, family: int = 0) -> DataFrame:
    """One cell as of ts; the key's equality reaches the scan."""
    return get_as_of(cells.filter((F.col("row_key") == row) & (F.col("family_id") == family) & (F.col("column_key") == column)), ts)


def get_versions(cells: DataFrame) -> DataFrame:
    """All versions with their rank in the cell, newest first."""
    return last_write_wins(cells).withColumn("version", F.row_number().over(Window.partitionBy(*CELL).orderBy(F.desc("ts"))).cast("long"))


def multi_get_as_of(cells: DataFrame, asked: DataFrame) -> DataFrame:
    """Extension: asked has cell keys and a time `at` for each; absent cells give no row. Each key may be asked at several times.

    Questions and versions of a cell are put in one order of time, and each question takes the version before it: V versions and Q
    questions of a cell are V + Q rows, never V times Q.
    """
    entry = F.struct("ts", "entry_type", "value")
    versions = cells.select(*CELL, F.col("ts").alias("_at"), F.lit(0).alias("_ask"), F.col("seq").alias("_seq"), entry.alias("_e"))
    questions = asked.select(*CELL, F.col("at").alias("_at")).distinct()
    questions = questions.select(*CELL, "_at", F.lit(1).alias("_ask"), F.lit(0).cast(cells.schema["seq"].dataType).alias("_seq"), F.lit(None).cast(versions.schema["_e"].dataType).alias("_e"))
    order = Window.partitionBy(*CELL).orderBy("_at", "_ask", "_seq").rowsBetween(Window.unboundedPreceding, 0)
    told = versions.unionByName(questions).withColumn("_e", F.last("_e", ignorenulls=True).over(order)).filter("_ask = 1")
    return told.filter("_e.entry_type <> 'DELETE'").select(*CELL, F.col("_at").alias("at"), "_e.ts", "_e.value")


def scan(cells: DataFrame) -> DataFrame:
    """All entries in order. A range sort: bounds are sampled, every partition is sorted on its own."""
    return last_write_wins(cells).orderBy(*CELL, F.desc("ts"))


def scan_positions(cells: DataFrame, partitions: int | None = None) -> DataFrame:
    """The scan with each entry's position from 0, without a global window: positions in partitions plus the sizes of those before."""
    ordered = scan(cells)
    spark = cells.sparkSession
    return _positions(ordered, spark, "pos")


def _positions(ordered: DataFrame, spark, name: str) -> DataFrame:
    """Of a sorted DataFrame. Its rows are written to the shared folder with their place in their partition, and offset by a small table of sizes."""
    marked = ordered.withColumn("_p", F.spark_partition_id()).withColumn("_i", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1))
    marked = written(marked, "positions")
    sizes = marked.groupBy("_p").agg(F.count("*").alias("_n"))
    before = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    return marked.join(F.broadcast(before), "_p").withColumn(name, (F.col("_before") + F.col("_i")).cast("long")).drop("_p", "_i", "_before")


def scan_range(cells: DataFrame, start: str, end: str, column: str = "row_key") -> DataFrame:
    """Entries with start <= key < end; empty if start >= end."""
    return last_write_wins(cells.filter((F.col(column) >= start) & (F.col(column) < end)))


def scan_prefix(cells: DataFrame, prefix: str, column: str = "row_key") -> DataFrame:
    """Entries whose key starts with the prefix; an empty one gives all."""
    return last_write_wins(cells.filter(F.col(column).startswith(prefix)))


# compaction


def mask(cells: DataFrame) -> DataFrame:
    """Entries that no deletion hides, deletions taken out. The newest deletion is found with partial aggregates, so versions of a hot cell aren't gathered."""
    tombs = cells.filter("entry_type = 'DELETE'").groupBy(*CELL).agg(F.max("ts").alias("_dead"))
    live = cells.filter("entry_type <> 'DELETE'").join(tombs, CELL, "left")
    return live.filter(F.col("_dead").isNull() | (F.col("ts") > F.col("_dead"))).drop("_dead")


def compact_minor(memtable: DataFrame, segment: int = 0) -> DataFrame:
    """The memtable as a segment: versions and deletions kept."""
    return last_write_wins(memtable).withColumn("segment", F.lit(segment).cast("long"))


def compact_merge(*segments: DataFrame) -> DataFrame:
    """Several segments as one: deletions kept, since older segments may hold what they hide."""
    first, *rest = segments
    for s in rest:
        first = first.unionByName(s)
    return last_write_wins(first)


def compact_major(cells: DataFrame) -> DataFrame:
    """All segments as one: deletions and what they hide are dropped. A later put older than a dropped deletion would show again."""
    return mask(last_write_wins(cells))


def pivot_wide(cells: DataFrame, columns: list[str], ts: int | None = None) -> DataFrame:
    """Extension: rows with one column for each column key named."""
    return get_as_of(cells, ts).groupBy("row_key").pivot("column_key", columns).agg(F.first("value"))


def unpivot(wide: DataFrame, row: str, columns: list[str], ts: int = 0) -> DataFrame:
    """Extension: the reverse, for numeric columns; nulls are no cells."""
    long = wide.unpivot(row, columns, "column_key", "value").filter("value IS NOT NULL")
    return long.select(F.col(row).alias("row_key"), F.lit(0).alias("family_id"), "column_key", F.lit(ts).cast("long").alias("ts"), F.lit("PUT").alias("entry_type"), "value", F.lit(0).cast("long").alias("seq"))
