"""What several operators share: shared tables, skew-safe joins, Arrow text."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space as the text contracts define it.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"
SPACES = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

#: A relation of at most this many narrow rows (under 100 bytes each) is broadcast.
BROADCAST_ROWS = 200_000


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share. Where none is set, local mode gets a temporary one; a cluster has no such folder, so that is an error."""
    at = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not at:
        if not re.match(r"local(\[[^,]*(,\s*\d+)?\])?$", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        at = tempfile.mkdtemp(prefix="shared-")
        spark.sparkContext.setCheckpointDir(at)
        at = spark.sparkContext.getCheckpointDir() or at
    return at.rstrip("/")


class Tables:
    """Tables in the shared folder that cut lineage; `drop` removes those that are no longer read."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"

    def write(self, df: DataFrame, name: str) -> DataFrame:
        """Once the table is written, the shuffles behind it are removed. While it is written, that goes for the session's other queries too: if
        such a query runs again, Spark makes its shuffles anew."""
        path = f"{self.root}/{name}"
        before = self.spark.conf.get(SHUFFLE_CLEANUP)
        self.spark.conf.set(SHUFFLE_CLEANUP, "true")
        try:
            df.write.option("compression", "zstd").parquet(path)
        finally:
            self.spark.conf.set(SHUFFLE_CLEANUP, before)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        for name in names:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def lower_ascii(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def n_words(c: Column) -> Column:
    """Number of words; null counts as empty. A word and the space behind it become one letter, as `regexp_count` makes an array of all words."""
    letters = F.regexp_replace(c, WORD + r"[\x20\x09-\x0D]*", "w")
    return F.coalesce(F.length(F.ltrim(letters, F.lit(SPACES))), F.lit(0)).cast("long")


def with_column_free(df: DataFrame, *names: str) -> None:
    if missing := [n for n in names if n not in df.columns]:
        raise ValueError(f"missing columns {missing}; there are {df.columns}")


def keep_heavy(right: DataFrame, keys: list[str], weight: str, total: int) -> tuple[DataFrame, DataFrame]:
    """Splits a relation with unique keys into keys that stand for over a thousandth of `total` rows and the rest.

    The weights add up to `total` at most, so the first part has fewer than 1000 rows: its broadcast is bounded.
    """
    heavy = F.col(weight) * 1000 > F.lit(total)
    return right.filter(heavy), right.filter(~heavy | heavy.isNull())


def skew_left_join(left: DataFrame, right: DataFrame, keys: list[str], weight: str, total: int) -> DataFrame:
    """left ⟕ right on unique keys of right; a key with many left rows is joined by broadcast, so that it isn't shuffled."""
    heavy, rest = keep_heavy(right, keys, weight, total)
    added = [c for c in right.columns if c not in keys]
    marked = left.join(F.broadcast(heavy.withColumn("_heavy", F.lit(True))), keys, "left")
    done = marked.filter(F.col("_heavy")).drop("_heavy")
    light = marked.filter(F.col("_heavy").isNull()).drop("_heavy", *added).join(rest, keys, "left")
    return done.unionByName(light.select(*done.columns))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the offsets of its rows; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, at, data = column.buffers()
    offsets = np.frombuffer(at, np.int64, len(column) + 1, column.offset * 8)
    if data is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def pieces(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of batches with about `limit` bytes of text, one row at least: bounds what an operator holds at once."""
    for batch in batches:
        _, offsets = utf8(batch.column(column))
        a = 0
        while a < len(batch):
            b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + limit, "right")) - 1)
            yield batch.slice(a, b - a)
            a = b
    give_back()


def give_back() -> None:
    """A worker that has done a task and waits for the next keeps no freed memory."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # not glibc
        pass


_P = np.uint64(0x9E3779B97F4A7C15)
_Q = np.uint64(0xC2B2AE3D27D4EB4F)
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_TO_LOWER = np.arange(256, dtype=np.uint8)
_TO_LOWER[65:91] += 32
#: Bytes of a span beyond which it is hashed by BLAKE2b, on its own.
SHORT = 32
_MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (xor-shift and multiply)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class Spans:
    """Byte ranges of one buffer, eight bytes at a time."""

    def __init__(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray):
        padded = np.zeros((len(data) // 8 + 2) * 8, np.uint8)
        padded[: len(data)] = data
        self.data, self.starts, self.sizes = data, starts, ends - starts
        self.eights = padded.view("<u8")

    def load(self, k: int, own: np.ndarray | slice) -> np.ndarray:
        """Bytes 8 k to 8 k + 8 of the spans `own`, each longer than 8 k; bytes behind a span's end are 0."""
        at = self.starts[own] + 8 * k
        i, shift = at >> 3, ((at & 7) << 3).astype(np.uint64)
        x = self.eights[i] >> shift
        x |= self.eights[i + 1] << (np.uint64(63) - shift) << np.uint64(1)
        return x & _MASKS[np.minimum(self.sizes[own] - 8 * k, 8)]

    def bytes_of(self, i: int) -> bytes:
        a = int(self.starts[i])
        return self.data[a : a + int(self.sizes[i])].tobytes()

    def hashes(self) -> np.ndarray:
        """64 bits for each span, not linear in its bytes: blocks of eight bytes are mixed one into another, and a span of over
        32 bytes gets its BLAKE2b. n different spans have two that agree with odds of about n^2 / 2^65."""
        if not len(self.starts):
            return np.zeros(0, np.uint64)
        out = mix(self.load(0, slice(None)) ^ self.sizes.astype(np.uint64) * _P)
        for k in range(1, SHORT // 8):
            live = np.flatnonzero(self.sizes > 8 * k)
            if not len(live):
                break
            out[live] = mix(out[live] + self.load(k, live) * _Q)
        for i in np.flatnonzero(self.sizes > SHORT).tolist():
            out[i] = int.from_bytes(blake2b(self.bytes_of(i), digest_size=8).digest(), "little")
        return out


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words of rows as 64-bit hashes: (hashes, byte starts, index of each row's first word, with the end).

    A-Z are lower-cased. No Python object is made for a word of 32 bytes or less.
    """
    n = len(data)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    space = _IS_SPACE[data]
    before = np.empty(n, bool)
    before[0] = True
    before[1:] = space[:-1]
    starts = np.flatnonzero(~space & (before | edge[:n]))
    after = np.empty(n, bool)
    after[-1] = True
    after[:-1] = space[1:]
    ends = np.flatnonzero(~space & (after | edge[1:])) + 1
    return Spans(_TO_LOWER[data], starts, ends).hashes(), starts, np.searchsorted(starts, offsets)
