"""The flat record format of logs and dumps: UTF row, UTF column, i64 time, bool deleted, then i32 length and bytes; big-endian.

`write` encodes each partition as one file, through Arrow's file systems (local, HDFS, S3 and such). `read` finds files by Spark's binaryFile source and decodes on the executors; a file is one record stream, so it is the unit of work.
Both go through a file in steps, so a worker's memory doesn't grow with the file. Where Arrow can't open the files, Spark hands each one over as a whole (2 GB at most); its records are still decoded in steps.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator
from contextlib import suppress
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHUNK = 1 << 20


def encode(records: list[tuple[str, str, int, bool, bytes | None]]) -> bytes:
    out = []
    for row, column, ts, deleted, value in records:
        if not deleted and value is None:
            raise ValueError("a put needs a value")
        for text in (row, column):
            data = text.encode()
            if len(data) > 0xFFFF:
                raise ValueError("a key has 65535 bytes at most in this format")
            out.append(struct.pack(">H", len(data)) + data)
        out.append(struct.pack(">q?", ts, deleted))
        if not deleted:
            out.append(struct.pack(">i", len(value)) + value)
    return b"".join(out)


def _record(data: bytes, at: int) -> tuple[tuple[str, str, int, bool, bytes | None], int] | None:
    """The record at a place and where the next one is; None if it is cut off."""
    texts = []
    for _ in range(2):
        if at + 2 > len(data):
            return None
        (n,) = struct.unpack_from(">H", data, at)
        texts.append(data[at + 2 : at + 2 + n])
        at += 2 + n
    if at + 9 > len(data):
        return None
    ts, deleted = struct.unpack_from(">q?", data, at)
    at += 9
    value = None
    if not deleted:
        if at + 4 > len(data):
            return None
        (n,) = struct.unpack_from(">i", data, at)
        if n < 0:
            raise ValueError("a record's length is negative")
        if at + 4 + n > len(data):
            return None
        value = data[at + 4 : at + 4 + n]
        at += 4 + n
    return (texts[0].decode(), texts[1].decode(), ts, deleted, value), at


def decode(data: bytes) -> Iterator[tuple[str, str, int, bool, bytes | None]]:
    """Records up to the end, or up to one that is cut off (what a crash leaves)."""
    at = 0
    while found := _record(data, at):
        record, at = found
        yield record


def decode_steps(source, chunk: int = CHUNK) -> Iterator[list[tuple[str, str, int, bool, bytes | None]]]:
    """What `decode` gives, as lists: the whole records of about a chunk of the stream, or one that is longer."""
    data, step = b"", chunk
    while more := source.read(step):
        data, rows, at = data + more, [], 0
        while found := _record(data, at):
            record, at = found
            rows.append(record)
        data = data[at:]
        step = chunk if rows else max(chunk, len(data))  # a long record is tried again when the bytes have doubled
        if rows:
            yield rows


def _place(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(quote(path, safe=":/@?=&,%")) if "://" in path else (fs.LocalFileSystem(), path.removeprefix("file:"))


def _opens(path: str) -> bool:
    """Whether Arrow finds the file by this path."""
    try:
        store, at = _place(path)
        return store.get_file_info(at).type == fs.FileType.File
    except (pa.ArrowException, OSError, ValueError):
        return False


def _decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Operations of files, given by path and, where Arrow can't open them, content."""
    for batch in batches:
        for i, name in enumerate(batch.column("path").to_pylist()):
            if "content" in batch.schema.names:
                source = pa.BufferReader(batch.column("content")[i].as_buffer())
            else:
                store, at = _place(name)
                source = store.open_input_stream(at, compression=None)
            n = 0
            with source:
                for rows in decode_steps(source):
                    columns = list(zip(*rows, strict=True))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([name] * len(rows), pa.string()), pa.array(columns[0], pa.string()), pa.array([0] * len(rows), pa.int32()), pa.array(columns[1], pa.string()), pa.array(columns[2], pa.int64()), pa.array(["DELETE" if d else "PUT" for d in columns[3]], pa.string()), pa.array(columns[4], pa.binary()), pa.array(range(n, n + len(rows)), pa.int64())],
                        ["file", "row_key", "family_id", "column_key", "ts", "entry_type", "value", "seq"],
                    )
                    n += len(rows)


def read(spark: SparkSession, path: str) -> DataFrame:
    """Operations of all files; arrival is the place in the file."""
    files = spark.read.format("binaryFile").load(path)
    first = files.select("path").first()
    files = files.select("path", *([] if first and _opens(first["path"]) else ["content"]))
    return files.mapInArrow(_decoded, "file string, row_key string, family_id int, column_key string, ts long, entry_type string, value binary, seq long")


def _encoded(batches: Iterator[pa.RecordBatch], path: str, name: str) -> Iterator[pa.RecordBatch]:
    """Writes the file of a partition, if it has rows, and tells what it holds."""
    filled = (b for b in batches if b.num_rows)
    batch = next(filled, None)
    if batch is None:
        return
    store, at = _place(path)
    name, hidden = f"{at.rstrip('/')}/{name}", f"{at.rstrip('/')}/_{uuid.uuid4().hex}"
    store.create_dir(at, recursive=True)
    n = size = 0
    try:
        with store.open_output_stream(hidden) as f:
            while batch is not None:
                columns = (batch.column(c).to_pylist() for c in ("row_key", "column_key", "ts", "deleted", "value"))
                data = encode(list(zip(*columns, strict=True)))
                f.write(data)
                n, size, batch = n + batch.num_rows, size + len(data), next(filled, None)
    except BaseException:
        with suppress(OSError):
            store.delete_file(hidden)
        raise
    store.move(hidden, name)
    yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([n], pa.int64()), pa.array([size], pa.int64())], ["file", "records", "bytes"])


def write(cells: DataFrame, path: str, suffix: str = "sst") -> DataFrame:
    """Puts and deletions as record files, in the order of the partitions' rows. Gives file, records and bytes, once the files are written.

    Each file is written under a name of its own and moved in place when it is whole, so a task that is run again leaves no half file, but
    one that succeeded before its executor was lost may leave its records twice: equal records of one key are one entry on reading.
    """
    bad = cells.filter("entry_type NOT IN ('PUT', 'DELETE') OR entry_type = 'PUT' AND value IS NULL OR row_key IS NULL OR column_key IS NULL OR ts IS NULL")
    if not bad.isEmpty():
        raise ValueError("the format holds puts with a value and deletions")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        return _encoded(batches, path, f"part-{TaskContext.get().partitionId():05d}.{suffix}")

    rows = cells.select("row_key", "column_key", "ts", (F.col("entry_type") == "DELETE").alias("deleted"), F.col("value").cast("string").cast("binary").alias("value"))
    files = rows.mapInArrow(run, "file string, records long, bytes long").collect()  # a row for each file
    return cells.sparkSession.createDataFrame(files, "file string, records long, bytes long")
