"""Data blocks by size: entries with prefix-coded keys, restarts, zstd, and a checksum; encoded, verified and decoded.

A block's entries: varint(shared) varint(unshared) varint(value length) key rest, value. Keys share a prefix (of bytes) with the key before, but for
every `restart`-th entry. After the entries stand the restarts' offsets and their number (i32). Stored: a header of 12 bytes (stored size i32,
payload size i32, type u8 0, flags u8 1 if compressed, u16 0), the payload, as zstd if that is smaller, and the CRC-32C of both (i32); big-endian.

A block ends when the estimate of its size reaches block_size: bytes so far, 8 for each restart, and 8.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.codec import crc32c_bytes
from .cells import CELL

HEADER, LEVEL = struct.Struct(">iiBBH"), 3
#: Decoded entries are handed on in batches of about so many rows or bytes, not block by block.
TOLD_ROWS, TOLD_BYTES = 10_000, 1 << 22


def put_varint(n: int) -> bytes:
    out = bytearray()
    while n >= 128:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def get_varint(data: bytes, at: int) -> tuple[int, int]:
    """(value, where the next byte is)."""
    n = shift = 0
    while True:
        if at >= len(data) or shift > 63:
            raise ValueError("a variable-length integer is cut off")
        n |= (data[at] & 127) << shift
        shift, at = shift + 7, at + 1
        if data[at - 1] < 128:
            return n, at


def shared_length(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    differ = int.from_bytes(a[:n], "big") ^ int.from_bytes(b[:n], "big")
    return n - (differ.bit_length() + 7) // 8


class Builder:
    def __init__(self, restart: int = 16):
        self.restart, self.out, self.last, self.restarts, self.count, self.first = restart, bytearray(), b"", [], 0, b""

    def add(self, key: bytes, value: bytes) -> int:
        """Length of the prefix shared with the key before."""
        shared = 0
        if self.count % self.restart:
            shared = shared_length(self.last, key)
        else:
            self.restarts.append(len(self.out))
        if not self.count:
            self.first = key
        self.out += put_varint(shared) + put_varint(len(key) - shared) + put_varint(len(value)) + key[shared:] + value
        self.last, self.count = key, self.count + 1
        return shared

    def estimate(self) -> int:
        return len(self.out) + 8 * len(self.restarts) + 8

    def finish(self) -> bytes:
        payload = bytes(self.out) + b"".join(struct.pack(">i", x) for x in (*self.restarts, len(self.restarts)))
        packed = zstandard.ZstdCompressor(LEVEL).compress(payload)
        stored, flag = (packed, 1) if len(packed) < len(payload) else (payload, 0)
        head = HEADER.pack(len(stored), len(payload), 0, flag, 0)
        return head + stored + struct.pack(">I", crc32c_bytes(head + stored))


def decode(block: bytes) -> Iterator[tuple[bytes, bytes]]:
    """(key, value) of a stored block's entries; a wrong checksum or a broken entry is an error."""
    if len(block) < HEADER.size + 4:
        raise ValueError("a block is cut off")
    if crc32c_bytes(block[:-4]) != struct.unpack(">I", block[-4:])[0]:
        raise ValueError("a block's checksum is wrong")
    size, whole, _, flag, _ = HEADER.unpack_from(block)
    if size != len(block) - HEADER.size - 4:
        raise ValueError("a block's size is wrong")
    payload = block[HEADER.size : -4]
    if flag & 1:
        payload = zstandard.ZstdDecompressor().decompress(payload, max_output_size=whole)
    (n,) = struct.unpack(">i", payload[-4:])
    at, end, last = 0, len(payload) - 4 - 4 * n, b""
    if n < 0 or end < 0:
        raise ValueError("a block's restarts are broken")
    while at < end:
        shared, at = get_varint(payload, at)
        rest, at = get_varint(payload, at)
        length, at = get_varint(payload, at)
        if shared > len(last) or at + rest + length > end:
            raise ValueError("a block's entry is broken")
        last = last[:shared] + payload[at : at + rest]
        at += rest + length
        yield last, payload[at - length : at]


def encode_blocks(segments: DataFrame, key: str, value: str, order: list, by: str = "segment", block_size: int = 4096, restart: int = 16) -> DataFrame:
    """by, block, first_key, entries, estimate, stored: the blocks of each segment. A segment is one task's work, as it is one file's."""
    rows = segments.select(F.col(by).alias("by"), F.col(key).cast("binary").alias("k"), F.col(value).cast("binary").alias("v"), *[c.alias(f"o{i}") for i, c in enumerate(order)])
    kind = rows.schema["by"].dataType.simpleString()
    sort = [(f"o{i}", "ascending") for i in range(len(order))]

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by(sort)
        out, b = [], Builder(restart)

        def end() -> None:
            nonlocal b
            out.append((len(out), b.first, b.count, b.estimate(), b.finish()))
            b = Builder(restart)

        for k, v in zip(table.column("k").to_pylist(), table.column("v").to_pylist(), strict=True):
            b.add(k or b"", v or b"")
            if b.estimate() >= block_size:
                end()
        if b.count:
            end()
        kinds = (pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.binary())
        columns = [pa.array(x, t) for x, t in zip(zip(*out, strict=True), kinds, strict=True)]
        return pa.table([table.column("by").combine_chunks().take(pa.array([0] * len(out))), *columns], ["by", "block", "first_key", "entries", "estimate", "stored"])

    return rows.groupBy("by").applyInArrow(run, f"by {kind}, block long, first_key binary, entries long, estimate long, stored binary").withColumnRenamed("by", by)


def decode_blocks(blocks: DataFrame, by: str = "segment") -> DataFrame:
    """by, block, place, key, value: the entries of stored blocks, verified."""
    rows = blocks.select(F.col(by).alias("by"), "block", "stored")
    kind = rows.schema["by"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own, places, found, size = [], [], [], 0

            def told() -> pa.RecordBatch:
                rows = pa.array(own, pa.int64())
                return pa.RecordBatch.from_arrays([batch.column("by").take(rows), batch.column("block").take(rows), pa.array(places, pa.int64()), pa.array([k for k, _ in found], pa.binary()), pa.array([v for _, v in found], pa.binary())], ["by", "block", "place", "key", "value"])

            for i, data in enumerate(batch.column("stored")):
                before = len(found)
                found.extend(decode(data.as_py()))
                own.extend([i] * (len(found) - before))
                places.extend(range(len(found) - before))
                size += sum(len(k) + len(v) for k, v in found[before:])
                if size >= TOLD_BYTES or len(found) >= TOLD_ROWS:
                    yield told()
                    own, places, found, size = [], [], [], 0
            if found:
                yield told()

    return rows.mapInArrow(run, f"by {kind}, block long, place long, key binary, value binary").withColumnRenamed("by", by)


def cell_order() -> list:
    """Order of cells: row, family, column, time descending."""
    return [*[F.col(c) for c in CELL], -F.col("ts")]
