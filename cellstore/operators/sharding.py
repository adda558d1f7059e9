"""Sharding functions: from a key column to a shard in [0, n), with a name and a config that a manifest keeps."""

from __future__ import annotations

import struct

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.codec import fingerprint63, murmur3_32


class ModSharder:
    name, config = "mod", b""

    def shard_of(self, key: str, n: int) -> Column:
        _positive(n)
        return F.pmod(murmur3_32(key).bitwiseAND(0x7FFFFFFF), F.lit(n).cast("long"))


class FingerprintSharder:
    name, config = "fingerprint:v2", b""

    def shard_of(self, key: str, n: int) -> Column:
        _positive(n)
        return F.pmod(fingerprint63(F.col(key)), F.lit(n).cast("long"))


class RangeSharder:
    """Boundaries ascend strictly; a boundary key belongs to the shard on its right."""

    name = "range:v1"

    def __init__(self, boundaries: list[str]):
        if not boundaries:
            raise ValueError("boundaries must not be empty")
        if any(a.encode() >= b.encode() for a, b in zip(boundaries, boundaries[1:], strict=False)):
            raise ValueError("boundaries must ascend strictly")
        self.boundaries = list(boundaries)

    def shard_of(self, key: str, n: int) -> Column:
        if n != len(self.boundaries) + 1:
            raise ValueError(f"{len(self.boundaries)} boundaries make {len(self.boundaries) + 1} shards, not {n}")
        bounds = F.array(*[F.lit(b) for b in self.boundaries])
        return F.size(F.filter(bounds, lambda b: b <= F.col(key))).cast("long")

    @property
    def config(self) -> bytes:
        """Count, then length and bytes of each boundary, big-endian."""
        coded = [b.encode() for b in self.boundaries]
        return struct.pack(">i", len(coded)) + b"".join(struct.pack(">i", len(b)) + b for b in coded)

    @classmethod
    def from_config(cls, config: bytes) -> RangeSharder:
        if config is None or len(config) < 4:
            raise ValueError("a range config has 4 bytes at least")
        (n,), at, out = struct.unpack_from(">i", config), 4, []
        for _ in range(n):
            size = struct.unpack_from(">i", config, at)[0] if at + 4 <= len(config) else -1
            if size < 0 or at + 4 + size > len(config):
                raise ValueError("a range config is cut off")
            out.append(config[at + 4 : at + 4 + size].decode())
            at += 4 + size
        return cls(out)

    def shards_of_range(self, start: str, end: str) -> list[int]:
        """Shards that can hold keys in [start, end): literals for partition pruning."""
        if start.encode() >= end.encode():
            return []
        first = sum(b.encode() <= start.encode() for b in self.boundaries)
        return list(range(first, sum(b.encode() < end.encode() for b in self.boundaries) + 1))


def _positive(n: int) -> None:
    if n <= 0:
        raise ValueError("the number of shards must be positive")


def sharder(name: str, config: bytes = b""):
    """By the name that a manifest keeps; an unknown name is an error."""
    if name == RangeSharder.name:
        return RangeSharder.from_config(config)
    for kind in (ModSharder, FingerprintSharder):
        if kind.name == name:
            return kind()
    raise ValueError(f"no sharder is named {name}")


def shard_name(base: str, shard: Column, n: int) -> Column:
    return F.format_string("%s-%05d-of-%05d.sst", F.lit(base), shard, F.lit(n))


def scan_range_sharded(stored: DataFrame, by: RangeSharder, start: str, end: str, key: str = "row_key") -> DataFrame:
    """A range scan that reads only the shards which can hold the range: the shard column is a partition of the files."""
    return stored.filter(F.col("shard").isin(by.shards_of_range(start, end))).filter((F.col(key) >= start) & (F.col(key) < end))
