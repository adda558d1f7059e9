"""Scalar functions as column expressions: hashes, variable-length integers, composite keys, checksums, Bloom probes."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

MASK = 0xFFFFFFFF


def octets(c: str) -> str:
    """SQL: the bytes of a string or binary column as an array of bigint."""
    return f"transform(filter(split(decode(cast({c} AS binary), 'ISO-8859-1'), ''), x -> x <> ''), x -> cast(ascii(x) AS bigint))"


def poly31(c: str, seed: int = 0) -> Column:
    """h = 31 h + byte, modulo 2^32, from a seed."""
    return F.expr(f"aggregate({octets(c)}, {seed}L, (h, b) -> (h * 31 + b) % 4294967296L)")


#: Fixed value: the seed of the second hash, however many probes there are.
SECOND_SEED = 4


def bloom_probes(c: str, bits: int, k: int) -> Column:
    """Bits of a key: floorMod(h1 + i h2, bits) with 32-bit wraparound; h1 and h2 are polynomial hashes with seeds 0 and 4.

    One fold gives both: the second is the first plus 4 * 31^length.
    """
    fold = f"aggregate({octets(c)}, named_struct('h', 0L, 'p', {SECOND_SEED}L), (a, b) -> named_struct('h', (a.h * 31 + b) % 4294967296L, 'p', (a.p * 31) % 4294967296L))"
    sums = f"transform(sequence(0L, {k - 1}L), i -> (z.h + i * ((z.h + z.p) % 4294967296L)) % 4294967296L)"
    return F.expr(f"transform(array({fold}), z -> transform({sums}, x -> pmod(IF(x >= 2147483648L, x - 4294967296L, x), {bits}L)))[0]")


def _mul32(a: str, k: int) -> str:
    """SQL: a * k modulo 2^32 without overflow of 64 bits."""
    return f"((({a}) & 65535) * {k}L + (((shiftright({a}, 16) * {k}L) & 65535) * 65536)) % 4294967296L"


def _rotl(a: str, r: int) -> str:
    return f"((shiftleft({a}, {r}) & 4294967295L) | shiftright({a}, {32 - r}))"


def murmur3_32(c: str) -> Column:
    """Standard 32-bit Murmur3 with seed 0, unsigned, over whole little-endian words and the tail."""
    b = octets(c)
    mixed = lambda k: _mul32(_rotl(f"({_mul32(k, 0xCC9E2D51)})", 15), 0x1B873593)
    with_k = lambda h, k: f"({_mul32(_rotl(f'({h} ^ ({mixed(k)}))', 13), 5)} + 3864292196L) % 4294967296L"
    words = f"transform(filter(sequence(0, greatest(size(b) div 4 - 1, 0)), j -> j < size(b) div 4), j -> b[j * 4] + b[j * 4 + 1] * 256 + b[j * 4 + 2] * 65536 + b[j * 4 + 3] * 16777216)"
    tail = "aggregate(filter(sequence(0, 2), j -> (size(b) div 4) * 4 + j < size(b)), 0L, (t, j) -> t + b[(size(b) div 4) * 4 + j] * shiftleft(1L, 8 * j))"
    body = f"aggregate({words}, 0L, (h, k) -> {with_k('h', 'k')})"
    last = f"(({body}) ^ ({mixed(f'({tail})')})) ^ cast(size(b) AS bigint)"
    step = lambda x, r: f"(({x}) ^ shiftright({x}, {r}))"
    # final mixing, one value at a time through one-element arrays, so that no expression is written out twice
    final = f"transform(array({last}), h -> {step('h', 16)})"
    final = f"transform({final}, h -> {_mul32('h', 0x85EBCA6B)})"
    final = f"transform({final}, h -> {step('h', 13)})"
    final = f"transform({final}, h -> {_mul32('h', 0xC2B2AE35)})"
    final = f"transform({final}, h -> {step('h', 16)})[0]"
    return F.expr(f"transform(array({b}), b -> {final})[0]")


def _by_length(values: pd.Series, run: Callable[[np.ndarray], np.ndarray]) -> pd.Series:
    """Applies a function of an array (keys, bytes) to the values of each length; null stays null."""
    out = np.zeros(len(values), np.int64)
    real = np.flatnonzero(values.notna().to_numpy())
    raw = [bytes(values.iloc[i]) for i in real]
    sizes = np.array([len(x) for x in raw], np.int64)
    order = np.argsort(sizes, kind="stable")
    for part in np.split(order, np.flatnonzero(np.diff(sizes[order])) + 1) if len(order) else []:
        data = np.frombuffer(b"".join(raw[i] for i in part), np.uint8).reshape(len(part), -1)
        out[real[part]] = run(data).astype(np.int64)
    return pd.Series(out, values.index).where(values.notna()).astype("Int64")


# The constants of Murmur3 (x64, 128 bits) and of CRC-32C.
_C1, _C2 = np.uint64(0x87C37B91114253D5), np.uint64(0x4CF5AD432745937F)
_M1, _M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
_CASTAGNOLI = 0x82F63B78


def _rot64(x: np.ndarray, r: int) -> np.ndarray:
    return x << np.uint64(r) | x >> np.uint64(64 - r)


def murmur3_128_low(data: np.ndarray) -> np.ndarray:
    """Low 64 bits of the 128-bit Murmur3 with seed 0, of keys of one length: an array (keys, bytes)."""
    n, size = data.shape
    padded = np.zeros((n, (size // 16 + 1) * 16), np.uint8)
    padded[:, :size] = data
    halves = padded.view("<u8")
    h1 = h2 = np.zeros(n, np.uint64)
    for i in range(0, size // 16 * 2, 2):
        h1 = (_rot64(h1 ^ _rot64(halves[:, i] * _C1, 31) * _C2, 27) + h2) * np.uint64(5) + np.uint64(0x52DCE729)
        h2 = (_rot64(h2 ^ _rot64(halves[:, i + 1] * _C2, 33) * _C1, 31) + h1) * np.uint64(5) + np.uint64(0x38495AB5)
    h1, h2 = h1 ^ _rot64(halves[:, -2] * _C1, 31) * _C2 ^ np.uint64(size), h2 ^ _rot64(halves[:, -1] * _C2, 33) * _C1 ^ np.uint64(size)
    h1 = h1 + h2
    h2 = h2 + h1
    for m in (_M1, _M2):
        h1, h2 = (h1 ^ h1 >> np.uint64(33)) * m, (h2 ^ h2 >> np.uint64(33)) * m
    return (h1 ^ h1 >> np.uint64(33)) + (h2 ^ h2 >> np.uint64(33))


def fingerprint63(c: Column) -> Column:
    """Low 63 bits of the 128-bit Murmur3 of a string or binary column; null stays null."""

    @F.pandas_udf("long")
    def run(keys: pd.Series) -> pd.Series:
        return _by_length(keys, lambda x: murmur3_128_low(x) & np.uint64((1 << 63) - 1))

    return run(c.cast("binary"))


def _crc_table() -> np.ndarray:
    out = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        out = np.where(out & 1, out >> 1 ^ np.uint32(_CASTAGNOLI), out >> 1)
    return out


_CRC32C = _crc_table()


def crc32c_rows(data: np.ndarray) -> np.ndarray:
    """Of values of one length: an array (values, bytes)."""
    r = np.full(len(data), MASK, np.uint32)
    for column in data.T:
        r = r >> np.uint32(8) ^ _CRC32C[(r ^ column) & np.uint32(255)]
    return r ^ np.uint32(MASK)


def _spans(n: int) -> np.ndarray:
    """What a byte gives that n - 1, n - 2, ... 0 bytes follow, one after the other."""
    out = np.empty((n, 256), np.uint32)
    out[-1] = _CRC32C
    for i in range(n - 2, -1, -1):
        out[i] = out[i + 1] >> np.uint32(8) ^ _CRC32C[out[i + 1] & np.uint32(255)]
    return out.ravel()


_SPAN = 1024
_SPANS, _PLACES = _spans(_SPAN), np.arange(_SPAN) * 256


def crc32c_bytes(data: bytes) -> int:
    """Of one value. A checksum is the sum (exclusive or) of what its bytes give by their places, so a span is one look-up."""
    raw, r = np.frombuffer(data, np.uint8), MASK
    for at in range(0, len(raw), _SPAN):
        part = raw[at : at + _SPAN].copy()
        n = len(part)
        part[:4] ^= np.frombuffer(r.to_bytes(4, "little"), np.uint8)[:n]
        r = int(np.bitwise_xor.reduce(_SPANS.take(part + _PLACES[_SPAN - n :]))) ^ r >> 8 * n
    return r ^ MASK


def crc32c(c: Column) -> Column:
    """CRC-32C (Castagnoli), unsigned; null stays null."""

    @F.pandas_udf("long")
    def run(values: pd.Series) -> pd.Series:
        return _by_length(values, crc32c_rows)

    return run(c.cast("binary"))


def varint_hex(n: str) -> str:
    """SQL: unsigned LEB128 of a bigint from 0 on, as upper-case hex; a negative one is an error."""
    byte = lambda i, more: f"lpad(hex((shiftright({n}, {7 * i}) & 127) | {128 if more else 0}), 2, '0')"
    cases = " ".join(f"WHEN {n} < {1 << 7 * w}L THEN concat({', '.join(byte(i, i < w - 1) for i in range(w))})" for w in range(1, 9))
    return f"CASE WHEN {n} < 0 THEN cast(raise_error('a negative number has no unsigned form') AS string) {cases} ELSE concat({', '.join(byte(i, i < 8) for i in range(9))}) END"


def varint(n: str) -> Column:
    return F.unhex(F.expr(varint_hex(n)))


def read_varint(c: str) -> Column:
    """The value of an LEB128 binary."""
    return F.expr(f"aggregate(transform({octets(c)}, (b, i) -> (b & 127) * shiftleft(1L, 7 * i)), 0L, (a, x) -> a + x)")


def inverted_ts(ts: Column) -> Column:
    """Complement, big-endian, as hex: newest first as unsigned bytes for times from 0 on."""
    return F.lpad(F.hex(F.bitwise_not(ts)), 16, "0")


def composite_key(row: str, family: str, qualifier: str, ts: str) -> Column:
    """varint(row length) row varint(family) varint(qualifier length) qualifier complement(ts): a function, not the order of the store."""
    text = lambda c: f"unhex({varint_hex(f'cast(octet_length({c}) AS bigint)')}), cast({c} AS binary)"
    return F.expr(f"concat({text(row)}, unhex({varint_hex(f'cast({family} AS bigint)')}), {text(qualifier)}, unhex(lpad(hex(~{ts}), 16, '0')))")


def split_composite(key: str) -> dict[str, Column]:
    """Row, family, qualifier and time of a composite key; one that is cut off or too long is an error."""
    width = lambda at: "CASE " + " ".join(f"WHEN b[{at} + {i}] < 128 THEN {i + 1}" for i in range(4)) + " ELSE 5 END"
    value = lambda at, w: f"aggregate(sequence(0, {w} - 1), 0L, (v, i) -> v + (b[{at} + i] & 127) * shiftleft(1L, 7 * i))"

    def let(name: str, given: str, then: str) -> str:  # binds a name to what is used more than once
        return f"transform(array({given}), {name} -> {then})[0]"

    fields = f"named_struct('row', substring({key}, 1 + rw, cast(r AS int)), 'family', f, 'qualifier', substring({key}, cast(1 + rw + r + fw + qw AS int), cast(q AS int)), 'ts', ~cast(conv(hex(substring({key}, cast(1 + rw + r + fw + qw + q AS int), 8)), 16, -10) AS bigint))"
    whole = f"IF(octet_length({key}) = rw + r + fw + qw + q + 8, {fields}, cast(raise_error('not a composite key') AS struct<row: binary, family: bigint, qualifier: binary, ts: bigint>))"
    after_row, after_family = "cast(rw + r AS int)", "cast(rw + r AS int) + fw"
    parsed = let("b", octets(key), let("rw", width("0"), let("r", value("0", "rw"), let("fw", width(after_row), let("f", value(after_row, "fw"), let("qw", width(after_family), let("q", value(after_family, "qw"), whole)))))))
    parsed = f"IF(octet_length({key}) < 11, cast(raise_error('not a composite key') AS struct<row: binary, family: bigint, qualifier: binary, ts: bigint>), {parsed})"
    return {"row_key": F.expr(f"cast(({parsed}).row AS string)"), "family_id": F.expr(f"cast(({parsed}).family AS int)"), "column_key": F.expr(f"cast(({parsed}).qualifier AS string)"), "ts": F.expr(f"({parsed}).ts")}
