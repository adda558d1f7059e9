"""A counting quotient filter of fingerprints: exact, as it keeps every bit of a fingerprint, in less space than a list.

A fingerprint of `width` bits is cut into a quotient of q bits, which names its home slot, and the remainder. Fingerprints with one quotient form
a run, sorted by remainder; a run starts at its home slot, or behind the run before it. Two bits of metadata tell where runs are:
`occupied` (does a quotient have a run?) and `run_end` (does a run end in this slot?). An entry is one slot with its remainder and, if its count
is over one, further slots with the digits of count - 1 to the base 2^r (2^8 at least), least first; the third bit, `digit`, marks those. So a frequent
fingerprint takes a few slots, whatever its count.

Filters merge losslessly: their sorted remainders are merged, counts of equal ones are added. A filter that fills over LOAD is made again with
one bit more in the quotient and one less in the remainder.
"""

from __future__ import annotations

import struct

import numpy as np

LOAD = 0.9
_HEAD = struct.Struct("<BBqq")


class QuotientFilter:
    def __init__(self, width: int = 64, q: int = 4):
        self.width = width
        self._fill(np.zeros(0, np.uint64), np.zeros(0, np.int64), min(q, width))

    @property
    def r(self) -> int:
        return self.width - self.q

    @property
    def digit_bits(self) -> int:
        return max(8, self.r)

    def _fill(self, keys: np.ndarray, counts: np.ndarray, q: int) -> None:
        """From sorted distinct fingerprints; q grows until they fill LOAD of the slots at most."""
        while True:
            base = max(8, self.width - q)
            digits = np.zeros(len(keys), np.int64)
            rest = counts - 1
            while (live := rest > 0).any():
                digits += live
                rest = rest >> base if base < 63 else np.zeros_like(rest)
            if q >= self.width or len(keys) + int(digits.sum()) <= LOAD * (1 << q):
                break
            q += 1
        self.q = q
        sizes = 1 + digits
        quotient = (keys >> np.uint64(self.r)).astype(np.int64) if self.r < 64 else np.zeros(len(keys), np.int64)
        self.occupied = np.zeros(1 << q, bool)
        self.occupied[quotient] = True
        first = np.flatnonzero(np.r_[True, quotient[1:] != quotient[:-1]]) if len(keys) else np.zeros(0, np.int64)
        length = np.add.reduceat(sizes, first) if len(keys) else np.zeros(0, np.int64)
        before = np.cumsum(length) - length
        # each run starts at home or behind the run before it: the greatest of home + lengths of the runs since then
        start = before + np.maximum.accumulate(quotient[first] - before) if len(keys) else before
        n = int(max(1 << q, start[-1] + length[-1])) if len(keys) else 1 << q
        self.run_end, self.digit, self.slots = np.zeros(n, bool), np.zeros(n, bool), np.zeros(n, np.uint64)
        self.run_end[start + length - 1] = True
        at = np.repeat(start - before, np.diff(np.r_[first, len(keys)])) + np.cumsum(sizes) - sizes
        self.slots[at] = keys & np.uint64((1 << self.r) - 1)
        rest, k = counts - 1, 1
        while (live := np.flatnonzero(rest > 0)).size:
            self.digit[at[live] + k] = True
            low = rest[live] & ((1 << base) - 1) if base < 63 else rest[live]
            self.slots[at[live] + k] = low.astype(np.uint64)
            rest = rest >> base if base < 63 else np.zeros_like(rest)
            k += 1

    def items(self) -> tuple[np.ndarray, np.ndarray]:
        """(fingerprints in order, counts)."""
        homes = np.flatnonzero(self.occupied)
        ends = np.flatnonzero(self.run_end)
        starts = np.maximum(homes, np.r_[0, ends[:-1] + 1]) if len(homes) else homes
        lengths = ends - starts + 1
        used = np.repeat(starts - (np.cumsum(lengths) - lengths), lengths) + np.arange(int(lengths.sum()))
        quotient = np.repeat(homes, lengths)
        is_digit = self.digit[used]
        entry = np.flatnonzero(~is_digit)
        keys = self.slots[used[entry]] | (quotient[entry].astype(np.uint64) << np.uint64(self.r) if self.r < 64 else np.uint64(0))
        counts = np.ones(len(entry), np.int64)
        place, own = np.cumsum(~is_digit) - 1, np.flatnonzero(is_digit)
        if len(own):
            power = (own - entry[place[own]] - 1) * self.digit_bits
            np.add.at(counts, place[own], self.slots[used[own]].astype(np.int64) << np.minimum(power, 62))
        return keys, counts

    def count(self, key: int) -> int:
        """By the home slot's run alone."""
        home, rest = (key >> self.r, key & ((1 << self.r) - 1))
        if not self.occupied[home]:
            return 0
        ends = np.flatnonzero(self.run_end)
        k = int(np.count_nonzero(self.occupied[: home + 1])) - 1
        at, end = max(home, int(ends[k - 1]) + 1 if k else 0), int(ends[k])
        while at <= end:
            if not self.digit[at] and int(self.slots[at]) == rest:
                total, power = 1, 0
                while at + 1 <= end and self.digit[at + 1]:
                    at += 1
                    total += int(self.slots[at]) << power
                    power += self.digit_bits
                return total
            at += 1
        return 0

    def insert(self, keys: np.ndarray) -> None:
        """Fingerprints in any order, repeated or not."""
        new, counts = np.unique(keys, return_counts=True)
        self._add([self.items(), (new, counts.astype(np.int64))])

    def merge(self, others: list[QuotientFilter]) -> None:
        self._add([self.items(), *[x.items() for x in others]])

    def _add(self, parts: list[tuple[np.ndarray, np.ndarray]]) -> None:
        keys, counts = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.argsort(keys, kind="stable")  # sorted stretches are merged
        keys, counts = keys[order], counts[order]
        if len(keys):
            first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
            keys, counts = keys[first], np.add.reduceat(counts, first)
        self._fill(keys, counts, self.q)

    def part(self, bits: int, name: int) -> QuotientFilter:
        """The filter of the fingerprints whose first bits are the name, without those bits."""
        keys, counts = self.items()
        low = self.width - bits
        a, b = (np.searchsorted(keys >> np.uint64(low) if low < 64 else keys * np.uint64(0), np.uint64(name), side) for side in ("left", "right"))
        out = QuotientFilter(low)
        out._fill(keys[a:b] & np.uint64((1 << low) - 1), counts[a:b], 4)
        return out

    def to_bytes(self) -> bytes:
        size = -(-self.digit_bits // 8)
        packed = self.slots.view(np.uint8).reshape(-1, 8)[:, :size]
        return _HEAD.pack(self.width, self.q, len(self.slots), size) + b"".join(np.packbits(x).tobytes() for x in (self.occupied, self.run_end, self.digit)) + packed.tobytes()

    @classmethod
    def from_bytes(cls, data: bytes) -> QuotientFilter:
        width, q, n, size = _HEAD.unpack_from(data)
        out, at = cls.__new__(cls), _HEAD.size
        out.width, out.q = width, q
        for name, k in (("occupied", 1 << q), ("run_end", n), ("digit", n)):
            bits = np.frombuffer(data, np.uint8, -(-k // 8), at)
            setattr(out, name, np.unpackbits(bits, count=k).astype(bool))
            at += -(-k // 8)
        slots = np.zeros((n, 8), np.uint8)
        slots[:, :size] = np.frombuffer(data, np.uint8, n * size, at).reshape(n, size)
        out.slots = slots.view(np.uint64).reshape(-1)
        return out
