"""The counting quotient filter against a Counter: insert, count, merge, resize, blocks, bytes; and the dedup beyond a broadcast."""

from __future__ import annotations

from collections import Counter

import numpy as np
import pytest

from cellstore.llm import exact_dedup
from cellstore.llm.quotient import QuotientFilter


def told(f):
    keys, counts = f.items()
    assert (np.diff(keys.astype(object)) > 0).all()
    return dict(zip(keys.tolist(), counts.tolist(), strict=True))


@pytest.mark.parametrize("width", [10, 33, 60, 64])
def test_against_a_counter(width):
    rng = np.random.default_rng(width)
    keys = rng.integers(0, 1 << min(width, 63), 6000, dtype=np.uint64)
    if width == 64:
        keys = keys * np.uint64(2) + np.uint64(1)
    hot = np.repeat(keys[:1], 3000)  # a third of all
    keys = np.concatenate([keys, hot])
    rng.shuffle(keys)
    want = Counter(keys.tolist())
    f = QuotientFilter(width)
    sizes = []
    for part in np.array_split(keys, 7):
        f.insert(part)
        sizes.append(f.q)
    assert told(f) == want and (sizes[0] < sizes[-1] or width == 10)
    for k in [*list(want)[:200], int(hot[0])]:
        assert f.count(k) == want[k]
    if width > 10:
        assert f.count(next(k for k in range(1 << 20) if k not in want)) == 0
    assert told(QuotientFilter.from_bytes(f.to_bytes())) == want
    parts = [QuotientFilter(width) for _ in range(4)]
    for g, part in zip(parts, np.array_split(keys, 4), strict=True):
        g.insert(part)
    parts[0].merge(parts[1:])
    assert told(parts[0]) == want
    blocks = {}
    for name in range(16):
        blocks |= {name << width - 4 | k: n for k, n in told(f.part(4, name)).items()}
    assert blocks == want


def test_a_frequent_fingerprint_takes_few_slots():
    f = QuotientFilter(60)
    f._add([(np.array([5], np.uint64), np.array([10**12], np.int64))])
    assert f.count(5) == 10**12 and int(f.digit.sum()) <= 2


def test_empty():
    f = QuotientFilter(64)
    f.insert(np.zeros(0, np.uint64))
    assert told(f) == {} and told(QuotientFilter.from_bytes(f.to_bytes())) == {} and f.count(3) == 0


@pytest.mark.parametrize("bits", [26, 8])
def test_dedup_without_a_broadcast(spark, monkeypatch, bits):
    """Also with a bitmap so small that it is full."""
    monkeypatch.setattr(exact_dedup, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(exact_dedup, "FILTER_BITS", bits)
    rows = [(i, f"text {i % 70}" if i < 100 else f"own {i}") for i in range(300)] + [(1000 + i, "hot  text") for i in range(150)] + [(None, None), (5000, "")]
    got = {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in exact_dedup.exact_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    names = Counter(" ".join((t or "").split(" ")) if t != "hot  text" else "hot text" for _, t in rows)
    least = {}
    for i, t in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        least.setdefault((t or ""), i)
    assert got == {i: (least[t or ""], names[t or ""] if t != "hot  text" else 150, least[t or ""] == i) for i, t in rows}
