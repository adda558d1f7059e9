"""Bands of sizes in the n-gram join: rows that may start a link meet, for any sizes, places and thresholds."""

import random

import pytest

from cellstore.llm.ngram_join import _partner_bands


@pytest.mark.parametrize("percent", [50, 75, 90, 100])
def test_rows_that_may_link_meet(spark, percent):
    rng = random.Random(percent)
    sizes = [*range(1, 40), *(rng.randrange(40, 5000) for _ in range(60))]
    rows = [(1, i, s, p) for i, (s, p) in enumerate((s, p) for s in sizes for p in {0, s - -(-s * percent // 100), rng.randrange(s)})]
    df = spark.createDataFrame(rows, "token long, m long, size int, place int")
    keys: dict[int, set] = {}
    for r in _partner_bands(df, percent).collect():
        keys.setdefault(r["m"], set()).add((r["own"], r["partner"]))
    for _, a, s, p in rows:
        for _, b, t, q in rows:
            needed = -(-percent * (s + t) // (100 + percent))
            if s - p >= needed and t - q >= needed:
                assert any((y, x) in keys.get(b, ()) for x, y in keys.get(a, ())), (s, p, t, q)
