"""Words taken from each source against its target, with tiny sources beside a hot one."""

from __future__ import annotations

from collections import defaultdict

from cellstore.llm import mixing


def test_each_source_meets_its_target(spark):
    """A block of the hot source has 13 words; the tiny ones have 1, 14 and 300."""
    rows = [(i, "w " * 20_000, "hot") for i in range(42)]
    rows += [(100, "one", "tiny"), (200, "w " * 6, "small"), (201, "w " * 8, "small")]
    rows += [(300 + i, "w " * 10, None) for i in range(30)]
    got = mixing.mix_sources(spark.createDataFrame(rows, "doc_id long, text string, source string"), carry=("source",)).collect()
    assert len(got) == len(rows)
    taken, target = defaultdict(int), {}
    for r in got:
        taken[r.source] += r.taken
        target[r.source] = r.target
        assert 0 <= r.taken <= 3 * r["size"]
    assert target["tiny"] == 3 and target["small"] == 42 and target[None] == 900
    for s, aim in target.items():
        assert abs(taken[s] - aim) <= max(0.5, aim / 512), (s, taken[s], aim)


def test_a_large_source_with_a_small_target(spark):
    """Weights leave the large source a hundredth of all words."""
    rows = [(i, "w " * 1000, "a" if i < 150 else "b") for i in range(300)]
    got = mixing.mix_sources(spark.createDataFrame(rows, "doc_id long, text string, source string"), weights=(1, 99), most=9, carry=("source",)).collect()
    for s in ("a", "b"):
        aim = next(r.target for r in got if r.source == s)
        assert abs(sum(r.taken for r in got if r.source == s) - aim) <= max(0.5, aim / 512), s
