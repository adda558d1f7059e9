"""The mix against a plain version: targets, slots in van der Corput order, blocks, words taken and the first slot of every document."""

from __future__ import annotations

import math
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from cellstore.llm import mixing

SF = "/root/testdata/sf0.001"


def plain_targets(sizes, weights=(5, 2, 1), most=3):
    """By sharing again and again. sizes: in source order."""
    w = {s: weights[k % len(weights)] for k, s in enumerate(sizes)}
    capped, total = {}, sum(sizes.values())
    while True:
        free = [s for s in sizes if s not in capped]
        left, weight = total - sum(capped.values()), sum(w[s] for s in free)
        over = [s for s in free if left * w[s] > most * sizes[s] * weight]
        if not over:
            return {s: capped[s] if s in capped else left * w[s] / weight for s in sizes}
        capped |= {s: most * sizes[s] for s in over}


def plain_mix(rows, hashes, most=3):
    """rows: (id, size, source). For each: taken, first slot."""
    names = sorted({s for *_, s in rows}, key=lambda s: (s is None, s or ""))
    sizes = {s: sum(n for _, n, t in rows if t == s) for s in names}
    total, aims, upto, out = sum(sizes.values()), plain_targets(sizes), 0.0, {}
    for s in names:
        bits = max(16, math.ceil(math.log2(256 * total / aims[s]))) if aims[s] else 16
        blocks = max(1, min(math.floor(sizes[s] / total * 2**bits), sizes[s]))
        slots = min(math.floor(aims[s] / max(1, sizes[s]) * blocks + 0.5), most * blocks, 2**bits)
        start = max(0, min(math.floor(upto / total * 2**bits + 0.5), 2**bits - slots))
        upto += aims[s]
        times = sorted(int(format(p, f"0{bits}b")[::-1], 2) / 2**bits for p in range(start, start + slots))
        used = defaultdict(list)
        for rank, t in enumerate(times):
            used[rank % blocks].append((t, rank))
        edge = lambda b: -(-b * sizes[s] // blocks)  # noqa: E731, B023
        at = 0
        for i, n, _ in sorted((r for r in rows if r[2] == s), key=lambda r: (hashes[r[0]] % mixing.BUCKETS, hashes[r[0]])):
            shares = [(min(at + n, edge(b + 1)) - max(at, edge(b)), b) for b in range(blocks) if edge(b) < at + n and at < edge(b + 1)] if n else []
            out[i] = (aims[s], sum(k * len(used[b]) for k, b in shares), min((used[b][0] for k, b in shares if used[b]), default=(None, None)))
            at += n
    return out


@pytest.mark.parametrize("case", ["documents", "tiny sources"])
def test_against_plain_version(spark, case):
    if case == "documents":
        docs = spark.read.parquet(f"{SF}/documents.parquet").filter("doc_id < 60").select("doc_id", F.substring("text", 1, 900).alias("text"), "source")
    else:
        docs = spark.createDataFrame([(i, "w " * (i % 9), "abc"[i % 3]) for i in range(40)] + [(100, "one", "tiny"), (101, None, "none"), (102, "x y", None)], "doc_id long, text string, source string")
    rows = [(r.doc_id, len(re.findall(r"[^\x20\x09-\x0d]+", r.text or "")), r.source) for r in docs.collect()]
    hashes = {r.doc_id: r.h for r in docs.select("doc_id", F.xxhash64(F.lit(7), "doc_id").alias("h")).collect()}
    want = plain_mix(rows, hashes)
    got = mixing.mix_sources(docs).collect()
    assert len(got) == len(rows)
    for r in got:
        target, taken, (slot, rank) = want[r.doc_id]
        assert abs(r.target - target) < 1e-6 and r.taken == taken, r
        assert (r.slot, r["rank"]) == (slot, rank), (r, slot, rank)


def test_other_points_another_schedule(spark, monkeypatch):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    order = lambda: [r.doc_id for r in mixing.mix_sources(docs).filter("taken > 0").orderBy("slot", "doc_id").collect()]
    before = order()
    assert before == order()
    monkeypatch.setattr(F, "reverse", lambda c: c)
    assert before != order()


def test_any_stretch_of_the_schedule_is_mixed(spark):
    """Slots of a source among the first k of the schedule are close to its share of k."""
    sizes = spark.createDataFrame([("a", 60_000), ("b", 30_000), ("c", 10_000)], "source string, source_size long")
    aims = mixing.cut_blocks(mixing.targets(sizes), 100_000)
    slots = sorted((r.at, r.source) for r in mixing.schedule(aims, 100_000).collect())
    share = {r.source: r.target / 100_000 for r in aims.collect()}
    for k in (100, 1000, 10_000):
        for s, w in share.items():
            assert abs(sum(x == s for _, x in slots[:k]) - w * k) <= 2 * math.log2(k) + 1
