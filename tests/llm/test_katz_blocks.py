"""The Katz model in many blocks: backoff weights don't depend on which words of a block training text has."""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter, defaultdict

from cellstore.llm import katz

SF = "/root/testdata/sf0.001"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def factors(counts):
    of = Counter(counts)
    common = 6 * of[6] / of[1]
    d = {r: ((r + 1) * of[r + 1] / of[r] / r - common) / (1 - common) for r in range(1, 6)}
    return {r: x if 0 < x < 1 else (r - 0.5) / r for r, x in d.items()}


def test_histories_before_unknown_words_only(spark):
    """Each added text stands in a block of its own and has a training word before unknown words only."""
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}
    split = lambda t: re.findall(r"[^\x20\x09-\x0d]+", (t or "").translate(LOWER))
    held = lambda i: zlib.crc32(str(i).encode()) % 5 == 1
    one, two = Counter(), defaultdict(Counter)
    for i, t in texts.items():
        if not held(i):
            ws = [*split(t), None]
            one.update(ws)
            for a, b in zip(ws, ws[1:], strict=False):
                two[a][b] += 1
            two["<s>", 0][ws[0]] += 1
    total = sum(one.values())
    rare = [w for w, c in one.items() if w and c * 1000 <= total]  # the hot ones get their statistics another way
    chosen = [*sorted(rare, key=lambda w: (-one[w], w))[:10], *sorted(rare, key=lambda w: (one[w], w))[:10]]
    own = [i for i in range(10**6, 10**6 + 1000) if held(i)][: len(chosen)]
    f1, f2 = factors(one.values()), factors([c for v in two.values() for c in v.values()])
    single = {w: c * f1.get(c, 1.0) / total for w, c in one.items()}
    unknown = 1 - sum(single.values())

    def p(h, w):
        followers = two.get(h)
        if not followers:
            return single.get(w, unknown)
        count = sum(followers.values())
        given = sum(c * f2.get(c, 1.0) for c in followers.values())
        below = count if count - given > 1e-9 else count + 1
        if w in followers:
            return followers[w] * f2.get(followers[w], 1.0) / below
        return (1 - given / below) / (1 - sum(single[x] for x in followers)) * single.get(w, unknown)

    added = {i: f"{w} never-seen-{i} {w} nor-this-{i}" for i, w in zip(own, chosen, strict=True)}
    # a partition, and so a block, for each added text
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").coalesce(2)
    alone = spark.createDataFrame(spark.sparkContext.parallelize(list(added.items()), len(added)), "doc_id long, text string")
    got = {r.doc_id: r.score for r in katz.score_texts(docs.union(alone)).filter("doc_id >= 1000000").collect()}
    assert set(got) == set(added)
    for i, text in added.items():
        ws = [*split(text), None]
        want = sum(math.log10(p(a, b)) for a, b in zip([("<s>", 0), *ws], ws, strict=False))
        assert abs(got[i] - want) < 1e-6, (i, text)
